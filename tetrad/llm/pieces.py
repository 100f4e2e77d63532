"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a normalised text the table holds the one token that the
prefix's encoding ends with. It is found among the pieces that end at this
position (matches of an Aho-Corasick automaton): the piece ``t`` is the last
token iff the last token of the prefix before it and ``t`` are compatible,
that is, merging the characters of both by the model's rule gives exactly
these two again. Walking the table backwards from the end yields the ids.

Merges never cross a place where no piece could lie: between a character other
than the space mark and a following space mark, and beside a character that no
piece holds. The normalised text is cut there, and the ids of a cut part are
kept in a bounded table of each Python worker.

Defined cases: null and empty texts have no tokens and decode to the empty
text. A character that no piece holds becomes its UTF-8 byte pieces. Texts of
any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrad.llm import words as W

SPACE = "▁"
#: bytes of parts and of pairs kept per worker and generation (two generations are held)
PARTS_BYTES, PAIRS_BYTES = 32 << 20, 24 << 20
#: longest part that is kept, and what an entry takes besides its characters
LONGEST_KEPT, ENTRY_BYTES = 64, 160
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Recent:
    """A table of bounded bytes: when full it becomes the older of two, and
    entries found there move up."""

    def __init__(self, most: int):
        self.most, self.bytes, self.new, self.old = most, 0, {}, {}

    def get(self, key):
        x = self.new.get(key)
        if x is None:
            x = self.old.get(key)
            if x is not None:
                self.put(key, x)
        return x

    def put(self, key, value):
        text = len(value) if isinstance(value, str) else 0
        self.bytes += ENTRY_BYTES + text + (2 * len(key) if isinstance(key, str) else 0)
        if self.bytes > self.most:
            self.old, self.new, self.bytes = self.new, {}, 0
        self.new[key] = value


class PieceTable:
    """Pieces of a BPE model, read through the sentencepiece library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        _check(sp, path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.rank = {p: sp.get_score(i) for i, p in enumerate(self.piece) if not special[i]}
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.digits = {p: str(i) for p, i in self.id.items()}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        long = [p for p in self.rank if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("a piece holds a space mark after another character")
        joined = "".join(sorted({c for p in long for c in p}))
        self.inner = re.escape(joined.replace(SPACE, ""))
        #: marks and the characters after them; else one character that no longer piece holds
        self.parts = re.compile(f"{SPACE}*[{self.inner}]+|{SPACE}+|.", re.S)
        #: characters that are no pieces
        self.odd = re.compile(f"[^{re.escape(''.join(sorted(p for p in self.rank if len(p) == 1)))}]", re.S)
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if len(p) == 1 or self.merge(p) == [p]:      # pieces that merging can reach
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs, self.known = Recent(PAIRS_BYTES), Recent(PARTS_BYTES)

    def merge(self, text: str) -> list[str]:
        """The model's rule: the best-scored adjacent pair merges first, the
        leftmost among equals."""
        s, rank = list(text), self.rank
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = rank.get(s[i] + s[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.merge(a + b) == [a, b]
            self.pairs.put(key, ok)
        return ok

    def tokens(self, part: str) -> list[str]:
        """Pieces of a part: the prefix table forwards, the tokens backwards."""
        if self.odd.search(part):
            last = self._last_odd(part)
        else:                                             # every character is a piece: each prefix has its match
            last = [None] * (len(part) + 1)
            known = self.pairs.new.get
            for end, p in self.automaton.iter(part):
                end += 1
                if last[end] is None:
                    before = last[end - len(p)]
                    if before is None:
                        last[end] = p
                        continue
                    ok = known((before, p))
                    if ok is None:
                        ok = self.compatible(before, p)
                        known = self.pairs.new.get
                    if ok:
                        last[end] = p
        out, i = [], len(part)
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _last_odd(self, part: str) -> list:
        """The prefix table of a part with characters that are no pieces."""
        last: list = [None] * (len(part) + 1)
        ends: list = [[] for _ in part]
        for end, p in self.automaton.iter(part):
            ends[end].append(p)
        for i, c in enumerate(part):
            found = ends[i]
            if not found or len(found[-1]) > 1:          # a character that is no piece: a token by itself
                found = [*found, c]
            for p in found:
                j = i + 1 - len(p)
                if j == 0 or (last[j] is not None and self.compatible(last[j], p)):
                    last[i + 1] = p
                    break
        return last

    def ids(self, part: str) -> list[int]:
        out = []
        for p in self.tokens(part):
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def spell(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces, byte pieces as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.piece[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """Independent parts of the text as the model sees it."""
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def entry(self, part: str) -> str:
        """The part's ids, joined by commas; '!' before them if they do not spell the part."""
        e = self.known.get(part)
        if e is None:
            try:                                          # pieces alone spell the part
                e = ",".join([self.digits[p] for p in self.tokens(part)])
            except KeyError:
                ids = self.ids(part)
                e = ",".join(map(str, ids))
                if self.spell(ids) != part.replace(SPACE, " "):
                    e = "!" + e
            if len(part) <= LONGEST_KEPT:
                self.known.put(part, e)
        return e

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in map(int, self.entry(p).lstrip("!").split(","))]

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        return text[1:] if text.startswith(" ") else text

    def digests(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        known, parts = self.known.new.get, self.split(text)
        ids = ",".join([known(p) or self.entry(p) for p in parts])
        if "!" in ids:
            ids = ids.replace("!", "")
            decoded = self.decode(list(map(int, ids.split(","))))
        else:                                             # every part's ids spell the part
            decoded = "".join(parts).replace(SPACE, " ")[1:]
        return ids.count(",") + bool(ids), ids.encode(), decoded.encode()


#: a text that other normalisations change: accents apart, full-width, ligature, runs of blanks, capitals
_PROBE = "  Ａ ﬁ e\u0301 É  x\t½ A "


def _check(sp, path: str) -> None:
    """Raises unless the model is BPE that takes texts as they are, with a mark
    for every blank and one before the text: scores of BPE pieces are whole ranks
    (those of other models are log probabilities), and the probe must survive."""
    n = sp.get_piece_size()
    scores = [sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(s != int(s) for s in scores):
        raise ValueError(f"{path} is no BPE model: its scores are no ranks of merges")
    if sp.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
        raise ValueError(f"{path} changes texts before encoding")


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """The model's table of this Python process."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about a megabyte; a null is an empty text."""
    for i, j, _, _ in W.slices(texts):
        yield [x or "" for x in texts.slice(i, j - i).to_pylist()]


def encoded(text: Column, path: str | None = None) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column."""
    path = path or model_path()

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = table(path)
        for texts in batches:
            n, ids, decoded = [], [], []
            for run_ in _runs(texts):
                for a, b, c in map(t.digests, run_):
                    n.append(a)
                    ids.append(hashlib.sha256(b).hexdigest())
                    decoded.append(hashlib.sha256(c).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["n_tokens", "ids_sha256", "decoded_sha256"])
    return run(text)


def piece_ids(text: Column, path: str | None = None) -> Column:
    """Array of ids of a text column."""
    path = path or model_path()

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        t = table(path)
        return pa.array([t.encode(x) for run_ in _runs(texts) for x in run_], pa.list_(pa.int32()))
    return run(text)


def piece_text(ids: Column, path: str | None = None) -> Column:
    """The text that an array of ids stands for."""
    path = path or model_path()

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        t = table(path)
        return pa.array([t.decode(x or []) for x in rows.to_pylist()], pa.string())
    return run(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), encoded(F.col("text"), path).alias("e")) \
        .select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")

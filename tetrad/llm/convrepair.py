"""Conversation structure repair by the cheapest audit.

An audit edits a conversation's rows, in order of turn, until the initials of
their roles read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 2,
Delete 3 (a must for blank and duplicate rows), Insert of an empty user or
assistant row 2; a truncated row that stays adds 1. Of the cheapest audits, the
one whose initials are least in ASCII is taken.

The program goes over the rows with the four states of the pattern and holds,
per state, the least cost and the audit so far as a node of a tree
(:class:`Audits`): prefixes are shared, and ties are decided at the first
different edit, found by binary lifting over rolling hashes; equal hashes are
verified along the edits themselves.

Rows are dealt by range of (conversation, turn), so a conversation of any size
lies in consecutive parts. One pass over a part solves the conversations that
lie whole in it and are short; the rows of others go on in blocks: each block
gives its least audits from every state to every state, the blocks of a
conversation are chained the same way (costs and edits only, a letter a row),
and the texts are then hashed as a stream. What one task holds of a long
conversation is its letters, never its texts.

Defined cases: a null role or text is one blank; null turns come first and
count for no gap; a null conv_id is a conversation. Rows of one turn are
ordered by role and digest of the text, so copies are adjacent. A role that is
neither s..., u... nor a... cannot be kept. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tetrad.session import materialize

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: states of the pattern: nothing yet, after s, after u, after a; those that may end
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (START, ASSISTANT)
#: the state that a user or assistant row leads to
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
PAIRS = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")
#: rows and characters of a block; a conversation up to one block is solved where it lies
BLOCK_ROWS, BLOCK_CHARS = 2_000, 4_000_000
#: shapes up to this many rows are remembered, so many per worker
SHAPE_ROWS, SHAPES = 32, 20_000
_M, _B = (1 << 61) - 1, 0x1F3D5B79ACE13579
_INK = re.compile(r"[^\x20\x09-\x0D]")


class Audits:
    """Edit sequences as nodes that share their prefixes."""

    def __init__(self):
        self.label, self.up, self.depth, self.hash = [""], [[]], [0], [0]
        self.same = {}                                    # pairs whose edits were found equal one by one

    def add(self, node: int, label: str) -> int:
        """The audit of ``node`` and then the edits of ``label``."""
        new, above, k = len(self.label), [node], 0
        while len(self.up[above[-1]]) > k:                # ancestors 1, 2, 4, ... steps up
            above.append(self.up[above[-1]][k])
            k += 1
        h = self.hash[node]
        for c in label:
            h = (h * _B + ord(c)) % _M
        self.label.append(label)
        self.up.append(above)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            gap = self.depth[node] - depth
            node = self.up[node][gap.bit_length() - 1]
        return node

    def labels(self, node: int, down_to: int = 0) -> list[str]:
        out = []
        while self.depth[node] > down_to:
            out.append(self.label[node])
            node = self.up[node][0]
        return out[::-1]

    def equal(self, a: int, b: int) -> bool:
        """Whether nodes of one depth hold the same edits: by hash, then verified."""
        if self.hash[a] != self.hash[b]:
            return False
        seen = []
        while a != b and self.same.get((a, b)) is None:
            if self.label[a] != self.label[b]:
                return False                              # a collision
            seen.append((a, b))
            a, b = self.up[a][0], self.up[b][0]
        self.same.update(dict.fromkeys(seen, True))
        return True

    def shared(self, a: int, b: int) -> int:
        """How many labels the two begin with alike."""
        least = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, least), self.ancestor(b, least)
        if self.equal(a, b):
            return least
        low, high, k = 0, least, len(self.up[a])
        while k:                                          # halves the steps while the nodes above still differ
            k -= 1
            if k < len(self.up[a]) and k < len(self.up[b]) and not self.equal(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return self.depth[a] - 1

    def less(self, a: int, b: int) -> bool:
        """Whether the edits of ``a`` come before those of ``b`` in ASCII."""
        if a == b:
            return False
        k = self.shared(a, b)
        return "".join(self.labels(a, k)) < "".join(self.labels(b, k))

    def text(self, node: int) -> str:
        return "".join(self.labels(node))


def _put(audits: Audits, best: dict, state: int, cost: int, node: int, label: str) -> None:
    """Takes the audit of ``node`` and ``label`` if it beats the state's."""
    old = best.get(state)
    if old is not None and old[0] < cost:
        return
    new = audits.add(node, label) if label else node
    if old is None or cost < old[0] or audits.less(new, old[1]):
        best[state] = (cost, new)


def _inserts(audits: Audits, best: dict) -> dict:
    """The states after up to two more inserts (more lead back to a state)."""
    last = dict(best)
    for _ in range(2):
        reached: dict = {}
        for state, (cost, node) in last.items():
            _put(audits, reached, NEXT[state], cost + COST[INSERT], node, INSERT)
        last = {}
        for state, (cost, node) in reached.items():
            before = best.get(state)
            _put(audits, best, state, cost, node, "")
            if best[state] is not before and best[state][1] == node:
                last[state] = best[state]
    return best


def solve(shape: str, start: int = START) -> dict[int, tuple[int, str]]:
    """Least cost and audit from state ``start`` to every state that can be
    reached. ``shape``: a letter a row: s, u, a or x by its role, upper-case
    when truncated; '-' if it must go."""
    return _solve(shape, start) if len(shape) <= SHAPE_ROWS else _solve.__wrapped__(shape, start)


@lru_cache(SHAPES)
def _solve(shape: str, start: int) -> dict[int, tuple[int, str]]:
    audits = Audits()
    best = _inserts(audits, {start: (0, 0)})
    for row in shape:
        after: dict = {}
        extra = TRUNCATED if row.isupper() else 0
        for state, (cost, node) in best.items():
            _put(audits, after, state, cost + COST[DELETE], node, DELETE)
            if row == "-":
                continue
            to = NEXT[state]
            if row.lower() == "s" and state == START:
                _put(audits, after, SYSTEM, cost + extra, node, KEEP)
            if row.lower() == ROLE[to][0]:
                _put(audits, after, to, cost + extra, node, KEEP)
            _put(audits, after, to, cost + COST[REROLE] + extra, node, REROLE)
        best = _inserts(audits, after)
    return {s: (c, audits.text(n)) for s, (c, n) in best.items()}


def cheapest(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least cost and audit among the states that may end."""
    return min(ends[s] for s in ENDS if s in ends)


def edited(audit: str, rows: list[tuple[str, str]], state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of every edit of the audit, and the state after it."""
    out, rows = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == KEEP:
            state = SYSTEM if state == START and role[:1] == "s" else NEXT[state]
        elif edit != DELETE:
            state = NEXT[state]
            role = ROLE[state]
        out.append((edit, role, text))
    return out, state


class Faults:
    """Faults of rows that come in order, and the counts of what was seen."""

    def __init__(self):
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first = self.last = None
        self.seen = set()

    def row(self, turn, role: str, text: str) -> tuple[str, str, bytes, bool]:
        """(role letter, fault, digest, whether role and text were seen)."""
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in PAIRS
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        old = digest in self.seen
        self.seen.add(digest)
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ink else "duplicate" if old else "" if ink[-1] in ".!?" else "truncated"
        return initial if initial in ("s", "u", "a") else "x", fault, digest, old


def shape_of(letters, faults) -> str:
    """The shape that :func:`solve` takes."""
    return "".join("-" if f in ("blank", "duplicate") else x.upper() if f else x for x, f in zip(letters, faults))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, ``gone``: the rows after the damage that a
    crc32 of ``conv_id:turn`` asks for. Dropped rows stay, marked as gone."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    words = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(text("role")).alias("role"), words.alias("text"),
        (code == 0).alias("gone"), F.explode(copies).alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie")]
    rows = rows.withColumn("tie", F.md5(F.col("text").cast("binary")))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("conv_id", "turn", "role", "text", "gone", F.spark_partition_id().alias("part"))


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def _structs(edits) -> list[dict]:
    return [dict(zip(("edit", "role", "text"), e)) for e in edits]


def _line(edit: str, role: str, text: str) -> bytes:
    return b"" if edit == DELETE else f"{role}:{text}\n".encode()


COUNTS = ["gaps", *FAULTS, "illegal", "cost"]
_EDITS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_DONE = [("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("edits", _EDITS)]
_ROW = [("part", pa.int32()), ("block", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
        ("text", pa.string()), ("letter", pa.string()), ("fault", pa.string()), ("digest", pa.binary()), ("old", pa.bool_())]
_BLOCK = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("place", pa.int64()),
          *((c, pa.int64()) for c in (*FAULTS, "illegal", "turns", "first_turn", "last_turn")), ("first", pa.string()), ("last", pa.string()),
          ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
_CHAIN = [("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edits", pa.string()),
          *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())]


def _first_pass(rows: DataFrame, with_edits: bool) -> DataFrame:
    """Solved conversations (``part`` is null), and the rows of the others: of
    those that a part begins or ends with, and of those longer than a block. A
    row with part -1 only names a conversation."""
    fields = pa.schema(_DONE + _ROW)

    def run(batches):
        out: list[dict] = []
        conv, rows, faults, first, block, place, chars, spilled = (), [], None, True, 0, 0, 0, False

        def spill():
            """The rows at hand as a block of a conversation that is solved later."""
            nonlocal block, place, spilled
            for r in rows:
                out.append({"conv_id": conv[0], "block": block, "place": place, **r})
                place += 1
            block, spilled = block + 1, True
            rows.clear()

        def close(ends_here: bool):
            if not conv:
                return
            if spilled or first or not ends_here:
                spill() if rows else out.append({"conv_id": conv[0], "part": -1})
                return
            cost, audit = cheapest(solve(shape_of((r["letter"] for r in rows), (r["fault"] for r in rows))))
            edits, _ = edited(audit, [(r["role"], r["text"]) for r in rows])
            found = [r["fault"] for r in rows]
            out.append({"conv_id": conv[0], "gaps": _gaps(faults.first_turn, faults.last_turn, faults.turns),
                        **{f: found.count(f) for f in FAULTS}, "illegal": faults.illegal, "cost": cost, "audit": audit,
                        "repaired_sha256": hashlib.sha256(b"".join(_line(*e) for e in edits)[:-1]).hexdigest(),
                        "edits": _structs(edits) if with_edits else None})

        for b in batches:
            for i in range(0, b.num_rows, 256):
                for r in b.slice(i, 256).to_pylist():
                    if conv != (r["conv_id"],):
                        if conv:
                            close(True)
                            first = False
                        conv, faults, chars, spilled = (r["conv_id"],), Faults(), 0, False
                        rows.clear()
                    if r["gone"]:
                        continue
                    if len(rows) >= BLOCK_ROWS or chars > BLOCK_CHARS:
                        spill()
                        faults, chars = Faults(), 0
                    letter, fault, digest, old = faults.row(r["turn"], r["role"], r["text"])
                    rows.append({"part": r["part"], "turn": r["turn"], "role": r["role"], "text": r["text"], "letter": letter,
                                 "fault": fault, "digest": digest, "old": old})
                    chars += len(r["text"])
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out = []
        close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)
    return rows.mapInArrow(run, from_arrow_schema(fields))


def _blocks(rows: DataFrame) -> DataFrame:
    """Counts of every block, and its least audits from state to state. A row
    that an earlier block of the conversation holds too is a duplicate."""
    fields = pa.schema(_BLOCK)
    narrow = rows.select("conv_id", "part", "block", "place", "turn", F.substring("role", 1, 1).alias("initial"), "letter", "fault", "old", "digest")
    later = Window.partitionBy("conv_id", "digest").orderBy("part", "block")
    again = narrow.filter("not old").withColumn("k", F.row_number().over(later)).filter("k > 1").select("part", "place", F.lit(True).alias("again"))
    fault = F.when(F.col("again") & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault"))
    narrow = narrow.drop("digest", "old").join(again, ["part", "place"], "left").withColumn("fault", fault).drop("again")

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("place").to_pylist()
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        ini, found = [r["initial"] for r in rows], [r["fault"] for r in rows]
        shape = shape_of((r["letter"] for r in rows), found)
        ways = [{"start": s, "end": e, "cost": c, "audit": a} for s in STATES for e, (c, a) in solve(shape, s).items()]
        return pa.Table.from_pylist([{
            **{k: rows[0][k] for k in ("conv_id", "part", "block", "place")}, **{f: found.count(f) for f in FAULTS},
            "illegal": sum(a + b not in PAIRS for a, b in zip(ini, ini[1:])), "turns": len(set(turns)),
            "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
            "first": ini[0], "last": ini[-1], "ways": ways}], fields)
    return narrow.groupBy("part", "block").applyInArrow(run, from_arrow_schema(fields))


def _chained(blocks: DataFrame) -> DataFrame:
    """The edits of every row of the long conversations; counts and audit with
    the first row of each. A block's inserts go with the row after them, the
    last ones with the last row."""
    fields = pa.schema(_CHAIN)

    def run(t: pa.Table) -> pa.Table:
        blocks = t.sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()
        audits, best = Audits(), {START: (0, 0)}
        for b in blocks:
            after: dict = {}
            for w in b["ways"]:
                if w["start"] in best:
                    cost, node = best[w["start"]]
                    _put(audits, after, w["end"], cost + w["cost"], node, w["audit"])
            best = after
        cost, audit = min((best[s][0], audits.text(best[s][1]), s) for s in ENDS if s in best)[:2]
        end = next(s for s in ENDS if s in best and best[s][0] == cost and audits.text(best[s][1]) == audit)
        turns, seen, illegal, last = 0, None, 0, None
        for b in blocks:
            turns += b["turns"] - (seen is not None and b["first_turn"] == seen)
            seen = b["last_turn"] if b["last_turn"] is not None else seen
            illegal += b["illegal"] + (last is not None and last + b["first"] not in PAIRS)
            last = b["last"]
        low = next((b["first_turn"] for b in blocks if b["first_turn"] is not None), None)
        whole = {"gaps": _gaps(low, seen, turns), **{f: sum(b[f] for b in blocks) for f in FAULTS}, "illegal": illegal, "cost": cost, "audit": audit}
        out = []
        for b, piece in zip(blocks, audits.labels(best[end][1])):
            own = re.findall("I*[KRD]", piece)
            own[-1] += piece[len("".join(own)):]
            for k, edits in enumerate(own):
                out.append({"conv_id": b["conv_id"], "part": b["part"], "place": b["place"] + k, "edits": edits, **whole})
                whole = {}
        return pa.Table.from_pylist(out, fields)
    return blocks.groupBy("conv_id").applyInArrow(run, from_arrow_schema(fields))


def _spelled(rows: DataFrame, chained: DataFrame, with_edits: bool) -> DataFrame:
    """The long conversations like the solved ones of the first pass: their rows
    pass in order as a stream, each with its edits. With ``with_edits`` a row of
    the result holds the edits of one row, the last one the counts."""
    fields = pa.schema([*_DONE, ("part", pa.int32()), ("place", pa.int64())])
    rows = rows.select("part", "place", "role", "text").join(chained.withColumnRenamed("edits", "todo"), ["part", "place"])

    def run(batches):
        conv, state, digest, counts, glue = (), START, None, {}, b""
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(i, 256).to_pylist():
                    if conv != (r["conv_id"],):
                        if conv:
                            out.append({**counts, "repaired_sha256": digest.hexdigest()})
                        conv, state, digest, glue = (r["conv_id"],), START, hashlib.sha256(), b""
                        counts = {k: r[k] for k in ("conv_id", *COUNTS, "audit")}
                    edits, state = edited(r["todo"], [(r["role"], r["text"])], state)
                    lines = b"".join(_line(*e) for e in edits)
                    if lines:
                        digest.update(glue + lines[:-1])
                        glue = b"\n"
                    if with_edits:
                        out.append({"conv_id": conv[0], "edits": _structs(edits), "part": r["part"], "place": r["place"]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, fields)
        if conv:
            yield pa.RecordBatch.from_pylist([{**counts, "repaired_sha256": digest.hexdigest()}], fields)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(run, from_arrow_schema(fields))


def _audited(conversations: DataFrame, with_edits: bool) -> DataFrame:
    """Columns of ``_DONE`` and (part, place): a row per conversation with its
    counts; with ``with_edits`` the edits, those of a long one in many rows."""
    first = materialize(_first_pass(_ordered(conversations), with_edits), "audits")
    solved = first.filter("part is null").select(*(c for c, _ in _DONE), "part", "place")
    rows = first.filter("block is not null")
    chained = materialize(_chained(_blocks(rows)), "audit-chains")
    long = _spelled(rows, chained, with_edits)
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    bare = first.filter("part is not null").groupBy("conv_id").agg(F.count("block").alias("n")).filter("n = 0") \
        .select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"),
                F.array().cast("array<struct<edit:string,role:string,text:string>>").alias("edits"),
                F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("place"))
    return solved.unionByName(long).unionByName(bare)


def _prepared(conversations: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.lit(False).alias("gone"))


def audit(conversations: DataFrame, damaged: bool = False) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 of every
    conversation. ``damaged``: the rows are those of :func:`damage`."""
    rows = conversations if damaged else _prepared(conversations)
    return _audited(rows, False).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair(conversations: DataFrame, damaged: bool = False) -> DataFrame:
    """The audited rows: conv_id, ``at`` (an array that orders a conversation's
    rows), edit, role, text. Deleted rows are among them, as edit D."""
    rows = conversations if damaged else _prepared(conversations)
    none = F.lit(0).cast("long")
    at = F.array(F.coalesce(F.col("part").cast("long"), none), F.coalesce("place", none), F.col("k").cast("long"))
    return _audited(rows, True).select("conv_id", "part", "place", F.posexplode("edits").alias("k", "e")) \
        .select("conv_id", at.alias("at"), "e.edit", "e.role", "e.text")


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """The audit of the damaged conversations."""
    return audit(damage(conversations), damaged=True)

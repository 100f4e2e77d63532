"""Audits of conversations against brute force over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tetrad.llm import convrepair as C
from tetrad.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_audit(shape: str) -> tuple[int, str]:
    """All audits of up to two inserts between rows, one state machine a run."""
    best = None
    todo = [(0, "", "", 0)]                               # row, audit, roles, cost
    while todo:
        i, audit, roles, cost = todo.pop()
        if not re.fullmatch("s?(ua)*u?", roles) or (best and cost > best[0]):
            continue
        if i == len(shape) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if not audit.endswith("II"):
            todo += [(i, audit + "I", roles + c, cost + 2) for c in "ua"]
        if i < len(shape):
            row, extra = shape[i].lower(), int(shape[i].isupper())
            todo.append((i + 1, audit + "D", roles, cost + 3))
            if row != "-":
                todo.append((i + 1, audit + "K", roles + row, cost + extra))
                todo += [(i + 1, audit + "R", roles + c, cost + 2 + extra) for c in "ua"]
    return best


@pytest.mark.parametrize("n", range(4))
def test_cheapest_of_all_short_shapes(n):
    for shape in map("".join, itertools.product("suaUAx-", repeat=n)):
        assert C.cheapest(C.solve(shape)) == brute_audit(shape), shape


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="suaSUAx-", min_size=4, max_size=8))
def test_cheapest_of_longer_shapes(shape):
    assert C.cheapest(C.solve(shape)) == brute_audit(shape)


def test_blocks_chain_to_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        shape = "".join(rng.choices("suaUAx-", k=rng.randint(1, 40)))
        whole, best = C.solve(shape), {C.START: (0, "")}
        cut = sorted({0, len(shape), *rng.choices(range(len(shape)), k=3)})
        for a, b in zip(cut, cut[1:]):
            after = {}
            for s, (cost, audit) in best.items():
                for e, (c, x) in C.solve(shape[a:b], s).items():
                    after[e] = min(after.get(e, (cost + c, audit + x)), (cost + c, audit + x))
            best = after
        assert best == whole


@given(st.lists(st.tuples(st.integers(0, 400), st.sampled_from(["K", "D", "I", "R", "KD", "IK"])), min_size=2, max_size=120))
def test_order_of_audits(steps):
    audits = C.Audits()
    for at, label in steps:
        audits.add(at % len(audits.label), label)
    nodes = range(len(audits.label))
    text = [audits.text(n) for n in nodes]
    for a in list(nodes)[-12:]:
        for b in list(nodes)[-12:]:
            assert audits.less(a, b) == (text[a] < text[b])


def test_equal_hashes_are_verified():
    audits = C.Audits()
    a, b = audits.add(audits.add(0, "K"), "D"), audits.add(audits.add(0, "D"), "K")
    audits.hash = [0] * len(audits.hash)                  # every hash collides
    assert not audits.equal(a, b) and audits.less(b, a) and not audits.less(a, b)


def brute(rows: list[tuple]) -> dict:
    """The query's row of every conversation, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = ":".join(" " if x is None else str(x) for x in (conv, turn))
            code = zlib.crc32(key.encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            role = "user" if code == 4 else role
            kept += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        shape, seen, n = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            shape += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                n[fault] += 1
        turns = [r[0] for r in kept if r[0] is not None]
        cost, audit = C.cheapest(C.solve(shape))
        lines, state, todo = [], "", list(kept)
        for e in audit:
            role, text = ("", "") if e == "I" else todo.pop(0)[1:]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                     illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(df, rows):
    got = C.audit_damaged(df).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_repair"](spark, SF_SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len({r[0] for r in rows})


def random_rows(seed: int, n: int, convs: list) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.choice(convs), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(["a.", "b!", "c", "", "  \n", None, "d? "])) for _ in range(n)]


def test_hostile_rows(spark):
    rows = random_rows(1, 600, [None, 1, 2, 3, *range(10, 80)])
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", gone int, audit string")
    check(df, rows)
    assert C.audit(df).count() == len({r[0] for r in rows})
    assert C.audit_damaged(df.limit(0)).count() == 0 and C.repair(df.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)               # the tasks see it: functions are sent with their globals
    rows = random_rows(2, 900, [5, 5, 5, 5, 6, None, *range(20, 30)])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(df, rows)


def test_repaired_rows(spark, monkeypatch):
    for block in (2000, 5):
        monkeypatch.setattr(C, "BLOCK_ROWS", block)
        rows = random_rows(4, 300, [1, 2, 3, *range(10, 30)])
        damaged = C.damage(spark.createDataFrame(rows, SCHEMA))
        audits = {r.conv_id: r for r in C.audit(damaged, True).collect()}
        edits = {}
        for r in sorted(C.repair(damaged, True).collect(), key=lambda r: (r.conv_id, r["at"])):
            edits.setdefault(r.conv_id, []).append(r)
        for conv, want in audits.items():
            own = edits.get(conv, [])
            assert "".join(r.edit for r in own) == want.audit
            kept = [r for r in own if r.edit != "D"]
            assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in kept))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == want.repaired_sha256

"""Conversation repair against brute force."""

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparktrend.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit) over all edits of ``rows`` (initial, fault), by breadth over (place, last role): every way is kept that could still be the least."""
    best = {(0, ""): (0, "")}
    reached = {}
    todo = [(0, "", 0, "")]
    while todo:  # all ways, without recursion: costs grow along a way, and a state keeps its cheapest, then least
        todo.sort(key=lambda x: (x[2], x[3]))
        at, last, cost, audit = todo.pop(0)
        if (at, last) in reached and reached[at, last] < (cost, audit):
            continue
        reached[at, last] = min(reached.get((at, last), (cost, audit)), (cost, audit))
        if at == len(rows) and last in ("", "a"):
            best["end"] = min(best.get("end", (10**9, "")), (cost, audit))
        for r in NEXT[last]:
            if r != "s":
                todo.append((at, r, cost + 5, audit + "I")) if audit[-2:] != "II" else None
        if at < len(rows):
            role, fault = rows[at]
            todo.append((at + 1, last, cost + 2, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role and role in NEXT[last]:
                    todo.append((at + 1, role, cost + extra, audit + "K"))
                for r in NEXT[last]:
                    if r != "s":
                        todo.append((at + 1, r, cost + 1 + extra, audit + "R"))
    return best["end"]


def plain(rows):
    """The contract's row of one conversation; ``rows`` (turn, role, text) after damage, in order."""
    seen, faults, out = set(), [], []
    for _, role, text in rows:
        core = text.rstrip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    pairs = [(a[1][:1], b[1][:1]) for a, b in itertools.pairwise(rows)]
    cost, audit = cheapest([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    k, last = 0, ""
    for e in audit:
        role, text = rows[k][1:] if e != "I" else ("", "")
        k += e != "I"
        if e == "D":
            continue
        if e in "RI":
            role = "assistant" if last == "u" else "user"
        out.append(f"{role}:{text}")
        last = role[:1]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: faults.count(f)
    return (gaps, count("blank"), count("duplicate"), count("truncated"), sum(a + b not in ("su", "ua", "au") or not a for a, b in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    """Rows of one conversation after the contract's damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def expected(rows):
    by_conv = defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plain(d) if (d := damaged(rs)) else empty for c, rs in by_conv.items()}


def query(spark, rows, tmp_path, monkeypatch, partitions=4):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, code string, kind int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversations(spark, str(tmp_path)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:6] + (r["cost"], r["audit"], r["repaired_sha256"]) for r in found}


def with_extra(rows):
    return [(*r, "clash", 1) for r in rows]


def test_tables_of_all_short_signatures_equal_the_search_over_all_edits():
    letters = "suaxSUAXd"
    rng = np.random.default_rng(0)
    short = ["".join(s) for n in (1, 2) for s in itertools.product(letters, repeat=n)]
    for s in [*short, *("".join(rng.choice(list(letters), n)) for n in (3, 4, 5, 6, 7, 8) for _ in range(30))]:
        rows = [(c.lower() if c.lower() in "sua" else "x", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in s]
        table = conversations.table_of(s)
        ways = [(table[to][0] + conversations.ending(to)[0], table[to][1] + conversations.ending(to)[1]) for to in range(4)]
        assert min(ways) == cheapest(rows), s


def test_rank_tells_what_the_strings_tell():
    table = conversations.table_of("uaUAxs")
    order = conversations.rank(table)
    for a in range(4):
        for b, c in itertools.combinations(range(4), 2):
            if table[4 * a + b][1] != table[4 * a + c][1]:
                assert (order[4 * a + b] < order[4 * a + c]) == (table[4 * a + b][1] < table[4 * a + c][1])


def test_the_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", "Ünïcode 🙂.", "end. \t\n", "a: b.", None]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(int(rng.integers(1, 9))):
            role = ["system", "user", "assistant", "tool", "", "User", None][int(rng.choice(7, p=[0.1, 0.4, 0.35, 0.05, 0.03, 0.02, 0.05]))]
            rows.append((conv, None if rng.random() < 0.05 else int(turn * rng.integers(1, 3)), role, texts[int(rng.integers(len(texts)))]))
    rows += rows[:5]  # repeated rows
    rng.shuffle(rows)
    rows = [tuple(r) for r in rows]
    assert query(spark, with_extra(rows), tmp_path, monkeypatch) == expected(rows)


def test_the_given_tables(spark, tmp_path, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query(spark, with_extra(rows), tmp_path, monkeypatch) == expected(rows)


@pytest.mark.parametrize("repeated", [False, True])
def test_one_conversation_over_many_ranges_and_blocks(spark, tmp_path, monkeypatch, repeated):
    monkeypatch.setattr(conversations, "BLOCK", 7)
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No!"] if repeated else [f"number {i % 350}{'.' * (i % 5 > 0)}" for i in range(400)]
    rows = [(1, int(t // 2 if repeated else t + t // 50), ["user", "assistant", "system"][int(rng.choice(3, p=[0.5, 0.4, 0.1]))], texts[t % len(texts)]) for t in range(400)]
    rows += [(2, 1, "user", "Hello."), (2, 2, "assistant", "Hi."), (0, 0, "user", "alone?")]
    assert query(spark, with_extra(rows), tmp_path, monkeypatch) == expected(rows)


def test_long_texts_and_an_empty_table(spark, tmp_path, monkeypatch):
    rows = [(7, 0, "user", "word " * 400_000 + "end."), (7, 1, "assistant", "x" * 1_000_000)]
    assert query(spark, with_extra(rows), tmp_path / "a", monkeypatch) == expected(rows)
    assert query(spark, [], tmp_path / "b", monkeypatch) == {}


def test_repaired_rows_and_their_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 3, "user", "Left over?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = conversations.audits(df)
    out = [tuple(r) for r in conversations.repaired(df, edits).orderBy("nth").collect()]
    assert [e for *_, e in out] == ["K", "K"] and [r[2] for r in out] == ["user", "assistant"]
    assert conversations.audit_table(edits).collect()[0]["audit"] == "KKD"

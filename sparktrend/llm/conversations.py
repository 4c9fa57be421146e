"""Repair of conversation structure by signature deduplication.

A conversation's rows, in order of turn, become a string of one letter a row:
its role and its fault. Corpora repeat such signatures, so each distinct one is
solved once, by memoised recursion over its halves, for the cheapest edits
between any two states of the grammar ``(s?(ua)+)?``; the audits join back by
signature, and a stream of each conversation's rows replays them.

A conversation may hold any share of all rows. Its rows without their texts
are dealt out by ranges of the order, a signature covers at most ``BLOCK`` rows
of one range, and what a conversation's blocks cost between states chains them.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktrend.llm.common import join_spread, materialize, scoped, small_batches

#: Rows of a signature at most.
BLOCK = 1_024
#: Signatures up to this length are remembered by a worker, so many at most.
SHORT, REMEMBERED = 64, 20_000
SPACES = " \t\n\x0b\x0c\r"
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: States of the grammar: nothing yet, behind the system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: A pair's least cost and, of its cheapest audits, the least; by 4 * from + to.
Table = tuple[tuple[float, str], ...]
NEVER = (math.inf, "")


def inserts(state: int) -> Iterator[tuple[int, float, str]]:
    """(state, cost, audit) after no, one or two inserted rows; with three or more the first two could be left out."""
    cost, audit = 0, ""
    for _ in range(3):
        yield state, cost, audit
        state, cost, audit = ASSISTANT if state == USER else USER, cost + COSTS["insert"], audit + "I"


def one_row(letter: str) -> Table:
    """The table of a row: s, u, a, or x for another role; upper case if it is truncated; d: it must go."""
    role, extra = letter.lower(), COSTS["truncated"] if letter.isupper() else 0
    best = {}
    for start in range(4):
        for state, cost, audit in inserts(start):
            edits = [(state, cost + COSTS["delete"], audit + "D")]
            if letter != "d":
                edits += [(NEXT[state, role], cost + COSTS["keep"] + extra, audit + "K")] if (state, role) in NEXT else []
                edits += [(NEXT[state, r], cost + COSTS["rerole"] + extra, audit + "R") for r in "ua" if (state, r) in NEXT]
            for end, *found in edits:
                best[start, end] = min(best.get((start, end), NEVER), tuple(found))
    return tuple(best.get((a, b), NEVER) for a in range(4) for b in range(4))


def chained(one: Table, other: Table) -> Table:
    """The table of two stretches of rows. Audits of a stretch are never beginnings of each other, so least parts make the least whole."""
    found = []
    for a in range(4):
        for b in range(4):
            cost = min(one[4 * a + m][0] + other[4 * m + b][0] for m in range(4))
            ways = [one[4 * a + m][1] + other[4 * m + b][1] for m in range(4) if one[4 * a + m][0] + other[4 * m + b][0] == cost]
            found.append((cost, min(ways)) if cost < math.inf else NEVER)
    return tuple(found)


def table_of(signature: str) -> Table:
    """The table of a signature, by recursion over its halves; those of short ones are remembered."""
    return _remembered(signature) if len(signature) <= SHORT else _halves(signature)


def _halves(signature: str) -> Table:
    if len(signature) == 1:
        return one_row(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return chained(table_of(signature[:half]), table_of(signature[half:]))


_remembered = lru_cache(REMEMBERED)(_halves)


def ending(state: int) -> tuple[float, str]:
    """What the rows inserted behind the last one cost, and their audit."""
    return min((cost, audit) for end, cost, audit in inserts(state) if end in ENDS)


def rank(table: Table) -> list[int]:
    """For each pair of states the place of its audit among those from the same state."""
    return [sorted(table[a * 4 + k][1] for k in range(4)).index(table[a * 4 + b][1]) for a in range(4) for b in range(4)]


def _ordered(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest) of every row. Null roles and texts are one space; rows of one turn are in the order of ``digest``."""
    own = df.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    return own.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))))


def letters() -> Column:
    """Of (role, text): the row's letter, but for duplicates."""
    core = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(core == "", "d").when(F.right(core, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))


BLOCKS = "conv {0}, part int, seq long, turn long, digest binary, n long, signature string, first_role string, last_role string, first_turn long, last_turn long, low long, turns long, illegal long, blank long, duplicate long, truncated long, seen binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each block of at most ``BLOCK`` rows of a conversation within one range of the order.

    turn, digest: of its first row; ``seen``: the digests of its rows, 16 bytes
    each, of blocks whose conversation may go on in another range.
    """
    kind, role = rows.schema["conv"].dataType.simpleString(), F.substring("role", 1, 1)
    thin = rows.select("conv", "turn", "digest", F.when(role.isin("s", "u", "a"), role).otherwise("x").alias("role"), letters().alias("letter"))
    thin = materialize(thin, "turns")  # texts are read for it once, not again for the bounds of the ranges
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows, of which there may be any number, are dealt out by their place in the input.
    placed = thin.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "place").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, True
        pending: list[dict] = []  # blocks of the conversation at hand
        block, seen, name, last_turn, last_role = None, set(), object(), None, ""
        types = None

        def written(blocks: list[dict], open_: bool) -> pa.RecordBatch:
            for b in blocks:
                b["signature"], b["seen"] = "".join(b["signature"]), b"".join(b["seen"]) if open_ else None
            return pa.RecordBatch.from_pylist(blocks, types)

        for batch in batches:
            if types is None:
                text, number, blob = pa.string(), pa.int64(), pa.binary()
                kinds = {"part": pa.int32(), "digest": blob, "seen": blob, "signature": text, "first_role": text, "last_role": text}
                names = [f.split()[0] for f in BLOCKS.split(", ")]
                types = pa.schema([(n, batch.schema.field(0).type if n == "conv" else kinds.get(n, number)) for n in names])
            for conv, turn, digest, role, letter in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != name or block is None:
                    if pending:
                        yield written(pending, first)
                        first = False
                    name, pending, block, seen, last_turn, last_role = conv, [], None, set(), None, ""
                if block is None or block["n"] == BLOCK:
                    block = {"conv": conv, "part": part, "seq": seq, "turn": turn, "digest": digest, "n": 0, "signature": [], "first_role": role, "first_turn": turn, "low": turn, "turns": 0, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "seen": []}
                    pending.append(block)
                    seq += 1
                if letter == "d":
                    block["blank"] += 1
                elif digest in seen:
                    letter = "d"
                    block["duplicate"] += 1
                elif letter.isupper():
                    block["truncated"] += 1
                seen.add(digest)
                block["illegal"] += last_role != "" and last_role + role not in ("su", "ua", "au")
                block["turns"] += turn is not None and turn != last_turn
                block["low"] = turn if block["low"] is None else block["low"]
                block["n"] += 1
                block["signature"].append(letter)
                block["seen"].append(digest)
                block["last_role"], block["last_turn"] = role, turn
                last_role, last_turn = role, turn
        if pending:
            yield written(pending, True)

    return placed.select("conv", "turn", "digest", "role", "letter").mapInArrow(run, BLOCKS.format(kind))


def _without_late(blocks: DataFrame) -> DataFrame:
    """``blocks`` (a written table) whose rows that an earlier range has seen are duplicates as well."""
    spans = blocks.filter("seen is not null").groupBy("conv").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("conv")
    # At most one such conversation begins in each range.
    open_ = blocks.filter("seen is not null").alias("b").join(F.broadcast(spans.alias("s")), F.col("b.conv").eqNullSafe(F.col("s.conv")), "left_semi")
    places = F.posexplode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k", "same")
    rows = open_.select("conv", "part", "seq", "signature", "seen", places).select("conv", "part", "seq", "k", F.substring("signature", F.col("k") + 1, F.lit(1)).alias("letter"), F.substring("seen", F.col("k") * 16 + 1, F.lit(16)).alias("digest"))
    firsts = rows.filter("letter <> 'd'")  # one for each digest and range
    nth = F.row_number().over(Window.partitionBy("conv", "digest").orderBy("part"))
    late = materialize(firsts.withColumn("nth", nth).filter("nth > 1").groupBy("part", "seq").agg(F.collect_list("k").alias("late"), F.count_if(F.upper("letter") == F.col("letter")).alias("cut")), "late")
    known = blocks.drop("seen").join(late, ["part", "seq"], "left")
    places = F.coalesce("late", F.array().cast("array<int>"))
    kept = F.transform(F.split("signature", ""), lambda c, i: F.when(F.array_contains(places, i), F.lit("d")).otherwise(c))
    return known.withColumns({
        "signature": F.when(F.size(places) > 0, F.array_join(kept, "")).otherwise(F.col("signature")),
        "duplicate": F.col("duplicate") + F.size(places), "truncated": F.col("truncated") - F.coalesce("cut", F.lit(0)),
    }).drop("late", "cut")


def _solved(blocks: DataFrame) -> DataFrame:
    """(signature, held, costs, ranks, audits), written: each distinct signature of ``blocks`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [table_of(s.as_py()) for s in batch.column(0)]
            costs = [[None if c == math.inf else int(c) for c, _ in t] for t in tables]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array([rank(t) for t in tables], pa.list_(pa.int32())), pa.array([[a for _, a in t] for t in tables], pa.list_(pa.string()))], names=["signature", "held", "costs", "ranks", "audits"])

    distinct = blocks.groupBy("signature").agg(F.count("*").alias("held"))
    return materialize(distinct.mapInArrow(run, "signature string, held long, costs array<long>, ranks array<int>, audits array<string>"), "signatures")


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _chosen(solved: DataFrame) -> DataFrame:
    """A row for each block: conv, part, seq, turn, digest, audit; the first of a conversation has ``TOTALS``.

    A stream goes through a conversation's blocks from the last to the first.
    It holds the choices, some bytes for each ``BLOCK`` of its rows.
    """
    kind = solved.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, part int, seq long, way int, tail string, {', '.join(f'{t} long' for t in TOTALS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, types = object(), None, None

        def written(h: dict) -> pa.RecordBatch:
            rows, state = [], START
            for k, (part, seq, ways) in enumerate(reversed(h["ways"])):
                to = ways[state]
                last = k == len(h["ways"]) - 1
                rows.append({"conv": h["conv"], "part": part, "seq": seq, "way": 4 * state + to, "tail": ending(to)[1] if last else ""})
                state = to
            gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["turns"]
            rows[0] |= {t: h[t] for t in TOTALS[1:-1]} | {"gaps": gaps, "cost": int(h["after"][START])}
            return pa.RecordBatch.from_pylist(rows, types)

        for batch in batches:
            types = types or pa.schema([("conv", batch.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int64()), ("way", pa.int32()), ("tail", pa.string()), *((t, pa.int64()) for t in TOTALS)])
            for row in batch.to_pylist():
                if held is None or row["conv"] != name:
                    if held is not None:
                        yield written(held)
                    name = row["conv"]
                    held = {"conv": name, "ways": [], "after": [ending(s)[0] for s in range(4)], "next": None, "low": None, "high": None, "turns": 0} | {t: 0 for t in TOTALS[1:-1]}
                costs = [math.inf if c is None else c for c in row["costs"]]
                way = [min(range(4), key=lambda to: (costs[4 * s + to] + held["after"][to], row["ranks"][4 * s + to])) for s in range(4)]  # noqa: B023
                held["after"] = [costs[4 * s + to] + held["after"][to] for s, to in enumerate(way)]
                held["ways"].append((row["part"], row["seq"], bytes(way)))
                for t in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    held[t] += row[t]
                if held["next"] and held["next"][0] != row["part"]:  # within a range the block counts its first row's border itself
                    held["illegal"] += row["last_role"] + held["next"][1] not in ("su", "ua", "au")
                    held["turns"] -= row["last_turn"] is not None and row["last_turn"] == held["next"][2]
                held["next"] = (row["part"], row["first_role"], row["first_turn"])
                held["low"] = row["low"] if row["low"] is not None else held["low"]
                held["high"] = row["last_turn"] if held["high"] is None else held["high"]
        if held is not None:
            yield written(held)

    lean = solved.select("conv", "part", "seq", "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "turns", "low", "first_role", "last_role", "first_turn", "last_turn")
    placed = lean.repartition(int(solved.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    ways = placed.mapInArrow(run, fields)
    return solved.select("part", "seq", "turn", "digest", "audits").join(ways, ["part", "seq"]).withColumn("audit", F.concat(F.element_at("audits", F.col("way") + 1), "tail")).drop("audits", "way", "tail")


@scoped
def audits(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation, a row for each block of it (most have one): conv, part, seq, turn, digest, audit; its first row (by part, seq) has the conversation's ``TOTALS``.

    A row's first fault counts: blank (no character but white space), duplicate
    (role and text are an earlier row's), truncated (the last character but
    white space isn't one of ``.!?``). Edits, by their letters: Keep, Rerole to
    user or assistant, Delete (which blank and duplicate rows need), Insert of
    an empty user or assistant row; they make the roles ``(s?(ua)+)?`` at the
    least cost (``COSTS``; a truncated row that stays costs more), and of
    several such audits the least in ASCII is taken. gaps: turns that are
    missing between the first and the last; illegal: neighbours whose roles
    don't follow each other.

    Rows of one turn are in the order of an MD5 of role and text; null turns
    come first and count for no gap; null roles and texts are one space; a null
    id is a conversation. Roles go by their first character, in lower case.
    Repeated rows are duplicates. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    blocks = materialize(_blocks(_ordered(df, conv_id, turn, role, text)), "blocks")
    patched = materialize(_without_late(blocks), "blocks")
    solved = materialize(join_spread(patched, _solved(patched), "signature", "held"), "solved")
    return materialize(_chosen(solved), "audits")


def repaired(df: DataFrame, edits: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, nth, role, text, edit): the rows of ``df`` after the ``edits`` that ``audits`` has found for it.

    nth counts a conversation's rows from 0; edit is K, R or I. Partitions hold
    whole conversations in order. A stream replays them: it holds a row and the
    audit of a block.
    """
    rows = small_batches(df)
    texts = _ordered(rows, conv_id, turn, role, text).withColumns({"kind": F.lit(1), "part": F.lit(0), "seq": F.lit(0).cast("long"), "audit": F.lit(None).cast("string")})
    marks = edits.select("conv", "turn", F.lit("").alias("role"), F.lit("").alias("text"), "digest", F.lit(0).alias("kind"), "part", "seq", "audit")
    both = texts.unionByName(marks)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "digest", "kind", "part", "seq"]
    placed = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv").sortWithinPartitions(*order)
    kind = placed.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, waiting, last, nth = object(), deque(), "", 0
        edit = iter(())
        begun = False

        def following() -> str | None:
            nonlocal edit
            while (e := next(edit, None)) is None and waiting:
                edit = iter(waiting.popleft())
            return e

        def put(out: list, e: str, role: str, text: str) -> None:
            nonlocal last, nth
            if e != "K":
                role = "assistant" if last == "u" else "user"
            out.append((name, nth, role, text if e != "I" else "", e))
            last, nth = role[:1], nth + 1

        def rest(out: list) -> None:
            while (e := following()) is not None:
                put(out, e, "", "")

        for batch in batches:
            out = []
            for conv, is_row, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if conv != name or not begun:
                    rest(out)
                    name, last, nth, begun = conv, "", 0, True
                if not is_row:
                    waiting.append(audit)
                    continue
                while (e := following()) == "I":
                    put(out, e, "", "")
                if e != "D":
                    put(out, e, role, text)
            yield _rows(out, batch.schema.field(0).type)
        if begun:
            out = []
            rest(out)
            yield _rows(out, batch.schema.field(0).type)

    def _rows(out: list, conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["conv", "nth", "role", "text", "edit"])

    return placed.select("conv", "kind", "role", "text", "audit").mapInArrow(run, f"conv {kind}, nth long, role string, text string, edit string")


def audit_table(edits: DataFrame) -> DataFrame:
    """(conv, ``TOTALS``, audit): a row for each conversation of ``audits``, whole audits."""
    sums = [F.max(t).alias(t) for t in TOTALS]
    parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"])
    return edits.groupBy("conv").agg(*sums, F.array_join(parts, "").alias("audit"))

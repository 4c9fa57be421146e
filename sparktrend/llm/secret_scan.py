"""Secret scanning with an incremental blob ledger.

Every historical version of a file is a blob named by the SHA-256 of its
UTF-8 text. The ledger is a Parquet table of (blob, rule, rule version,
findings); a scan reads only the pairs that the ledger lacks, appends them,
and joins findings back to every path that ever held the blob. A copied or
unchanged file costs a hash, and a new rule version rescans for that rule only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktrend.llm.common import discard, in_slots, materialize, small_batches

PACKED = "sha256 binary, blob binary"
LEDGER = "sha256 binary, rule string, version string, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    ``hints``: lower-case strings of which any matching text holds one.
    """

    name: str
    pattern: str
    group: int
    least: int
    ignore_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        """Changes with anything that changes the findings."""
        return hashlib.sha256(repr((self.pattern, self.group, self.least, self.ignore_case)).encode()).hexdigest()[:16]

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: In the order in which findings at one place are listed.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def scan_text(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[Rule, list[tuple[int, int]]]]:
    """Spans in code points, end exclusive, by rule."""
    lowered = text.lower()
    return [(r, [m.span() for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least] if not r.hints or any(h in lowered for h in r.hints) else []) for r, p in rules]


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unseen_pairs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """(sha256, todo): each distinct blob and the rules for which the ledger has no entry of this version."""
    blobs = versions.select(_sha(text).alias("sha256")).distinct()
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.select("sha256", every.alias("todo"))
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    seen = ledger.filter(F.col("version") == now[F.col("rule")]).groupBy("sha256").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.join(seen, "sha256", "left").select("sha256", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    return todo.filter(F.size("todo") > 0)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows for the blobs of ``versions``: one for each unseen (blob, rule version) pair.

    Texts travel compressed and once for each task that holds them; a hot blob
    is one row per task, not one per copy. With a ledger only those travel that
    ``in_slots`` can't tell from unseen ones. Null texts are empty blobs.
    """

    versions = small_batches(versions)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys, blobs = [], []
            for t in batch.column(0):
                raw = (t.as_py() or "").encode()
                key = hashlib.sha256(raw).digest()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    blobs.append(squeeze(raw))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["sha256", "blob"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, done = [(r, r.compiled()) for r in rules], set()
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            todos = batch.column(2) if batch.num_columns > 2 else None
            for i, (key, blob) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                if (key := key.as_py()) in done:
                    continue
                done.add(key)
                todo = compiled if todos is None else [x for x in compiled if x[0].name in todos[i].as_py()]
                out += [(key, r.name, r.version, [{"start": a, "end": b} for a, b in spans]) for r, spans in scan_text(expand(blob.as_py()).decode(), todo)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), strict=True)], names=["sha256", "rule", "version", "spans"])

    texts = versions.select(F.col(f"`{text}`").alias("text"))
    if ledger is None:
        return texts.mapInArrow(pack, PACKED).repartition("sha256").mapInArrow(scan, LEDGER)
    todo = materialize(unseen_pairs(versions, ledger, rules, text), "unseen")
    number = lambda sha: F.conv(F.substring(F.hex(sha), 1, 15), 16, 10).cast("long")
    some = in_slots(texts, number(_sha("text")), todo, number(F.col("sha256")))
    new = some.mapInArrow(pack, PACKED).join(todo, "sha256").repartition("sha256").mapInArrow(scan, LEDGER)
    new._reads = [todo]
    return new


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(path, findings) for every row of ``versions``: array<struct<start, kind index, kind, end>>, sorted.

    Findings are few; blobs without any don't enter the join. The join on a
    blob that very many paths hold is one that adaptive execution can split.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    now = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    entries = ledger.filter((F.size("spans") > 0) & (F.col("version") == now[F.col("rule")])).dropDuplicates(["sha256", "rule"])
    listed = entries.select("sha256", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("nth"), F.col("rule").alias("kind"), s["end"].alias("end"))).alias("found"))
    by_blob = listed.groupBy("sha256").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("findings"))
    paths = versions.select(F.col(path).alias("path"), _sha(text).alias("sha256"))
    return paths.join(by_blob.withColumnRenamed("sha256", "b"), F.col("sha256") == F.col("b"), "left").select("path", F.coalesce("findings", F.array().cast("array<struct<start:int,nth:int,kind:string,end:int>>")).alias("findings"))


def update_ledger(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it, and return the ledger."""
    spark = versions.sparkSession
    schema = spark.createDataFrame([], LEDGER).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.schema(schema).parquet(ledger_path) if exists else None
    new = scan_unseen(versions, known, rules, text)
    new.write.mode("append").parquet(ledger_path)
    discard(*getattr(new, "_reads", []))
    return spark.read.schema(schema).parquet(ledger_path)


def scan_history(versions: DataFrame, ledger_path: str, path: str = "doc_id", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date with ``versions``, then return ``findings_by_path``.

    Null texts are empty; null paths, repeated rows and extra columns are
    allowed (one output row for each input row); an empty table gives none.
    A run that fails before its commit leaves the ledger as it was. Two runs at
    once may both scan a blob, which repeats equal ledger rows and is harmless.
    """
    return findings_by_path(versions, update_ledger(versions, ledger_path, rules, text), path, rules, text)


def _sha(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))

"""The registered queries over the standard tables, and their SQL where SQL can express them.

Each query applies its operator to the whole table and derives the digest
columns that its contract names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrend.llm import alignment, ann, circulant, conversations, minhash, mixing, packing, pii, quality, secret_scan, simhash, token_count, toxicity
from sparktrend.llm.common import delete_path, materialize, scoped, shared_dir, table

#: The key of the PII queries. A real run takes its own from a secret store.
DEMO_KEY = "demonstration key"


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@scoped
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    # History comes in two commits, the earlier texts by the sign of a hash; the second run scans only blobs that the ledger lacks.
    secret_scan.update_ledger(docs.filter(F.xxhash64("text") < 0), ledger)
    found = materialize(secret_scan.scan_history(docs, ledger), "findings")
    delete_path(spark, ledger)
    spans = F.concat_ws(",", F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    # The ledger's method adds no spans of its own: all spans are base spans.
    return found.select(F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), 2048)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY, count="n_replaced")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"), simhash.Links(3, 2))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    lean = mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return lean.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults, dealt by a hash of conversation and turn: a row dropped, emptied, cut of its stops, repeated, or given to the user. Nulls count as one space in the hash."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    whole = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole)
    role = F.when(F.col("code") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.withColumn("code", code).filter("code <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """(k, repaired_sha256) of ``conversations.repaired``: the SHA-256 of a conversation's ``role:text``, newline-joined, in one pass over its rows, of which none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, kind = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([digest.hexdigest()])], names=["k", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, nth, role, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if not nth:
                    if digest is not None:
                        yield done()
                    name, digest = conv, hashlib.sha256()
                digest.update(("\n" * bool(nth) + role + ":" + text).encode())
        if digest is not None:
            yield done()

    return rows.select("conv", "nth", "role", "text").mapInArrow(run, f"k {rows.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


@scoped
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    broken = damaged(rows)
    edits = conversations.audits(broken)
    totals = conversations.audit_table(edits)
    hashes = repaired_digests(conversations.repaired(broken, edits))
    every = rows.select("conv_id").distinct()
    found = every.join(totals, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in conversations.TOTALS]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_toxicity, op3_packing, op4_pii, op5_simhash, op6_mixing, op7_token_count, op8_quality, op9_nearest, op10_minhash, op11_conversations, op12_alignment, op13_circulant)
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(nth, kind, p, grp, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]+', 0, 24)),
-- a rule's matches, and the text between them: their lengths give the places
raw AS (
  SELECT doc_id, nth, kind, least, t, CASE nth WHEN 0 THEN regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS ms,
   CASE nth WHEN 0 THEN regexp_extract_all(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)
    WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS vs,
   CASE nth WHEN 0 THEN regexp_split_to_array(t, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
    WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(t, '[0-9a-f]+') END AS gs
  FROM d, rules),
each AS (SELECT doc_id, nth, kind, least, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS k FROM raw WHERE len(ms) > 0),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, nth ORDER BY k) AS e FROM each),
spans AS (SELECT doc_id, nth, kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE length(v) >= least),
by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS k FROM documents),
b AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % 1024 AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1)::DOUBLE AS w FROM s),
f AS (SELECT *, 3 * source_size / w AS fill FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3 * source_size) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(w) OVER (ORDER BY fill, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, round(least(3.0::DOUBLE * source_size, (max(CASE WHEN level <= fill THEN level END) OVER ()) * w), 6) AS target,
  round((('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 4))::BIGINT::DOUBLE / 65535 - 0.5::DOUBLE) * 1.6::DOUBLE, 6) AS slope FROM l),
p AS (SELECT b.doc_id, b.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS goal,
  coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket, b.k, b.doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM p),
r AS (SELECT *, CASE WHEN size > 0 THEN passes * size + least(size, greatest(goal - passes * source_size - before, 0)) ELSE 0 END::BIGINT AS taken,
  least(before / greatest(target, 1e-9::DOUBLE), 1.0::DOUBLE) AS share FROM q)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(round(2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)), 9), 6) END AS position
FROM r
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
pairs AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = s.doc_id
"""


def op11_sql() -> str:
    """The cheapest edits by a recursion over each conversation's rows from the last to the first, with the best suffix of each of the grammar's four states."""
    after = {"s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}, "n": {"s": "s", "u": "u"}}  # n: nothing yet
    inserted = {"n": ("n", "u", "a"), "s": ("s", "u", "a"), "u": ("u", "a", "u"), "a": ("a", "u", "a")}

    def best(state: str) -> str:
        ways = []
        for k, at in enumerate(inserted[state]):
            front = "I" * k
            ways.append(f"{{'c': {5 * k + 2} + {at}c, 'a': '{front}D' || {at}a}}")
            for role, to in after[at].items():
                ways.append(f"{{'c': CASE WHEN must OR role <> '{role}' THEN 1000000000 ELSE {5 * k} + extra + {to}c END, 'a': '{front}K' || {to}a}}")
                if role != "s":
                    ways.append(f"{{'c': CASE WHEN must THEN 1000000000 ELSE {5 * k + 1} + extra + {to}c END, 'a': '{front}R' || {to}a}}")
        return f"list_sort([{', '.join(ways)}])[1] AS {state}_"

    return rf"""
WITH RECURSIVE crc(k, b, v) AS (SELECT k, 0, k::BIGINT FROM range(256) r(k) UNION ALL SELECT k, b + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE b < 8),
tab AS (SELECT list(v ORDER BY k) AS tab FROM crc WHERE b = 8),
given AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '~') AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS bytes FROM conversations),
coded AS (SELECT given.*, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 20 AS code FROM given, tab),
hurt AS (SELECT ck, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text), copy) AS i FROM hurt),
core AS (SELECT *, regexp_replace(text, '[ 	-]+$', '') AS core, row_number() OVER (PARTITION BY ck, role, text ORDER BY i) > 1 AS again, substr(role, 1, 1) AS initial FROM placed),
faults AS (SELECT *, CASE WHEN core = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY ck ORDER BY i) AS before FROM core),
sums AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faults GROUP BY ck),
dp(ck, i, nc, na, sc, sa, uc, ua, ac, aa) AS (
  SELECT ck, n + 1, 0, '', 10, 'II', 5, 'I', 0, '' FROM sums
  UNION ALL
  SELECT ck, i, n_.c, n_.a, s_.c, s_.a, u_.c, u_.a, a_.c, a_.a FROM (
    SELECT ck, i, {", ".join(best(x) for x in "nsua")} FROM (
      SELECT dp.ck, f.i, f.initial AS role, f.fault IN ('blank', 'duplicate') AS must, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS extra, nc, na, sc, sa, uc, ua, ac, aa FROM dp JOIN faults f ON f.ck = dp.ck AND f.i = dp.i - 1))),
done AS (SELECT ck, nc::BIGINT AS cost, na AS audit FROM dp WHERE i = 1),
edits AS (SELECT ck, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS k FROM done WHERE audit <> ''),
rows_ AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY ck ORDER BY k) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY ck ORDER BY k) AS j FROM edits),
kept AS (SELECT r.ck, k, e, j, f.role, f.text, f.initial FROM rows_ r LEFT JOIN faults f ON r.e <> 'I' AND f.ck = r.ck AND f.i = r.i WHERE e <> 'D'),
firsts AS (SELECT *, max(CASE WHEN j = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY ck) AS lead_ FROM kept),
shown AS (SELECT ck, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - lead_) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM firsts GROUP BY ck)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM given) g LEFT JOIN sums USING (ck) LEFT JOIN done USING (ck) LEFT JOIN shown USING (ck)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversations": op11_sql(), "op1_secret_scan": OP1_SQL, "op6_mixing": OP6_SQL, "op13_circulant": OP13_SQL}

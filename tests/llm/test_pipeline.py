"""The registered queries and the pipeline on the smallest tables."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sparktrend.llm import queries as llm
from sparktrend.llm import links, quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain_similar(texts):
    """Components of the texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, pair by pair."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    a, b = np.nonzero([[5 * len(x & y) >= 4 * len(x | y) for y in sets] for x in sets])
    return links.components(len(texts), a, b).tolist()


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_matches_sql(spark, name):
    got = llm.queries()[name](spark, DATA).toPandas()
    base = duckdb.connect()
    for t in ("documents", "conversations"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = base.execute(llm.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", [n for n in llm.queries() if n not in llm.oracle_sql() and n != "op9_nearest"])
def test_a_row_for_each_document(spark, name):
    rows = llm.queries()[name](spark, DATA).select("doc_id").toPandas()["doc_id"]
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows.nunique() == n and (name == "op3_packing" or len(rows) == n)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns, name
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.3").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        elif name == "pii":
            assert after.count() == before.count()
        else:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert len(packed) == len(corpus_pipeline.run(spark, DATA).collect())


#: Names that stages and operators use for columns of their own.
CLASHING = ["size", "target", "taken", "position", "positions", "source_size", "__quality", "__text", "__key", "__row", "__slot", "row", "key", "node", "component", "score", "length", "n"]


def odd_documents(spark):
    """Nulls in any column, empty, equal and very long texts, repeated rows, equal and null ids, clashing columns."""
    words = [f"word{i % 97}" for i in range(20_000)]
    long, some = " ".join(words), " ".join(words[:60])
    rows = [(1, some, "a"), (1, some, "a"), (1, "other text of one id with some more words", None), (None, some + " end", "b"), (None, "a lone text without an id but with words", None), (None, None, None), (2, None, "a"), (3, "", "a"), (4, " \n", "b"), (5, long, "a"), (6, long + " more", "b"), (7, "to joe@mail.example.com and 203-555-8282", "c")]
    full = [(*r, "en" if i % 2 else None, None if r[1] is None else len(r[1]), *[f"{c}{i}" if i % 3 else None for c in CLASHING]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_documents(spark, name):
    stage, df = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    rows = stage(spark, df, DATA).collect()
    if name == "packing":
        assert len(rows) >= df.count() and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
        assert stage(spark, df.limit(0), DATA).count() == 0
        return
    assert stage(spark, df, DATA).columns == df.columns == stage(spark, df.limit(0), DATA).columns
    assert stage(spark, df.limit(0), DATA).count() == 0
    before = [tuple(r) for r in df.collect()]
    after = [tuple(r) for r in rows]
    if name == "pii":
        changed = [(a, b) for a, b in zip(sorted(before, key=repr), sorted(after, key=repr), strict=True) if a != b]
        assert len(changed) == 1 and changed[0][0][0] == 7 and changed[0][0][2:4] == changed[0][1][2:4]
    else:
        assert all(r in before for r in after)  # whole rows, in all columns
    if name == "quality":
        kept = Counter(r[1] for r in after)
        assert all(kept[t] in (0, n) for t, n in Counter(r[1] for r in before).items())
    if name == "simhash_near_dedup":
        assert sorted((r[0] or 0, (r[1] or "")[:9]) for r in after) == [(0, "a lone te"), (1, "other tex"), (1, "word0 wor"), (2, ""), (5, "word0 wor"), (7, "to joe@ma")]
    if name == "mixing":
        assert all((r[1] or "").split() for r in after) and sorted(map(repr, after)) == sorted(repr(tuple(r)) for r in stage(spark, df.repartition(3), DATA).collect())


def test_near_duplicates_of_a_stage_against_brute_force(spark):
    """The kept documents of the test tables are those that a pairwise comparison keeps."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    ids = sorted(texts)
    want = plain_similar([texts[i] for i in ids])
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, df, DATA).collect()}
    assert kept == {ids[k] for k in set(want)}

"""The fitted operators' scores against plain Python, bounds of their fits, clashing names, and what is left on disk."""

import math
import re
from collections import Counter
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

from sparktrend.llm import alignment, common, mixing, packing, pii, quality, queries, token_count, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a a a a", "ÜBER 12 ½ €5 🙂 {x} <b>", "line\nline\nline", "  lead and trail  ", "word " * 30_000, "x" * 100_000, "damn\tdamn\r\nNo"]


def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id")], "doc_id long, text string")
    return given.unionByName(odd)


def plain_statistics(text):
    t = text or ""
    n, w, lines = max(len(t), 1), max(len(re.findall(r"[^\x20\x09-\x0D]+", t)), 1), t.split("\n")
    gap = r"[ \t\n\x0b\f\r]"
    count = lambda p: sum(1 for _ in regex.finditer(p, t))
    tokens = re.split(r"[\x20\x09-\x0D]+", t)
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    short = sum(regex.fullmatch(r"\p{L}{1,3}", x) is not None for _, _, x in words)
    repeats = sum(a[2] == b[2] and t[a[1] : b[0]] == " " for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(w), n / w, count(r"\p{Lu}") / n, count("[0-9]") / n, count("[.,;:?]") / w, count(r"[!#$%&*|@^~<>=+\\{}\[\]]") / w, short / w, repeats / w,
        len(set(tokens)) / w, len(set(lines)) / len(lines), math.log1p(w / len(lines)), sum(1 for c in t if not regex.match(r"\p{L}|\p{N}|\p{P}", c) and not re.match(gap, c)) / n,
    ]


def test_statistics_and_compiled_rules_equal_plain_python(spark):
    docs = rows(spark)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.rules
    found = quality.score(docs.withColumn("stats", quality.statistics(F.col("text"))), model).collect()
    for r in found:
        want = plain_statistics(r["text"])
        assert r["stats"] == pytest.approx(want, rel=1e-12), (r["doc_id"], r["text"] and r["text"][:50])
        total = model.bias
        for conditions, weight in model.rules:
            if all((want[quality.NAMES.index(name)] > cut) == above for name, above, cut in conditions):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)


def test_toxicity_scores_equal_plain_python(spark):
    docs = rows(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), least_texts=2, least_gain=1.0)
    assert model.weights
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    found = toxicity.score(docs.orderBy("doc_id"), model).collect()
    assert len(found) == len(texts)
    for r, text in zip(found, texts, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        n = Counter()
        for w in words:
            for f in {w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k)}:
                n[f] += f in model.weights
        latent = sum(weight * math.log1p(n[f]) for f, weight in model.weights.items())
        above = [1 / (1 + math.exp(-max(-40, min(40, latent - t)))) for t in model.thresholds]
        grades = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert r["p_toxic"] == pytest.approx(above[0], rel=1e-9) and r["expected_severity"] == pytest.approx(sum(above), rel=1e-9)
        assert grades[r["severity"]] == pytest.approx(max(grades)) and r["toxic"] == (above[0] >= model.cutoff)


def test_selected_features_and_their_order_equal_plain_python(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["toxic"] is not None and r["doc_id"] in by_id]
    n1 = sum(y for _, y in known)
    base, have = n1 / len(known), {}
    for d, y in known:
        for f in {f for w in toxicity.text_words(by_id[d] or "") for f in toxicity.word_features(w)}:
            have.setdefault(f, [0, 0])[y] += 1
    gains = {}
    for f, (k0, k1) in have.items():
        n = k0 + k1
        rate = (k1 + 0.5 * base) / (n + 0.5)
        if n >= 2 and (gain := round(n * (rate * math.log(rate / base) + (1 - rate) * math.log((1 - rate) / (1 - base))), 6)) >= 1:
            gains[f] = gain
    want = sorted(gains, key=lambda f: (-gains[f], f))[:40]
    model = toxicity.fit(docs, labels, vocabulary=40, least_texts=2, least_gain=1.0)
    assert set(model.weights) <= set(want) and len(model.weights) >= 0.9 * len(want)


def test_fits_are_bounded_whatever_repeats(spark, monkeypatch):
    many = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some bad words "), (F.col("id") % 50).cast("string")).alias("text")).unionByName(spark.range(60_000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("good prose here").alias("text")))
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_rules", lambda names, x, y, **k: seen.append(len(x)))
    quality.fit(many, labels)
    monkeypatch.setattr(toxicity, "fit_cumulative_link", lambda x, grade, levels, **k: seen.append(len(x)) or (x[0] * 0.0, [0.0, 1.0, 2.0]))
    toxicity.fit(many, labels, least_texts=1, least_gain=0.0)
    assert max(seen) <= 3


def clashing(spark):
    """Documents with a column for every helper name in the operators' sources."""
    names = sorted({n.lower() for p in Path(common.__file__).parent.glob("*.py") for n in re.findall(r"\"(__\w+?)_*\"", p.read_text()) if "{" not in n})
    assert "__text" in names or len(names) > 10
    texts = ["my password = hunter22 here", "", None, "mail a@example.com now", "the same text again", "the same text again", " ".join(f"w{i}" for i in range(3000))]
    base = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    more = ["size", "key", "n", "row", "group", "node", "fp", "bits", "block", "chunk", "pairs", "times", "position", "score", "piece"]
    return base, base.withColumns({n: F.lit("x") for n in [*names, *more, *(f"__{m}" for m in ("size", "source", "key", "bucket", "tie", "before", "base", "target", "total", "bend", "of", "at", "take", "slope", "s", "b"))]})


MIX = ("doc_id", "taken", "target")
OPERATORS = {
    "mixing": lambda d: mixing.curriculum_mix(d).select(*MIX), "order": lambda d: mixing.training_order(d, whole=True).select("doc_id", "position"),
    "tokens": lambda d: token_count.count_tokens(d, queries.vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens"), "pii": lambda d: pii.pseudonymise(d, "k").select("doc_id", "text"),
    "quality": lambda d: quality.score(d, quality.RuleModel(0.1, (((("digits", True, 0.0),), 0.5),))).select("doc_id", "score"), "packing": lambda d: packing.pack_documents(d, queries.vocabulary("word_bpe_49k.json"), 2048).select("doc_id", "piece", "length"),
    "toxicity": lambda d: toxicity.score(d, toxicity.OrdinalModel({"same": 1.0}, (0.5, 1.0))).select("doc_id", "severity"), "alignment": lambda d: alignment.align(d, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")).select("doc_id", "n_links", "count_sum"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_helper_name_do_no_harm(spark, name):
    base, more = clashing(spark)
    one, other = (sorted(map(tuple, OPERATORS[name](d).collect()), key=str) for d in (base, more))
    assert one == other


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_toxicity", "op3_packing", "op5_simhash", "op6_mixing", "op9_nearest", "op10_minhash", "op11_conversations", "op12_alignment", "op13_circulant"])
def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(queries, "shared_dir", lambda spark: str(tmp_path))
    found = queries.queries()[name](spark, SF)
    read = {Path(f).parent.name for f in found.inputFiles()}
    assert {p.name for p in tmp_path.iterdir()} <= read
    assert found.count() >= 0


def test_a_failing_operator_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))

    @common.scoped
    def fails(df):
        common.materialize(df, "left")
        raise RuntimeError("no")

    @common.scoped
    def outer(df):
        @common.scoped
        def inner(df):
            common.materialize(df, "unread")
            return common.materialize(df, "read")

        one = inner(df)
        assert len(list(tmp_path.iterdir())) == 1
        return common.materialize(one, "last")

    with pytest.raises(RuntimeError):
        fails(spark.range(3))
    assert not list(tmp_path.iterdir())
    assert outer(spark.range(3)).count() == 3 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["last"]

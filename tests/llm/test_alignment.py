"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np

from sparktrend.llm import alignment, queries

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def two_pointers(lengths_a, lengths_b):
    """Groups as (A tokens, B tokens), each a list of places."""
    groups, i, j, end_a, end_b, own = [], 0, 0, 0, 0, ([], [])
    while i < len(lengths_a) or j < len(lengths_b):
        if end_a <= end_b and i < len(lengths_a):
            own[0].append(i)
            end_a += lengths_a[i]
            i += 1
        else:
            own[1].append(j)
            end_b += lengths_b[j]
            j += 1
        if end_a == end_b:
            groups.append(own)
            own = ([], [])
    return groups


def plain(rows):
    """The contract's rows for (doc_id, text)."""
    known = alignment.tokenizers(A, B)
    docs = []
    for doc, text in rows:
        a = known.a.encode(" " + (text or ""), add_special_tokens=False).ids if known.ids(text)[0] else []  # the library's own
        b = known.ids(text)[1]
        groups = two_pointers([len(known.bytes_a[i]) for i in a], [len(known.bytes_b[i]) for i in b])
        links = Counter((a[i], b[j]) for x, y in groups for i in x for j in y)
        shown = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        docs.append((doc, len(a), len(b), len(groups), links, shown))
    count = Counter(pair for d in docs for pair in d[4])
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(((doc, n_a, n_b, n, sum(links.values()), sum(k for p, k in links.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in links.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else "") for doc, n_a, n_b, n, links, shown in docs), key=str)


ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "tokenization of <|endoftext|> and <s> </s> <unk>"), (6, "Ünïcode ĐŽ 你好 🙂 é"), (7, "a▁b"), (8, "tabs\tand\nlines  two  spaces "), (9, "dup dup dup"), (9, "dup dup dup"), (None, "no id here"), (None, None), (10, "🙂" * 300), (11, "\x00\x01<0x41>")]


def run(spark, rows, schema="doc_id long, text string"):
    found = alignment.align(spark.createDataFrame(rows, schema), A, B, digest=True).collect()
    return sorted((tuple(r)[:7] + (r["groups"],) for r in found), key=str)


def test_odd_texts_equal_the_plain_version(spark):
    want = plain(ODD)
    assert run(spark, [(d, t, 1, "x") for d, t in ODD], "doc_id long, text string, chunk int, pairs string") == want
    by_id = {r[0]: r for r in want if r[0] is not None}
    assert by_id[1][1:] == by_id[2][1:] == by_id[7][1:] == (0, 0, 0, 0, 0, 0, "")  # no text, or one that a tokenizer changes
    assert by_id[5][1] > 10


def test_the_query_equals_the_plain_version_on_the_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    found = sorted((tuple(r)[:7] + (r["groups_sha256"],) for r in queries.op12_alignment(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == plain(rows)


def test_chunks_do_not_change_results(spark, monkeypatch):
    texts = [(i, " ".join(["one", "Two", "thréé", "fourteen", "ünd"][(i * k) % 5] for k in range(1 + i % 9))) for i in range(60)]
    want = plain(texts)
    monkeypatch.setattr(alignment, "CHUNK", 10)
    monkeypatch.setattr(alignment, "LARGE", 1)
    assert run(spark, texts) == want


def test_a_group_of_many_tokens(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 3000), rng.integers(0, 40, 2000)
    groups = alignment.Groups(np.zeros(3000, int), np.zeros(2000, int), np.array([3000]), np.array([2000]))
    codes, times = groups.pairs(a, b)
    want = Counter((int(x), int(y)) for x in a for y in b)
    assert {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(n) for c, n in zip(codes, times, strict=True)} == want and groups.links() == 6_000_000


def test_the_faster_encoder_gives_the_librarys_ids():
    known = alignment.tokenizers(A, B)
    import pyarrow.parquet as pq

    assert known.ranked is not None
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    rng = np.random.default_rng(0)
    signs = list("abcdefgh ABC  \n\t.,'’-_0123éüßñªº²¼×\u00a0\u00ad") + ["'s", "'ll", " the", "ing", "\r\n", "<|endoftext|>", "\u0249"]
    made = ["".join(rng.choice(signs, int(rng.integers(1, 80)))) for _ in range(3000)]
    odd = ["a\x1cb", "你好", "🙂🙂", "\x85 x", "\u2003 y", "é\u0301"]
    for t in [*texts, *made, *odd]:
        want = known.a.encode(" " + t, add_special_tokens=False).ids
        assert known.ids(t)[0] in (want, []), t[:80]
    assert sum(known.ids(t)[0] != [] for t in made) > 2900


def test_the_faster_encoder_is_refused_without_proof(tmp_path):
    import json

    spec = json.loads(open(A).read())
    spec["model"]["merges"][0], spec["model"]["merges"][1] = spec["model"]["merges"][1], spec["model"]["merges"][0]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert alignment.Tokenizers(str(tmp_path / "other.json"), B).ranked is None


def test_packing_of_numbers_goes_round():
    for x in ([], [0], [5, 5, 5], [1, 1 << 40, (1 << 62) + 3]):
        assert alignment.expand(alignment.squeeze(np.array(x, np.int64))).tolist() == x


def test_an_empty_table_a_very_long_text_and_shown_groups(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    rows = [(1, "supercalifragilistic " * 40_000)]
    assert run(spark, rows) == plain(rows)
    shown = alignment.align(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), A, B).collect()[0]["groups"]
    assert shown.count("|") == shown.count(";") + 1 == 2

"""Circulant MinHash against brute force."""

import numpy as np
import pytest

from sparktrend.llm import circulant, queries

VOCABULARY = [f"w{i}" for i in range(400)]


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if len(words) <= 4:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs; ids are distinct."""
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    ids = sorted(sets)
    going = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while going:
        going = False
        for a, b in links:
            low = min(label[a], label[b])
            going |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted((d, len(sets[d]), label[d], label[d] == d) for d in ids)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, key string, n int")
    return sorted(tuple(r) for r in circulant.near_duplicates(df).collect())


def made_up(seed, families=25):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(families):
        words = list(rng.choice(VOCABULARY, int(rng.integers(4, 120))))
        for _ in range(int(rng.integers(1, 6))):
            own = words.copy()
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = str(rng.choice(VOCABULARY))
            rows.append(" ".join(own))
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    odd = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "a b c d", "a b c d e", "dup dup dup dup dup dup", "dup dup dup dup", "Ünï 你好 🙂 é ü"]
    rows = made_up(seed)
    rows += [(1000 + i, t) for i, t in enumerate(odd)]
    assert run(spark, rows) == brute(rows)


def test_the_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_circulant(spark, "/root/testdata/sf0.001").collect()) == brute(rows)


def test_the_border_of_the_similarity(spark):
    base = [f"x{i}" for i in range(103)]  # 100 shingles
    near = [*base[:92], *[f"y{i}" for i in range(11)]]  # 89 in common of 111: over 0.8
    far = [*base[:91], *[f"z{i}" for i in range(12)]]  # 88 of 112: below
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert run(spark, rows) == brute(rows) and [r[2] for r in brute(rows)] == [1, 1, 3]


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    text = " ".join(VOCABULARY[:40])
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text + " more"), (None, "alone here")], "doc_id long, text string")
    found = sorted((tuple(r) for r in circulant.near_duplicates(df).collect()), key=str)
    assert found == sorted([(None, 37, 3, False), (5, 37, 3, False), (5, 37, 3, False), (3, 38, 3, True), (None, 1, None, False)], key=str)


def test_a_large_group_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(8)
    base = list(rng.choice(VOCABULARY, 150))
    rows = [(i, " ".join(base)) for i in range(700)]
    for i in range(700, 1400):
        own = base.copy()
        own[int(rng.integers(150))] = f"n{i}"
        rows.append((i, " ".join(own)))
    found = run(spark, rows)
    assert {r[2] for r in found} == {0} and [r[0] for r in found if r[3]] == [0]


def test_coordinates_estimate_the_similarity_and_the_ring_is_turned():
    orders = circulant.turned_orders()
    assert orders.shape == (circulant.RING, circulant.SLOTS) and (orders[1, :-1] == orders[0, 1:]).all() and orders[-1, 1] == orders[0, 0]
    place = circulant.places(np.arange(circulant.RING, dtype=np.uint64))
    assert len(np.unique(place)) == circulant.RING  # a permutation
    rng, errors = np.random.default_rng(4), []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        one, other = circulant.signature(both[:900]), circulant.signature(both[100:])
        errors.append((one == other).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.045


def test_a_very_long_text(spark):
    words = " ".join(f"v{i % 70_001}" for i in range(300_000))
    rows = [(1, words), (2, words + " end"), (3, "short one")]
    found = run(spark, rows)
    assert [r[2] for r in found] == [1, 1, 3] and found[0][1] == 70_001


def test_components_by_rounds_equal_those_of_one_task(spark, monkeypatch):
    from sparktrend.llm import links

    rng = np.random.default_rng(0)
    edges = [(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 300, (260, 2)) if a != b] + [(k + 1, k) for k in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long").distinct()
    one = {r["id"]: r["component"] for r in links.linked_components(df).collect()}
    monkeypatch.setattr(links, "FINISHED", 0)
    rounds = {r["id"]: r["component"] for r in links.linked_components(df).collect()}
    assert one == {k: v for k, v in rounds.items() if k != v} and one[1040] == 1000

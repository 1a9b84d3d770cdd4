import random
import re
from math import comb

import numpy as np
import pytest
import xxhash

from obsforge.llm import graph
from obsforge.llm import op4_simhash as op
from obsforge.llm.common import Durable
from obsforge.llm.graph import connected_components


def components(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("small", [20_000, 0])
def test_components_against_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Durable(spark)).collect()}
    nodes = sorted({x for e in edges for x in e})
    pairs = {frozenset(e) for e in edges}
    want = components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    want = {n: nodes[w] for n, w in zip(nodes, want, strict=True)}
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(nodes) - set(got) <= {7}


@pytest.mark.parametrize("crowd", [3, 20])
def test_links_of_random_and_crowded_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(op, "CROWD", crowd)
    rng = np.random.default_rng(5)
    far = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 5))))) for b in base for _ in range(130)]
    fps = sorted({int(x) for x in far} | {int(x) for x in near})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    durable = Durable(spark)
    edges = durable.keep(op.linked(spark.createDataFrame(rows, "fp long, name long"), durable), "e")
    for a, b in edges.collect():
        assert (fps[a] ^ fps[b]).bit_count() <= 2
    got = {r.node: r.component for r in connected_components(edges, durable).collect()}
    want = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_dynamic_programming_finds_the_cheapest_thresholds():
    rng = np.random.default_rng(1)
    costs = np.concatenate([np.zeros((50, 3, 1)), np.sort(rng.random((50, 3, 3)) * 99, axis=2)], axis=2)
    got, cost = op.allocate(costs, 0)
    ways = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    assert (got.sum(1) == 0).all()
    assert np.allclose(cost, [min(sum(r[i, t + 1] for i, t in enumerate(w)) for w in ways) for r in costs])


def test_groups_of_edge_cases(spark):
    text = "one two three four five six seven eight nine ten " * 4
    rows = [(5, text, "x"), (3, text.upper(), "x"), (9, None, "y"), (8, "", "y"), (7, " \n\t", None), (7, " \n\t", None), (None, text, None), (1, "other words " * 9, None), (None, "alone here now", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op.simhash_groups(docs).collect()), key=str)
    ids = [(d, c) for d, _, c in got]
    assert sorted(ids, key=str) == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (7, 7), (None, 3), (1, 1), (None, None)], key=str)
    assert {f for d, f, _ in got if d in (7, 8, 9)} == {"0" * 16}
    kept = op.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 1, None], key=str)
    assert op.keep_first(docs.limit(0)).count() == 0
    assert op.simhash_groups(docs.where("doc_id > 100")).count() == 0


def brute_fingerprint(text, width=3):
    """By the definition, a shingle at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_the_definition(spark):
    rng = random.Random(11)
    texts = ["", " \t", "One", "Éa TWO", "a b c", "ÀB\u00a0c d", "x\x0by z w"] + [" ".join(rng.choice(["Alpha", "beta", "γ", "d\x85e", "中文", "f,"]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: int(r.fingerprint, 16) for r in op.simhash_groups(docs).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_the_number_of_partitions_follows_the_size():
    """Even bits: three partitions for millions, two for billions, and the thresholds stay cheaper than one word's 65."""
    for n, partitions in ((10_000, 3), (10**7, 3), (10**8, 2), (10**9, 2)):
        both = np.full((64, 64), n / 4) + np.diag(np.full(64, n / 4))
        groups = op.choose_groups(n, both)
        assert len(groups) == partitions and sorted(b for g in groups for b in g) == list(range(64))
        widths = [len(g) for g in groups]
        costs = np.array([[[0] + [sum(comb(w, k) * (1 + n / 2**w) for k in range(t + 1)) for t in range(3)] for w in widths]])
        assert op.allocate(costs, 3 - partitions)[1][0] <= 65
    skewed = np.outer(np.full(64, 0.95), np.full(64, 0.95)) * 10**6 + np.diag(np.full(64, 0.0475)) * 10**6
    assert len(op.choose_groups(10**6, skewed)) == 2  # uneven bits tell less apart


@pytest.mark.parametrize("partitions", [2, 4])
def test_links_by_other_numbers_of_partitions(spark, partitions):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, int(rng.integers(0, 4))))) for b in base for _ in range(4)})
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    durable = Durable(spark)
    edges = {tuple(sorted(r)) for r in op.linked(spark.createDataFrame(rows, "fp long, name long"), durable, partitions).collect()}
    assert edges == {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}

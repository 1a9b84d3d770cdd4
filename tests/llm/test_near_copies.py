import random

import numpy as np
import pytest

from obsforge.llm import near_copies, op4_simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The keys that stay: the first of each component of pairs with a Jaccard similarity of 0.8."""
    keys = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingle_set(t) for _, t in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((keys[i] for i in range(len(keys)) if find(i) == i), key=str)


@pytest.mark.parametrize("crowd, pivots, rounds, told", [(32, 3, 1, 200_000), (2, 2, 1, 200_000), (2, 0, 0, 0), (2, 1, 2, 0)])
def test_near_copies_against_all_pairs(spark, monkeypatch, crowd, pivots, rounds, told):
    """Copies with a word changed are mostly more than two bits apart, and all but one of a group go."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", told)
    rng = random.Random(7)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + i, passage + " " + " ".join(f"q{rng.randrange(900)}" for _ in range(30))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in op4_simhash.keep_first(docs).collect()), key=str) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, "the clean one with the same id"), (3, text.upper()), (None, text), (None, "alone here"), (None, "alone here"), (9, None), (8, ""), (7, " \t"), (7, " \t")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string")
    kept = op4_simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = [(3, text.upper(), "x"), (5, "the clean one with the same id", "x"), (7, " \t", "x"), (None, "alone here", "x")]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert op4_simhash.keep_first(docs.limit(0)).count() == 0


def test_sketches_bound_what_parts_two_sets(spark):
    """Never more bits than shingles part them, also where sets of other sizes have sketches of other lengths."""
    rng = np.random.default_rng(2)
    rows, want = [], []
    for n in (1, 3, 60, 64, 65, 120, 130, 500, 520, 4000, 4100):
        for gone in (0, 1, n // 10):
            a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            b = np.concatenate([a[gone:], rng.integers(-(1 << 63), 1 << 63, n // 9)])
            rows.append((near_copies.sketch(a).tolist(), near_copies.sketch(b).tolist()))
            want.append(len(set(a.tolist()) ^ set(b.tolist())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r.p for r in df.coalesce(1).select(near_copies.parted(df.a, df.b).alias("p")).collect()]
    assert all(0.6 * w <= p <= w and (w - p) % 2 == 0 for p, w in zip(got, want, strict=True))


def test_fingerprints_find_the_closest_pairs(spark):
    """What fingerprints link is looked at first; without them the groups are the same."""
    from obsforge.llm.common import Durable

    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(400)]
        for _ in range(4):
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(near_copies.key(docs.doc_id, docs.text).alias("k"), "text")
    durable = Durable(spark)
    nodes = durable.keep(near_copies._rows(keyed, *near_copies._common(keyed)).dropDuplicates(["node"]), "n")
    assert op4_simhash.set_links(nodes, durable).count() >= 10
    for near in (op4_simhash.set_links, None):
        members, groups = near_copies.groups(keyed, Durable(spark), near)
        assert members.join(groups, "node").groupBy("component").count().where("count = 4").count() == 12


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w5000 ", "other ")), (3, "x" * 300_000)], "doc_id long, text string")
    assert sorted(r.doc_id for r in op4_simhash.keep_first(docs).collect()) == [1, 3]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash.simhash_groups(docs).collect()}
    assert got[2][1] == 1 and got[3][1] == 3

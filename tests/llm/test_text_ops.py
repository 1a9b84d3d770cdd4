"""Quality rules, classifier, token store, packing, secrets: against brute force and over odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsforge.llm import op5_rules, op6_tokens, op8_packing, op9_quality
from obsforge.llm.textstats import COUNTS, FEATURES, labelled, repeated_words, statistics
from obsforge.llm.tokens import WordEncoder, vocabulary

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a few words stand here"), (4, "x" * 300_000), (5, "tie"), (5, "tie"), (6, "ünï cödé 中文 " * 20), (7, "line one two\n" * 400), (8, '<|endoftext|> it\'s "quoted" 123 á b')]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, score string, kept int")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)})


def test_statistics_against_definitions():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "cé ", "# ", "|", "\n", "\t", "dd ", "\x0b", "中"]) for _ in range(rng.randrange(90)))
        words = words_of(text)
        lines = [x for x in text.split("\n") if words_of(x)]
        got = statistics(text.encode())
        assert got[:5] == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute_repeats(words))
    assert repeated_words([b"a"] * 7) == 7
    assert repeated_words([b"a"] * 5) == 0


def test_isolation_forest_finds_far_rows():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (900, 3)), rng.normal(9, 1, (30, 3))
    x, y = np.vstack([good, bad]), np.array([True] * 900 + [False] * 30)
    forest = op5_rules.IsolationForest.grow(x).calibrate(x, y)
    score = forest.anomaly(x)
    assert (score[~y] > forest.threshold).mean() > 0.95
    assert (score[y] <= forest.threshold).mean() > 0.95
    assert op5_rules.IsolationForest.grow(x[:0]).calibrate(x[:0], y[:0]).threshold == np.inf


def test_path_lengths_against_walking_each_tree():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (600, 4))
    forest = op5_rules.IsolationForest.grow(x)

    def walk(tree, row):
        f, cut, left, right = tree
        at = depth = 0
        while f[at] >= 0:
            at = int(left[at]) if row[f[at]] < cut[at] else int(right[at])
            depth += 1
        return depth, left[at]

    for row in x[:40]:
        walked = [walk(t, row) for t in forest.trees]
        assert all(path >= depth for depth, path in walked)  # a leaf adds what a tree of its rows would take
        want = 2 ** (-np.mean([path for _, path in walked]) / op5_rules.expected_path(op5_rules.SUBSAMPLE))
        assert forest.anomaly(row[None])[0] == pytest.approx(want)
    # The expected path of a random search tree of n values, by its recurrence.
    total, n = [0.0, 0.0], 400
    for k in range(2, n + 1):
        total.append(1 + sum(i * total[i] + (k - i) * total[k - i] for i in range(1, k)) / (k - 1) / k)
    assert op5_rules.expected_path(n) == pytest.approx(total[n], rel=0.02)


def test_quality_rules_over_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0), (6, 1), (6, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = op5_rules.quality_rules(odd, op5_rules.fit(odd, labels)).collect()
    assert len(got) == len(ODD)
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)
    assert op5_rules.quality_rules(odd.limit(0), op5_rules.IsolationForest([])).count() == 0


def test_every_labelled_row_grows_the_forest_and_sets_its_threshold(spark):
    """More labels than any sample of 20,000; the one row with an exclamation mark is the last that a sample by hash takes."""
    n = 30_000
    last = spark.range(n).orderBy(F.xxhash64("id").desc()).first().id
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("word", "Word", "WORD")) + str(j) for j in range(12)) + "!" * (i == last), int(rng.random() < 0.8)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    forest = op5_rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    at = op5_rules.STATISTICS.index("exclaims_per_word")
    assert any(at in f for f, *_ in forest.trees) and len(forest.trees) == op5_rules.TREES
    picked = [len(COUNTS) + FEATURES.index(c) for c in op5_rules.STATISTICS]
    x = np.array([statistics(text.encode()) for _, text, _ in rows])[:, picked]
    again = op5_rules.IsolationForest(forest.trees, rows=forest.rows).calibrate(x, np.array([y == 1 for *_, y in rows]))
    assert forest.threshold == again.threshold


def test_forest_on_rows_that_it_is_not_calibrated_on(spark):
    """Labels of four folds set the threshold, those of the fifth tell how it does."""
    d = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forest = op5_rules.fit(documents, labels.where(~fold))
    judged = op5_rules.quality_rules(documents.join(labels.where(fold).select("doc_id"), "doc_id", "left_semi"), forest).join(labels, "doc_id").where("not base_failed")
    got = {(r.quality, r.kept): r.n for r in judged.groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = (sum(n for (q, _), n in got.items() if q == k) for k in (1, 0))
    assert got.get((1, True), 0) >= 0.95 * good and got.get((0, False), 0) >= 0.9 * bad and bad >= 20


def test_rule_ensemble_learns_and_compiles(spark):
    rng = np.random.default_rng(1)
    x = rng.random((1500, len(op9_quality.FEATURES)))
    y = ((x[:, 2] < 0.6) & (x[:, 5] < 0.7)).astype(float)
    model = op9_quality.learn(x[:1000], y[:1000])
    assert 0 < len(model.rules) < 120
    assert ((model.margin(x[1000:]) > 0) == (y[1000:] > 0)).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in op9_quality.FEATURES))
    got = [r.s for r in df.select(model.column().alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-model.margin(x[:50]))))
    assert op9_quality.learn(x[:0], y[:0]).rules == []
    assert op9_quality.learn(x[:5], np.ones(5)).margin(x[:1])[0] > 0


def test_first_split_against_all_splits():
    """The first path of the first tree holds the split with the highest gain of all."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 3))
    y = (x[:, 1] + 0.2 * rng.random(300) > 0.6).astype(float)
    g = y - 0.5
    best = None
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, op9_quality.BINS + 1)[1:-1])):
            left = x[:, f] <= cut
            if op9_quality.MIN_LEAF <= left.sum() <= 300 - op9_quality.MIN_LEAF:
                gain = sum(g[side].sum() ** 2 / (0.25 * side.sum() + 1) for side in (left, ~left))
                if best is None or gain > best[0]:
                    best = (gain, f, float(cut))
    assert op9_quality.grow_rules(x, y)[0] == ((best[1], -np.inf, best[2]),)
    for rule in op9_quality.grow_rules(x, y):  # a rule is the conjunction of its bounds
        want = [all(low < row[f] <= high for f, low, high in rule) for row in x]
        assert op9_quality.holds(rule, x).tolist() == want and sum(want) >= op9_quality.MIN_LEAF


def test_lasso_weights_are_optimal():
    """The conditions of the least penalised loss hold: no weight can be moved for the better."""
    rng = np.random.default_rng(6)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    for penalty in (2e-3, 0.05, 0.6):
        w, b = op9_quality.lasso(z, y, penalty, steps=4000)
        r = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = z.T @ r / len(y)
        assert abs(r.mean()) < 1e-5
        assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)
        assert (np.abs(slope[w == 0]) <= penalty + 1e-5).all()
    assert (w == 0).all()


def test_quality_query_on_held_out_rows(spark):
    """Labels that the model has not seen, against its scores; no row of a null id is held out."""
    d = "/root/testdata/sf0.01"
    import pyarrow.parquet as pq

    got = {r.doc_id: r for r in op9_quality.op9_quality(spark, d).collect()}
    seen = [(r["quality"], got[r["doc_id"]]) for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(seen) >= 40 and all(r.held_out for _, r in seen)
    assert sum(r.predicted == q for q, r in seen) >= 0.95 * len(seen)


def test_classifier_over_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0), (6, 1), (7, 0), (8, 1)], "doc_id long, quality int")
    model = op9_quality.fit(odd, labels)
    rows = op9_quality.score(odd, model, "doc_id").collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = op9_quality.keep_good(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert op9_quality.keep_good(odd, model, 1.1).count() == 0


def test_word_encoder_equals_tokenizer():
    e = WordEncoder(vocabulary("word_bpe_49k.json"), room=40)
    assert e.pieces is not None
    rng = random.Random(4)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCÀÉÖßé", ".,!?*'\"-_", "0123456789", "中文字", "́İΣς", "  \x85\x1c ", " \n\t"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(40))) for _ in range(1500)] + [t for _, t in ODD if t]
    texts += ["ab" * 400 + "!" * 300 + " short " + "ab" * 400, "é" * 500]
    for t in texts:
        assert list(np.frombuffer(e.encode(t.encode()), "<u4")) == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert max(map(len, [*e.known, *e.parts])) <= 256  # long words are not kept


def test_differencing_is_near_equal_and_complete():
    rng = random.Random(6)
    for _ in range(20):
        sizes = [rng.randrange(1, 900) for _ in range(rng.randrange(1, 120))]
        groups = op8_packing.partition(sizes, 1000)
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        assert max(sums) <= 1000
        if len(sizes) > 6 * len(groups):
            assert max(sums) - min(sums) <= max(sizes)


def test_blocks_of_tiny_pieces_are_bundled():
    rng = random.Random(8)
    for sizes in ([1] * 262_144, [4] * 65_536, [rng.randrange(1, 5_000) for _ in range(100)], [rng.choice((1, 2, 63, 64, 65, 900)) for _ in range(3_000)]):
        tied = op8_packing.bundles(sizes, 64)
        assert [i for b in tied for i in b] == list(range(len(sizes)))
        assert all(len(b) == 1 or sum(sizes[i] for i in b) <= 64 for b in tied)
        assert len(tied) <= 2 * (sum(sizes) // 64 + 1)


def test_packing_query_against_the_tokenizer(spark):
    """Each piece's checksum, at its place of its document's ids."""
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    plain = WordEncoder(vocabulary(op8_packing.VOCABULARY)).tokenizer
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    held = Counter()
    for r in op8_packing.op8_packing(spark, d).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        held.update((r.doc_id, r.start + i) for i in range(r.length))
    assert len(held) == sum(map(len, ids.values())) and set(held.values()) == {1}


def test_packing_round_trip(spark, odd):
    path = vocabulary(op8_packing.VOCABULARY)
    e = WordEncoder(path)
    for rows in (odd, odd.limit(0)):
        got = op8_packing.pack(rows, path, window=64, block_windows=4).collect()
        by_seq, by_doc = {}, {}
        for r in got:
            assert r.length == len(r.ids) // 4 > 0
            by_seq.setdefault(r.sequence_id, []).append(r)
            by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        for pieces in by_seq.values():
            pieces.sort(key=lambda r: r.offset)
            ends = np.cumsum([r.length for r in pieces]).tolist()
            assert [r.offset for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 64
            assert ends[-1] & (ends[-1] - 1) == 0  # full, or at a power of two
        want = Counter()
        for r in rows.collect():
            ids = e.encode((r.text or "").encode()) + b"\2\0\0\0"
            want[r.doc_id, ids] += 1
        for (doc_id, ids), n in want.items():
            found = b"".join(r.ids for r in sorted(by_doc[doc_id, len(ids) // 4], key=lambda r: r.start)) if n == 1 else ids
            assert zlib.crc32(found) == zlib.crc32(ids)
        assert sum(r.length for r in got) == sum(len(i) // 4 * n for (_, i), n in want.items())


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rollup = op6_tokens.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    docs = [("a", "en", "t1", 5), ("a", "en", "t1", 7), (None, "de", "t1", 3), ("b", None, "t1", None)]
    rows = spark.createDataFrame(docs, "source string, lang string, tokenizer string, tokens long")
    assert rollup.commit("one", op6_tokens.inserts(rows))
    assert not rollup.commit("one", op6_tokens.inserts(rows))
    assert rollup.commit("gone", op6_tokens.deletes(rows.where("tokens = 7")))
    revised = spark.createDataFrame([("a", "a", "en", "en", "t1", "t2", 5, 6)], "old_source string, new_source string, old_lang string, new_lang string, old_tokenizer string, new_tokenizer string, old_tokens long, new_tokens long")
    assert rollup.commit("again", op6_tokens.revisions(revised))
    assert rollup.commit("empty", op6_tokens.inserts(rows.limit(0)))
    got = {tuple(r) for r in rollup.totals().collect()}
    assert got == {("a", "en", "t2", 1, 6), (None, "de", "t1", 1, 3), ("b", None, "t1", 1, 0)}
    with pytest.raises(ValueError):
        rollup.commit("../x", op6_tokens.inserts(rows))


def test_commits_survive_crashes_and_other_writers(spark, tmp_path, monkeypatch):
    rollup = op6_tokens.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = op6_tokens.inserts(spark.createDataFrame([("a", "en", "t1", 5)], "source string, lang string, tokenizer string, tokens long"))
    # A second writer marks the batch while the first still writes its sums.
    monkeypatch.setattr(rollup, "committed", lambda batch: False)
    assert rollup.commit("one", rows) and not rollup.commit("one", rows)
    monkeypatch.undo()
    # A crash before the marker leaves a folder that is never read, and goes.
    monkeypatch.setattr(rollup, "_mark", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        rollup.commit("two", rows)
    monkeypatch.undo()
    assert [r.n_tokens for r in rollup.totals().collect()] == [5]
    assert rollup.sweep(3_600_000) == []
    assert len(rollup.sweep(0)) == 1 and rollup.commit("two", rows)
    # A crash in the marker leaves it empty: no one takes the batch for committed.
    (tmp_path / "r" / "batch=three").touch()
    with pytest.raises(RuntimeError):
        rollup.commit("three", rows)
    assert rollup.sweep(0) == ["batch=three"] and rollup.commit("three", rows)
    assert [r.n_tokens for r in rollup.totals().collect()] == [15]


def test_samples_stay_full_at_any_size(spark):
    """The share of hashes is neither rounded down nor lost where there are billions of labels."""
    from obsforge.llm.common import hashed_share

    for share in (1e-12, 3e-7, 0.25):
        below = int(share * (1 << 64)) - (1 << 63)
        values = spark.createDataFrame([(below - 1,), (below,), (-(1 << 63),)], "h long")
        assert [r.k for r in values.select(hashed_share(F.col("h"), share).alias("k")).collect()] == [True, False, True]
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    docs = ids.select("doc_id", F.lit("t").alias("text"))
    for most in (20, 1_000):
        n = labelled(docs, ids, "quality", most).count()
        assert 0.4 * most < n < 1.8 * most
    twice = docs.where("doc_id < 9").union(docs.where("doc_id < 9"))
    assert labelled(twice, ids, "quality", 10**6).count() == 9


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from obsforge.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="app-none", master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_token_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    e = WordEncoder(vocabulary("word_bpe_49k.json")).tokenizer
    toxic = {r["doc_id"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["toxic"] == 1}
    want = Counter()
    for r in pq.read_table(f"{d}/documents.parquet").to_pylist():
        if r["doc_id"] not in toxic:
            want[r["source"], r["lang"]] += len(e.encode(r["text"] or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): r.n_tokens for r in op6_tokens.op6_tokens(spark, d).collect()}
    assert got == dict(want)

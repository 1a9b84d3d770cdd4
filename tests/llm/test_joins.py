"""Line dedup, decontamination, chat repair, URL filters and the pipeline: brute force and odd rows."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from obsforge.llm import common, op1_lines, op2_decontaminate, op3_chat, op10_urls


# --- lines --------------------------------------------------------------------------------------


def words(line):
    w = tuple(w for w in re.split(r"[ \t\r\x0b\f]+", line) if w)
    return tuple(w[0]) if len(w) == 1 and len(w[0]) >= 10 and re.search("[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f]", w[0]) else w


def alike(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(rows, min_words=1, min_alike=5):
    """All pairs of different lines, by definition."""
    first = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if len(words(line)) >= min_words:
                first.setdefault(words(line), (doc_id, i))
    ordered = list(first)
    gone = {w for k, w in enumerate(ordered) if len(w) >= min_alike and any(len(v) >= min_alike and alike(v, w) for v in ordered[:k])}
    keep = {at for w, at in first.items() if w not in gone}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) in keep or len(words(x)) < min_words) for d, t in rows}


def test_line_dedup_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = "abcdef"
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 4, 5, 6, 7, 9, 10, 11, 14, 30, 300)))] for _ in range(24)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                i = rng.randrange(len(w))
                w[i : i + rng.choice((0, 1))] = rng.choice(([], [rng.choice(vocabulary)]))
            text.append(rng.choice((" ", "  ", "\t")).join(w))
        rows.append((d, "\n".join([*text, *rng.choice(([], [""], ["x"], ["two words"], [f"这是第{rng.choice('一二三')}个没有空格的句子"], ["短句"]))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in op1_lines.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # the way without broadcasting gives the same
    assert {r.doc_id: r.text for r in op1_lines.dedup_lines(docs).collect()} == got
    assert {r.doc_id: r.text for r in op1_lines.dedup_lines(docs, edits=0).collect()} == brute_lines(rows, min_alike=1000)
    with pytest.raises(ValueError):
        op1_lines.dedup_lines(docs, edits=2)


def test_short_lines_with_one_word_changed_go(spark):
    line = "nine words stand in this line of the text"
    docs = spark.createDataFrame([(1, line), (2, line.replace("nine", "some")), (3, "one\none"), (4, "four words stand here"), (5, "four words stood here")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in op1_lines.dedup_lines(docs).collect()} == {1: line, 2: "", 3: "one", 4: "four words stand here", 5: "four words stood here"}


def test_line_dedup_over_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, "same line here\nsame line here"), (4, "same line here"), (None, "same line here\nnew line"), (5, long), (6, long.replace("w777 ", "")), (7, "tie tie"), (7, "tie tie"), (8, " \n\n x")]
    docs = spark.createDataFrame([(*r, "n", 5, "s") for r in rows], "doc_id long, text string, w string, n_chars long, stay string")
    got = op1_lines.dedup_lines(docs)
    assert got.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(1, None), (2, ""), (3, "same line here"), (4, ""), (None, "new line"), (5, long), (6, ""), (7, "tie tie"), (7, "tie tie"), (8, " \n\n x")]
    assert texts == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    assert op1_lines.dedup_lines(docs.limit(0)).count() == 0


# --- decontamination ----------------------------------------------------------------------------


def test_masks_are_lossless():
    for off in itertools.combinations(range(op2_decontaminate.WINDOW), op2_decontaminate.SUBSTITUTIONS):
        assert any(not {i + m for m in mask} & set(off) for mask in op2_decontaminate.MASKS for i in range(op2_decontaminate.WINDOW - mask[-1]))
    for n in range(op2_decontaminate.MIN_SUBSTITUTED, op2_decontaminate.WINDOW):  # of an item's two halves one is left
        half = op2_decontaminate.short_mask(n)
        assert all(any(off not in range(q, q + half) for q in (0, n - half)) for off in range(n))


def brute_overlap(doc, item):
    """The longest aligned stretch of at least 13 tokens with at most two substitutions; short items as a whole, with one from 8 on."""
    best = 0
    if len(item) < 5:
        return 0
    if len(item) < 13:
        most = 1 if len(item) >= 8 else 0
        return len(item) if any(sum(x != y for x, y in zip(doc[i : i + len(item)], item, strict=True)) <= most for i in range(len(doc) - len(item) + 1)) else 0
    for shift in range(-len(item), len(doc)):
        same = [doc[i] == item[i - shift] for i in range(max(0, shift), min(len(doc), len(item) + shift))]
        for a in range(len(same)):
            off = 0
            for b in range(a, len(same)):
                off += not same[b]
                if off > 2:
                    break
                best = max(best, b - a + 1)
    return best if best >= 13 else 0


def test_overlaps_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 5, 7, 8, 9, 11, 12, 13, 20, 40, 20)]
    docs = []
    for d in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            piece = list(rng.choice(items))[rng.choice((0, 0, 1, 3)) :]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                if piece:
                    piece[rng.randrange(len(piece))] = "zz"
            at = rng.randrange(len(text) + 1)
            text[at:at] = piece
        docs.append((d, "  ".join(w.upper() + "," if rng.random() < 0.2 else w for w in text)))
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    toks = {d: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] for d, t in docs}
    want = {(d, k): n for d in toks for k, t in enumerate(items) if (n := brute_overlap(toks[d], t))}
    assert {len(items[k]) for _, k in want} >= {5, 7, 8, 9, 11, 12, 13, 20, 40}
    for most in (100_000, 20):  # by a broadcast, and by a shuffle
        monkeypatch.setattr(op2_decontaminate, "BROADCAST_SEEDS", most)
        got = {(r.doc_id, r.item_id): r.overlap for r in op2_decontaminate.overlaps(df, b, "doc_id").collect()}
        assert got == want
    assert {r.doc_id for r in op2_decontaminate.keep_clean(df, b).collect()} == set(toks) - {d for d, _ in want}


def test_short_and_unspaced_items(spark):
    bench = spark.createDataFrame([(1, "what is the capital of france now"), (2, "日本の首都はどこですか"), (3, "yes it is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Q: What is the capital of France, now? yes it is"), (2, "答えてください日本の首都はどこですか。"), (3, "what is the capital of spain now")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op2_decontaminate.overlaps(docs, bench, "doc_id").collect()} == {(1, 1), (2, 2)}


def test_decontamination_over_odd_rows(spark):
    item = " ".join(f"token{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, item, None), (3, item, None), (None, "before " + item, "q"), (None, "clean", "q"), (4, "x y " * 50_000, "q")], "doc_id long, text string, __id string")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (None, item, 0), (2, None, 0), (3, "short one", 0)], "item_id long, text string, h int")
    clean = op2_decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted([1, 2, 4, None], key=str)
    assert op2_decontaminate.overlaps(docs, bench.limit(0), "doc_id").count() == 0
    assert op2_decontaminate.overlaps(docs.limit(0), bench, "doc_id").count() == 0


# --- chats --------------------------------------------------------------------------------------


def cheapest(roles):
    """The least cost of any legal sequence, by trying all targets, merges and insertions."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    names = (None, "system", "user", "assistant")

    def best(state, rest):
        if not rest:
            return op3_chat.ENDS[state][0]
        out = float("inf")
        role = rest[0] if rest[0] in names[1:] else None
        for to in (1, 2, 3):
            c = 0 if names[to] == role else op3_chat.UNKNOWN if role is None else op3_chat.RELABEL
            if to in legal[state]:
                out = min(out, c + best(to, rest[1:]))
            if to == state:
                out = min(out, c + op3_chat.MERGE + best(to, rest[1:]))
            for between in legal[state]:
                if to in legal[between]:
                    out = min(out, c + op3_chat.INSERT + best(to, rest[1:]))
        return out

    return best(0, tuple(roles))


def test_repairs_cost_least_and_are_legal():
    rng = random.Random(3)
    for _ in range(150):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randrange(1, 6))]
        moves = op3_chat.repair(roles)
        assert sum(m[2] for m in moves) + op3_chat.ENDS[moves[-1][1]][0] == pytest.approx(cheapest(roles))


@pytest.mark.parametrize("pieces", [1, 7])
def test_chats_render_alike_however_they_are_cut(spark, pieces):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system", "bot"]), f"text {t}") for t in range(120)]
    rows += [(2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, None, None, ""), (4, 5, "user", "q" * 200_000), (4, 5, "user", "a")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(pieces))
    try:
        df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")
        got = defaultdict(list)
        for r in op3_chat.format_chats(df).collect():
            got[r.conv_id].append(r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    chats = {c: "".join(r.rendered for r in sorted(v, key=lambda r: r.seq)) for c, v in got.items()}
    assert chats[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert chats[3] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" or chats[3].count("im_start") == 2
    assert set(chats) == {1, 2, 3, 4, None}
    for chat in chats.values():
        roles = re.findall(r"<\|im_start\|>(\w+)\n", chat)
        tail = roles[1:] if roles[0] == "system" else roles
        assert tail == ["user", "assistant"] * (len(tail) // 2) and tail
        assert chat.count("<|im_end|>\n") == len(roles)
    costs = {"insert": op3_chat.INSERT}
    total = sum(costs.get(r.action, 0) + (op3_chat.MERGE if r.action == "merge" else 0) + (0 if r.action == "insert" or r.role == r.source_role else op3_chat.RELABEL if r.source_role in op3_chat.ROLES else op3_chat.UNKNOWN) for r in got[1])
    moves = op3_chat.repair([r[2] for r in rows if r[0] == 1])
    assert total == pytest.approx(sum(m[2] for m in moves) + op3_chat.ENDS[moves[-1][1]][0])
    assert next(r.copies for r in got[3] if r.action != "insert") == 2
    assert op3_chat.format_chats(df.limit(0)).count() == 0


# --- urls ---------------------------------------------------------------------------------------


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "https://b.net/en/", "b.net", "/en/", "net/", "block"), (3, "https://c.net", "c.net", "", None, "allow"),
        (4, "https://x.org/fr/1#z", "x.org", "/fr/1", "org/fr/", "allow"), (5, "https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), (6, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (7, None, "", "", None, "allow"), (8, "no scheme/path", "", "", None, "allow"), (9, "a://b://c/d", "b:", "//c/d", None, "allow"), (10, "http://h?x=/en/", "h", "", None, "allow"), (None, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], None, "c") for r in rows], "page_id long, url string, html string, host string")
    got = {tuple(r)[:5] for r in op10_urls.judge(df).collect()}
    assert got == {(r[0], r[2], r[3], r[4], r[5]) for r in rows}
    assert op10_urls.judge(df.limit(0)).count() == 0


def test_propagation_against_power_iteration(spark):
    from obsforge.llm.common import Durable

    rng = random.Random(4)
    hosts = [f"h{i}" for i in range(14)]
    links = sorted({(a, b) for a, b in ((rng.choice(hosts), rng.choice(hosts)) for _ in range(40)) if a != b})
    seeds = {"h1": (1.0, 0.0), "h2": (0.0, 1.0), "h3": (0.25, 0.5), "lone": (0.0, 1.0)}
    df = op10_urls.propagate(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, allowed double, blocked double"), Durable(spark), rounds=6)
    got = {r.host: (r.trust, r.distrust) for r in df.collect()}
    d, every = op10_urls.DAMPING, sorted({x for link in links for x in link} | set(seeds))
    t = {h: (1 - d) * seeds.get(h, (0, 0))[0] for h in every}
    s = {h: (1 - d) * seeds.get(h, (0, 0))[1] for h in every}
    t0, s0 = dict(t), dict(s)
    for _ in range(6):
        t2, s2 = dict(t0), dict(s0)
        for a, b in links:
            t2[b] += d * t[a] / sum(x == a for x, _ in links)
            s2[a] += d * s[b] / sum(y == b for _, y in links)
        t, s = t2, s2
    assert set(got) == set(every)
    for h in every:
        assert got[h] == (pytest.approx(t[h]), pytest.approx(s[h]))


def test_rounds_go_on_until_scores_settle(spark):
    from obsforge.llm.common import Durable

    links = spark.createDataFrame([(f"h{i}", f"h{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h4", 0.0, 1.0)], "host string, allowed double, blocked double")
    got = {r.host: r for r in op10_urls.propagate(links, seeds, Durable(spark), tolerance=1e-4).collect()}
    d, loop = op10_urls.DAMPING, 1 - op10_urls.DAMPING**9
    for i in range(9):  # once round the ring and round again: a geometric series
        assert got[f"h{i}"].trust == pytest.approx((1 - d) * d**i / loop, abs=1e-4)
        assert got[f"h{i}"].distrust == pytest.approx((1 - d) * d ** ((4 - i) % 9) / loop, abs=1e-4)
        assert got[f"h{i}"].residual <= 1e-4 * (1 - d)
    assert got["h0"].residual < op10_urls.propagate(links, seeds, Durable(spark), rounds=4).first().residual


def test_trust_overrides_distrust_over_real_links(spark):
    """Both link to a blocked host, but allowed hosts link to one of them."""
    to_bad = '<a href="http://bad.net/x">'
    pages = [(1, "http://bad.net/x", ""), (2, "http://cited.com/", to_bad), (3, "http://farm.com/", to_bad)]
    pages += [(10 + i, f"http://good{i}.org/fr/", '<a href="http://cited.com/a">') for i in range(4)]
    df = spark.createDataFrame([*pages, (99, "http://long.com/", "x" * 400_000 + to_bad)], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.trust > r.distrust) for r in op10_urls.judge(df, threshold=0.2).collect()}
    assert got[2] == ("allow", True) and got[3] == ("block", False) and got[1][0] == "block" and got[10][0] == "allow"
    assert got[99] == got[3]


def test_bad_neighbours_are_blocked(spark):
    pages = [(1, "http://bad.net/x", ""), (2, "http://farm.com/", '<a href="http://bad.net/x">'), (3, "http://good.com/", "<a href=/local>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in op10_urls.judge(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, start, d).cache()
        assert out.columns == docs.columns, name
        rows_in, rows_out = start.count(), out.count()
        if name == "line_dedup":
            assert rows_in == rows_out
            assert {r.doc_id: r.text for r in out.collect()} == brute_lines([(r.doc_id, r.text) for r in start.orderBy("doc_id").collect()])
        else:
            assert 0 < rows_out <= rows_in
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.9 * len(good)
        start = out
    left = {r.doc_id for r in start.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0

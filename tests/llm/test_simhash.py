from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import queries, simhash
from quarry.llm.common import Workspace, marked


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_groups(n, linked):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(k) for k in range(n)]


def near(fps, tau):
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= tau, 1)), strict=True)]


def smallest(roots, ids):
    least = {}
    for r, i in zip(roots, ids, strict=True):
        least[r] = min(least.get(r, i), i)
    return [least[r] for r in roots]


def test_op8_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(queries.op8_simhash(spark, data).collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(d["text"]) for d in docs]
    assert [r["fingerprint"] for r in got] == [format(f, "016x") for f in fps]
    ids = [d["doc_id"] for d in docs]
    assert [r["component_id"] for r in got] == smallest(brute_groups(len(fps), near(np.array(fps, np.uint64), 3)), ids)


@pytest.mark.parametrize(("tau", "bucket"), [(3, 5), (3, 40), (7, 6), (2, 2_000)])
def test_links_connect_what_is_near(spark, monkeypatch, tau, bucket):
    """Small buckets force every split: classes, then the grid."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = rng.integers(0, 64, (60, 3), dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [np.bitwise_xor.reduce(np.r_[b, np.uint64(1) << f]).reshape(1) for b in base for f in flips]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(3)
    work = Workspace(spark, "test")
    got = {r["u"]: r["v"] for r in simhash.stars(work, simhash.link(work, [df], tau)).collect()}
    ids = fps.view(np.int64).tolist()
    want = smallest(brute_groups(len(ids), near(fps, tau)), ids)
    assert [got.get(i, i) for i in ids] == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "u long, v long")
    got = {r["u"]: r["v"] for r in simhash.stars(Workspace(spark, "test"), edges).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {1001: 1000}


def test_plan_keeps_the_pigeonhole_sum():
    n, both = 1000, np.full((64, 64), 250.0) + np.eye(64) * 250
    for tau in (1, 3, 7):
        for size in (1e2, 1e5, 1e9):
            masks = simhash.plan(int(size), both * size / n, tau)
            rng = np.random.default_rng(0)
            for _ in range(300):  # any tau flipped bits leave some mask untouched
                flipped = sum(1 << int(b) for b in rng.choice(64, tau, replace=False))
                assert any(not m & flipped for m in masks)


def test_odd_rows(spark):
    rows = [(7, None, "x"), (3, "", "y"), (5, " \n", "z"), (9, "same text here it is", None), (8, "Same TEXT here it is", None), (None, "same text here it is", None), (None, "alone among all the others", ""), (4, "w", ""), (4, "w", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(spark, df).collect()), key=repr)
    zero = "0" * 16
    assert [g for g in got if g[1] == zero] == [(3, zero, 3), (5, zero, 3), (7, zero, 3)]
    assert {g[0]: g[2] for g in got if g[0] in (8, 9)} == {8: 8, 9: 8}
    assert (None, 8) in {(g[0], g[2]) for g in got} and (None, None) in {(g[0], g[2]) for g in got}
    assert len(got) == len(rows)
    assert simhash.report(spark, df.limit(0)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("sets", [400, 3])
def test_near_copies_by_exact_similarity(spark, monkeypatch, sets):
    monkeypatch.setattr(simhash, "SETS", sets)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        own = list(rng.choice(words, 150))
        for k in range(8):
            copy = list(own)
            for i in rng.integers(0, 150, k // 2):
                copy[i] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(s)) for b in range(a) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = smallest(brute_groups(len(s), pairs), range(len(s)))
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(spark, df).collect())
    assert [g[1] for g in got] == want
    kept = sorted(r["doc_id"] for r in simhash.keep(spark, df).collect())
    assert kept == sorted(set(want))


def test_keep_on_odd_rows(spark):
    rows = [(1, "a b c", "en"), (1, "a b c", "de"), (2, "a b c", "fr"), (3, None, "en"), (4, "", None), (5, "x" * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = simhash.keep(spark, df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5]
    assert simhash.keep(spark, df.limit(0)).count() == 0


def test_near_copies_with_null_and_repeated_ids(spark):
    def text(name, change=None):
        return " ".join(change if change and k == 70 else f"{name}{k}" for k in range(90))

    rows = [(None, text("a")), (None, text("a", "x")), (None, text("b")), (7, text("c")), (7, text("d")), (9, text("d", "y")), (9, text("d", "y"))]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = simhash.similar_groups(spark, df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0)] * 3 + [(7, 7)] * 2 + [(9, 7)] * 2
    # One row of each group, told by id and text: of the null rows that are near copies, the one with the lesser digest.
    kept = {(r["doc_id"], r["text"]) for r in simhash.keep(spark, df).collect()}
    assert kept == {min((None, text("a")), (None, text("a", "x")), key=lambda r: simhash.text_digest(r[1].encode())), (None, text("b")), (7, text("c")), (7, text("d"))}


def test_keep_with_repeated_ids_and_clashing_columns(spark):
    """(7, A), (9, A') and (9, B): A' goes although its id stays; of a repeated row the least by its columns stays."""
    rows = [(7, " ".join(f"a{k}" for k in range(90)), "z", 1), (9, " ".join(["x", *(f"a{k}" for k in range(1, 90))]), "z", 2), (9, "b b", "z", 3), (9, "b b", "c", 9), (None, None, "q", 4), (None, "", "p", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_digest string, first int").withColumn("extra.map", F.create_map(F.lit("k"), F.lit(1)))
    df = df.withColumn("digest", F.lit("clash")).withColumn("group", F.lit(0))
    got = simhash.keep(spark, df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["own_digest"], r["first"]) for r in got.collect()) == [(0, "q", 4), (7, "z", 1), (9, "c", 9)]  # a null comes before an empty text


def test_hot_root_is_spread_and_right(spark):
    """A star of 20,000 around one node, and one that isn't the smallest."""
    edges = [(0, k) for k in range(1, 20_000)] + [(30_000, 50_000 + k) for k in range(5_000)] + [(29_999, 52_000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["u"]: r["v"] for r in simhash.stars(Workspace(spark, "test"), df).collect()}
    assert got == {k: 0 for k in range(1, 20_000)} | {k: 29_999 for k in [30_000, *range(50_000, 55_000)]}
    rows = spark.range(10_000).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    out = simhash.with_least(rows, "g", "v", "m", "v")
    assert out.count() == 10_000 and out.where("m <> 0").count() == 0


def test_sets_of_a_cell_against_all_pairs():
    rng = np.random.default_rng(5)
    for least in (0.8, 0.5):
        base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        sets = [np.unique(np.r_[rng.choice(base, int(rng.integers(150, 290)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 40)), dtype=np.uint64)]) for _ in range(60)]
        sets += [np.empty(0, np.uint64), np.empty(0, np.uint64), base[:1], base[:1], base[1:2], base[:5], base[:6]]
        like = lambda a, b: len(np.intersect1d(a, b)) >= least * len(np.union1d(a, b))
        want = brute_groups(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if like(sets[a], sets[b])])
        links, root = simhash.similar_pairs(sets, least)
        assert all(like(sets[a], sets[b]) for a, b in links)
        groups = lambda labels: sorted(sorted(k for k in range(len(sets)) if labels[k] == x) for x in set(labels))
        assert groups(list(root)) == groups(want) and len(links) == len(sets) - len(set(want))


def test_large_groups_are_whole(spark, monkeypatch):
    """Candidate groups far larger than a task takes, of near copies and of texts below the similarity: as by all pairs."""
    monkeypatch.setattr(simhash, "SETS", 6)
    rng, texts = np.random.default_rng(12), []
    for g, edits in enumerate((1, 3, 5)):
        own = [f"g{g}w{k}" for k in range(160)]
        for _ in range(60):
            copy = list(own)
            for i in rng.integers(0, 160, rng.integers(0, edits + 1) * 2):
                copy[i] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(s)) for b in range(a) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(spark, df).collect())
    assert [g[1] for g in got] == smallest(brute_groups(len(s), pairs), range(len(s)))


def test_kinds_of_fingerprints_differ_but_are_all_zero_without_words():
    fps = simhash.majority([b"", b" \n", b"one", b"one two three"], simhash.word_hashes, 3)
    assert fps.shape == (3, 4)
    assert not fps[:, :2].any()
    assert len({int(f) for f in fps[:, 2:].ravel()}) == 6
    assert fps[0, 2] == next(simhash.word_hashes(b"one"))


def test_near_copies_that_differ_in_one_piece(spark):
    """A passage added, cut or replaced at a similarity of 0.8 to 0.9, and short texts with one more word."""
    rng = np.random.default_rng(9)
    word, texts = lambda: f"w{rng.integers(10**9)}", []
    for n in (60, 200, 1000):
        for least in (0.8, 0.85, 0.9):
            for k in range(6):
                own, more = [word() for _ in range(n)], int((n - 4) / least + 1e-9) - (n - 4)
                block = int((n - 4) * (1 - least) / (1 + least)) - 4
                texts += [own, (own + [word() for _ in range(more)], own[: n - int((n - 4) * (1 - least))], own[:20] + [word() for _ in range(block)] + own[20 + block :])[k % 3]]
    for n in range(10, 31):
        for _ in range(3):
            own = [word() for _ in range(n)]
            texts += [own, [*own, word()]]
    texts = [" ".join(t) for t in texts]
    s = [shingles(t) for t in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(s[::2], s[1::2], strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark, df).collect()}
    assert got == {k: k // 2 * 2 for k in range(len(texts))}


@pytest.mark.parametrize("bucket", [16_000, 3])
def test_prefixes_meet_at_the_least_similarity(spark, monkeypatch, bucket):
    """Against all pairs, with frequent shingles and a grid of small cells."""
    for name, value in (("BUCKET", bucket), ("SAMPLED", 1), ("FREQUENT", 2)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(2)
    base, texts = [f"c{k}" for k in range(40)], []
    for k in range(60):
        a, b = sorted(rng.integers(0, 41, 2))
        texts.append(" ".join([*base[: 40 - (b - a) // 4], *(f"x{k % 7}y{i}" for i in range(k % 12))]))
    texts = sorted(set(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digests = {simhash.text_digest(t.encode()): k for k, t in enumerate(texts)}
    work = Workspace(spark, "test")
    table = work.put(simhash.prefixes(df, simhash.frequent_shingles(df)))
    shared = simhash.shared_shingles(work, table)
    number = {r["node"]: digests[r["digest"]] for r in table.select("node", "digest").collect()}
    roots = spark.createDataFrame([(n, k) for n, k in number.items()], "node long, root long")
    got = {tuple(sorted((number[r["u"]], number[r["v"]]))) for r in simhash.prefix_pairs(work, table, shared, roots, trees=False).collect()}
    few = {tuple(sorted((number[r["u"]], number[r["v"]]))) for r in simhash.prefix_pairs(work, table, shared, roots, 1, trees=False).collect()}
    tree = {tuple(sorted((number[r["u"]], number[r["v"]]))) for r in simhash.prefix_pairs(work, table, shared, roots).collect()}
    assert few < got
    s = [shingles(t) for t in texts]
    want = {(a, b) for b in range(len(s)) for a in range(b) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    assert want and want <= got
    # Trees join what the pairs join, in fewer rows.
    def joined(pairs):
        root = {k: k for k in range(len(texts))}
        for a, b in pairs:
            x, y = root[a], root[b]
            root = {k: x if r == y else r for k, r in root.items()}
        return {frozenset(k for k, r in root.items() if r == x) for x in root.values()}

    assert tree <= got and joined(tree) == joined(got)


def test_template_pages_store_no_pairs(spark):
    """Texts of 60 of 90 sentences each share shingles with all others, and none is a near copy: what is stored doesn't grow with the pairs."""
    rng = np.random.default_rng(8)
    sentences = [" ".join(f"s{k}w{i}" for i in range(9)) for k in range(90)]
    for n in (150, 300):
        texts = [" ".join(sentences[k] for k in sorted(rng.permutation(90)[:60])) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        work = Workspace(spark, "test")
        table = work.put(simhash.prefixes(df, simhash.frequent_shingles(df)))
        roots = table.select("node", F.xxhash64("node").alias("root"))
        pairs = simhash.prefix_pairs(work, table, simhash.shared_shingles(work, table), roots, trees=False).count()
        s = [shingles(t) for t in texts]
        true = sum(len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) for a in range(n) for b in range(a))
        assert true <= pairs <= n + 2 * true


def test_marks_clear_only_what_is_not_there(spark):
    work = Workspace(spark, "test")
    rows = spark.range(5000).withColumnRenamed("id", "mark")
    for n in (0, 40, 3000):
        got = marked(work, rows, F.xxhash64("mark"), spark.range(n).select(F.xxhash64("id").alias("hash")), "there")
        assert got.where(f"NOT there AND mark < {n}").count() == 0 and got.count() == 5000
        assert got.where(f"there AND mark >= {n}").count() < 0.2 * 5000

"""SimHash near-duplicates by the generalised pigeonhole principle.

``fingerprints`` gives each text 64 bits by majority over the XXH64 values of its word shingles. Texts link
where their fingerprints differ in at most ``tau`` bits; ``components`` names each text's connected component.

Candidate search (over the distinct fingerprints, so copies count once):

1. Counts of each pair of bits over all fingerprints. Bits that vary together are grouped into m partitions.
2. If two fingerprints differ in at most tau bits, then for thresholds t_1..t_m with sum tau - m + 1, some
   partition i has at most t_i differing bits (t_i = -1: the partition isn't used). Dynamic programming picks
   the thresholds, and the cheapest m, by estimated cost: rows to send and candidate pairs to compare. Both are
   estimated from the counts and the number of fingerprints, so the plan follows the input.
3. A partition with threshold t is probed with all masks that leave t of its bits out: equal masked values make
   a bucket. Buckets of one fingerprint go. In the others every pair is compared, and of the links a spanning
   forest leaves the task, so a group of near copies makes as many rows as it has members, not pairs.
4. A bucket of more than BUCKET fingerprints is split: by pigeonhole on four interleaved classes of the 64 bits
   (any pair within tau <= 3 agrees on one; in general tau + 1 classes), and what is still too large, by a
   grid of chunk pairs. Either way all its pairs meet somewhere, in tasks of bounded size.

Components come from alternating large-star and small-star rounds over edges written to the shared folder.

``similar_groups`` is for corpora: near copies are texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more, all of them. Candidates come from two sources, and their shingle sets are compared exactly:

1. Each text has KINDS fingerprints of its set of words (an edit changes one word, but five shingles), of the same
   word hashes mixed differently. Texts within WORD_TAU bits in any kind are of one candidate group.
2. What these leave apart comes from an exact prefix filter: in any fixed order of all shingles, two sets of that similarity
   share one of their first n - ceil(0.8 n) + 1, and the first that they share leaves enough after it in both. The order is by
   hash, with shingles that are frequent in a sample of texts last; which those are changes the cost, not the result. Shingles
   whose texts aren't all of one group go on, those of many texts split over the grid. Counts of each set's shingles by their last bits bound
   what two sets can share; they go along, so pairs that they rule out never leave the task. Of those that pass, a spanning
   forest of each bucket joins the groups of their texts: so many texts that are alike make as many rows, not pairs.

So texts of the similarity are of one candidate group. A group of at most SETS texts meets in one task, which compares all its
pairs that share a shingle of their prefixes. A larger one is dealt into chunks of about SETS; of each chunk's linked texts
one goes on to the next round, so every set moves once and the few that represent others once more. What the rounds
leave apart is found by the same filter on verified groups, neighbours first, and compared pair by pair.

A node with a third of all links, or a component with a third of all texts, is dealt over SALTS (``with_least``).

Rows: a null text counts as empty; without a word the fingerprint is zero and links like any other. Repeated
rows and copies share a fingerprint. A null doc_id doesn't count as the smallest unless its component has no
other. Texts of any length count whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.llm.common import SALTS, Workspace, attach, marked, text_bytes

SHINGLE, SEED, TAU = 3, 42, 3
#: Near copies: shingle, similarity, fingerprints of a text's word set, and the bits within which those are candidates.
COPY_SHINGLE, SIMILARITY, KINDS, WORD_TAU = 5, 0.8, 3, 6
#: Frequent shingles: share of texts to count (one in), the least count there, and the most that are listed.
SAMPLED, FREQUENT, LISTED = 64, 4, 65_536
#: Shingle sets that a task compares with each other.
SETS = 400
#: Rows of a shingle's list, in order of size, that each is compared with before all are.
NEIGHBOURS = 4
#: Fingerprints of a bucket (or of a chunk of the grid) that one task compares with each other.
BUCKET = 16_000
#: Relative costs of sending a row and of comparing a pair.
ROW_COST, PAIR_COST = 400.0, 1.0
LANES = np.uint64(0x0101010101010101)


# --- fingerprints ---------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[int]:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return iter(())
    if len(words) <= size:
        return iter((xxhash.xxh64_intdigest(b" ".join(words), SEED),))
    return map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def word_hashes(text: bytes) -> Iterator[int]:
    """Of each word once."""
    return map(partial(xxhash.xxh64_intdigest, seed=SEED), set(text.lower().split()))


def mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Other hashes of the same things (SplitMix64 steps from the hash); kind 0 is the hash itself."""
    if not kind:
        return hashes
    x = hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority(texts: list[bytes], hashes_of: Callable[[bytes], Iterator[int]] = shingle_hashes, kinds: int = 1) -> np.ndarray:
    """Fingerprints, a row for each kind: a bit is 1 if it is in more than half of the text's hashes."""
    each = [np.fromiter(hashes_of(t), np.uint64) for t in texts]
    n = np.array([len(e) for e in each], np.int64)
    hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
    return np.stack([vote(mixed(hashes, k), n) for k in range(kinds)])


def vote(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majorities over the first n[0] hashes, the next n[1], and so on; zero where there are none."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # Eight counters of a byte in each 64-bit word: sums of at most 255 rows fit.
    starts = np.cumsum(n) - n
    pieces = -(-n[full] // 255)
    text = np.repeat(np.arange(len(full)), pieces)
    first = np.cumsum(pieces) - pieces
    cut = starts[full][text] + 255 * (np.arange(len(text)) - first[text])
    for bit in range(8):
        sums = np.add.reduceat(hashes >> np.uint64(bit) & LANES, cut).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        lanes = (2 * ones > n[full][:, None]).astype(np.uint64) << np.uint64(bit)
        out[full] |= (lanes << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)
    return out


def text_digest(text: bytes) -> str:
    """The first 128 bits of the text's SHA-256 in hex, as ``digest_of`` gives them."""
    return hashlib.sha256(text).hexdigest()[:32]


def digest_of(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def fingerprint_columns(kinds: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, kinds))]


def fingerprints(df: DataFrame, hashes_of: Callable[[bytes], Iterator[int]] = shingle_hashes, kinds: int = 1) -> DataFrame:
    """doc_id, the fingerprints as signed longs, and a digest of the text."""
    columns = fingerprint_columns(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                fps, digests = majority(texts, hashes_of, kinds).view(np.int64), [text_digest(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), *map(pa.array, fps), pa.array(digests, pa.string())], ["doc_id", *columns, "digest"])

    return text_bytes(df, "doc_id").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in columns), "digest string"]))


# --- plan -----------------------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both: 2,080 numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, 64], pa.int32()), pa.array(np.r_[j, 64], pa.int32()), pa.array(np.r_[both[i, j], n].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((65, 65))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return int(out[64, 64]), out[:64, :64]


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal width: each starts with the free bit most correlated overall and takes its strongest partners."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        width = 64 * (k + 1) // m - 64 * k // m
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free -= set(group)
        while len(group) < width:
            b = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(b)
            free.remove(b)
        groups.append(group)
    return groups


def within(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..most bits of a group: each bit given the one before."""
    chance, before = np.zeros(most + 1), None
    chance[0] = 1.0
    for b in group:
        p = both[b, b] / max(n, 1)
        agree = p * p + (1 - p) ** 2
        if before is not None:
            q, pq = both[before, before] / max(n, 1), both[b, before] / max(n, 1)
            joint = np.array([pq, p - pq, q - pq, 1 - p - q + pq])
            agree = min(1.0, float(joint @ joint) / max(q * q + (1 - q) ** 2, 1e-12))
        chance = agree * chance + (1 - agree) * np.r_[0, chance[:-1]]
        before = b
    return np.cumsum(chance).tolist()


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost that sum to total; cost[i][t + 1] for t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        following: dict[int, tuple[float, list[int]]] = {}
        for have, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if have + t not in following or c + x < following[have + t][0]:
                    following[have + t] = (c + x, [*ts, t])
        best = following
    return best[total]


def plan(n: int, both: np.ndarray, tau: int = TAU) -> list[int]:
    """Masks of the bits that a bucket's fingerprints share."""
    n, best = max(n, 1), (math.inf, [], [])
    for m in range(1, tau + 2):
        groups = correlated_groups(n, both, m)
        cost = []
        for g in groups:
            chance = within(n, both, g, tau)
            cost.append([0.0] + [n * math.comb(len(g), t) * ROW_COST + n * n / 2 * chance[t] * PAIR_COST for t in range(min(tau, len(g) - 1) + 1)])
        c, thresholds = allocate(cost, tau - m + 1)
        if c < best[0]:
            best = (c, groups, thresholds)
    _, groups, thresholds = best
    return [sum(1 << b for b in g if b not in out) for g, t in zip(groups, thresholds, strict=True) if t >= 0 for out in map(set, combinations(g, t))]


# --- links ----------------------------------------------------------------------------------------------------


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray, tau: int, left: np.ndarray | None = None, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs within tau bits; with ``left`` (booleans), of those across only."""
    label = np.arange(len(fps))
    a, b = [], []
    for at in range(0, len(fps), block):
        part = fps[at : at + block]
        near = np.bitwise_count(part[:, None] ^ fps[None, at:]) <= tau
        if left is not None:
            near &= left[at : at + block, None] != left[None, at:]
        near &= label[at : at + block, None] != label[None, at:]
        for i in np.flatnonzero(near.any(1)).tolist():
            others = np.flatnonzero(near[i]) + at
            labels, first = np.unique(label[others], return_index=True)
            for other, j in zip(labels.tolist(), others[first].tolist(), strict=True):
                if other != label[i + at]:
                    label[label == other] = label[i + at]
                    a.append(i + at)
                    b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def compare(rows: DataFrame, tau: int) -> DataFrame:
    """rows: bucket, fp and side (null but for cells of the grid), each bucket of bounded size. Links u < v, a forest for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(bucket: np.ndarray, fp: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end, us, vs = np.r_[start[1:], len(bucket)], [], []
            pair = end - start == 2  # most buckets: all at once
            x, y = fp[start[pair]], fp[start[pair] + 1]
            ok = (np.bitwise_count(x ^ y) <= tau) & (x != y)
            us.append(x[ok])
            vs.append(y[ok])
            for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
                inner = side[s:e]
                a, b = forest(fp[s:e], tau, inner == 1 if inner[0] >= 0 else None)
                us.append(fp[s:e][a])
                vs.append(fp[s:e][b])
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the last bucket, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()))
            bucket, fp, side = map(np.concatenate, zip(*held, strict=True))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield links(bucket[:cut], fp[:cut], side[:cut])
            held = [(bucket[cut:], fp[cut:], side[cut:])]
        if held:
            yield links(*held[0])

    ordered = rows.select("bucket", "fp", "side").repartition("bucket").sortWithinPartitions("bucket", "fp")
    return ordered.mapInArrow(run, "u long, v long")


def probes(fps: DataFrame, tau: int, kind: int) -> DataFrame:
    """fp and bucket: each fingerprint under each mask of the plan."""
    masks = plan(*bit_counts(fps), tau)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks))))
    return fps.select("fp", each.alias("p")).select("fp", F.xxhash64(F.lit(kind), "p.k", "p.v").alias("bucket"))


def link(work: Workspace, kinds: list[DataFrame], tau: int = TAU) -> DataFrame:
    """Links that connect, in each kind, all distinct fingerprints within tau bits, as they connect."""
    rows = reduce(DataFrame.union, (probes(fps, tau, k) for k, fps in enumerate(kinds)))

    def counted(x: DataFrame) -> DataFrame:
        # As a table of its own, so that Spark sees a hot bucket's rows in the join and splits them.
        sizes = work.put(x.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        out = work.put(x.join(sizes, "bucket"), "buckets")
        work.drop(sizes)
        return out

    first = counted(rows)
    small = lambda x: x.where(F.col("n") <= BUCKET).select("bucket", "fp", F.lit(-1).alias("side"))
    classes = [signed(sum(1 << b for b in range(k, 64, tau + 1))) for k in range(tau + 1)]
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(classes))))
    second = counted(first.where(F.col("n") > BUCKET).select("fp", "bucket", parts.alias("p")).select("fp", F.xxhash64("bucket", "p.k", "p.v").alias("bucket")))
    # What is still large: chunks of about BUCKET, and each pair of chunks in a cell of its own.
    cells = grid(second.where(F.col("n") > BUCKET), F.col("bucket"), F.col("n"), F.col("fp"), BUCKET, "fp").select("bucket", "fp", "side")
    links = compare(small(first).union(small(second)).union(cells), tau)
    out = work.put(links.distinct(), "links")
    work.drop(first, second)
    return out


# --- components -----------------------------------------------------------------------------------------------


def with_least(rows: DataFrame, by: str, value: str, name: str, own: str) -> DataFrame:
    """rows with the least ``value`` of their key. Rows of a key are dealt over SALTS by ``own``, and the least to those that occur."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(own), F.lit(SALTS)))
    parts = salted.groupBy(by, "salt").agg(F.min(value).alias(name))
    least = parts.groupBy(by).agg(F.min(name).alias(name), F.collect_list("salt").alias("salts"))
    return salted.join(least.select(by, name, F.explode("salts").alias("salt")), [by, "salt"]).drop("salt")


def starred(edges: DataFrame) -> bool:
    """Whether each node has one edge up, to a node that has none: then all components are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def stars(work: Workspace, links: DataFrame) -> DataFrame:
    """u, v: each node but the smallest of its component, and that smallest. Links have u <> v."""
    edges = links
    while True:
        # Large star: neighbours above u go to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = with_least(both, "u", "v", "m", "v")
        large = around.select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("of")).where("u > of").select("u", "v")
        # Small star: u and its neighbours below go to the smallest of those.
        low = with_least(large, "u", "v", "m", "v")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        following = work.put(small, "stars")
        if edges is not links:
            work.drop(edges)
        if starred(following):  # every edge goes to a smaller node, so the middle of a star is its smallest
            return following
        edges = following


def components(spark: SparkSession, df: DataFrame, tau: int = TAU) -> DataFrame:
    """A row for each row of df: doc_id, fp (signed long) and component_id, the smallest doc_id of its component."""
    work = Workspace(spark, "simhash")
    docs = work.put(fingerprints(df).drop("digest"), "fingerprints")
    fps = work.put(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = link(work, [fps], tau)
    found = stars(work, links)
    roots = found.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    groups = work.put(with_least(named, "root", "first", "component_id", "fp").select("fp", "component_id"), "groups")
    work.drop(fps, links, found)
    return docs.join(groups, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    return components(spark, df).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


# --- near copies ----------------------------------------------------------------------------------------------


def shingle_sets(df: DataFrame) -> DataFrame:
    """node and groups as they are, and the sorted distinct hashes of the text's five-word shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = partial(shingle_hashes, size=COPY_SHINGLE)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(np.fromiter(of(t), np.uint64)).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())], ["node", "groups", "hashes"])

    return df.mapInArrow(run, "node string, groups array<struct<root: long, n: long>>, hashes binary")


def frequent_shingles(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in a sample of texts, in order of their hashes, and their counts: LISTED at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = partial(shingle_hashes, size=COPY_SHINGLE)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.fromiter(of(t), np.uint64)).view(np.int64))], ["key"])

    sample = text_bytes(df).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = sorted((r["key"] % 2**64, r["n"]) for r in counts.orderBy(F.desc("n"), "key").limit(LISTED).collect())
    return np.array([k for k, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """Of sorted distinct shingles, those that a set of the least similarity shares one of; and how many are not frequent."""
    listed, counts = frequent
    n = np.zeros(len(shingles), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, shingles), len(listed) - 1)
        n = np.where(listed[at] == shingles, counts[at], 0)
    order = np.argsort(n, kind="stable")[: len(n) - math.ceil(SIMILARITY * len(n) - 1e-9) + 1]
    return shingles[order], int((n[order] == 0).sum())


def sketch(shingles: np.ndarray) -> bytes:
    """Numbers of shingles by their last bits, four to eight each on average; empty if one doesn't fit a byte."""
    width = 1 << (len(shingles) // 8).bit_length()
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return counts.astype(np.uint8).tobytes() if len(shingles) and counts.max() < 256 else b""


def prefixes(df: DataFrame, frequent: tuple[np.ndarray, np.ndarray], sets: bool = False) -> DataFrame:
    """node (a hash of the digest) of each text, the number of its shingles, its sketch, its prefix and how many in that are not frequent.

    df has the texts; with ``sets`` instead digest and hashes, as ``shingle_sets`` gives them. Copies in one task are one row; a text has a row for each task that meets it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = partial(shingle_hashes, size=COPY_SHINGLE), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cells = batch.column(0).slice(at, 256).to_pylist()
                digests = batch.column(1).slice(at, 256).to_pylist() if sets else [text_digest(c) for c in cells]
                new = {d: c for d, c in zip(digests, cells, strict=True) if d not in seen}
                seen.update(new)
                own = [np.frombuffer(c, np.uint64) if sets else np.unique(np.fromiter(of(c), np.uint64)) for c in new.values()]
                first = [prefix(x, frequent) for x in own]
                keys = pa.array([k.view(np.int64) for k, _ in first], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array(map(len, own), pa.int32()), pa.array([c for _, c in first], pa.int32()), pa.array(map(sketch, own), pa.binary()), keys], ["digest", "size", "rare", "sketch", "keys"])

    rows = df.select("hashes", "digest") if sets else text_bytes(df)
    return rows.mapInArrow(run, "digest string, size int, rare int, sketch binary, keys array<long>").withColumn("node", F.xxhash64("digest"))


def folded(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width that a pair's narrower sketch may have: the row's place in the matrix, and that matrix of the sketches of this width and of twice that, added up."""
    width = np.array([len(x) for x in sketches])
    out = {}
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        place = np.zeros(len(width), np.int64)
        place[rows] = np.arange(len(rows))
        own = [np.frombuffer(sketches[r], np.uint8) for r in rows]
        out[w] = place, np.stack([x if len(x) == w else np.minimum(x.reshape(2, w).sum(0, dtype=np.int64), 65535) for x in own]).astype(np.uint16)
    return out


def may_reach(i: np.ndarray, j: np.ndarray, size: np.ndarray, width: np.ndarray, fold: dict[int, tuple[np.ndarray, np.ndarray]], at_once: int = 8192) -> np.ndarray:
    """Whether the sets i and j can have the least similarity: what each of their sketches' bins may share is the lesser of both counts."""
    low, high = np.minimum(width[i], width[j]), np.maximum(width[i], width[j])
    ok = np.ones(len(i), bool)
    for w, (place, counts) in fold.items():
        rows = np.flatnonzero((low == w) & (high <= 2 * w))
        for s in range(0, len(rows), at_once):
            part = rows[s : s + at_once]
            shared = np.minimum(counts[place[i[part]]], counts[place[j[part]]]).sum(1, dtype=np.int64)
            ok[part] = shared >= SIMILARITY / (1 + SIMILARITY) * (size[i[part]] + size[j[part]]) - 1e-9
    return ok


def prefix_matches(root: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, sketches: list[bytes], reach: int = 0, trees: bool = True, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's rows, in order of size, of different roots, with enough left in both from the shared shingle on and sketches that allow the similarity.

    With ``reach`` only so near. With ``trees`` a spanning forest of the roots: as many pairs at most as rows.
    """
    left, label, width, fold = size - pos, root.copy(), np.array([len(x) for x in sketches]), folded(sketches)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(root), block):
        end = min(at + block, len(root))
        last = int(np.searchsorted(size, size[end - 1] / SIMILARITY + 1e-9, "right"))
        last = min(last, end + reach) if reach else last
        for to in range(at, last, 4096):
            stop = min(to + 4096, last)
            a, b = np.arange(at, end)[:, None], np.arange(to, stop)[None, :]
            need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (size[a] + size[b]) - 1e-9)
            near = (a < b) & (b - a <= (reach or len(root))) & (label[a] != label[b]) & (np.minimum(left[a], left[b]) >= need) & ((side[a] != side[b]) | (side[a] < 0))
            i, j = np.nonzero(near)
            i, j = i + at, j + to
            ok = may_reach(i, j, size, width, fold)
            i, j = i[ok], j[ok]
            if trees:
                keep = []
                for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        keep.append(k)
                i, j = i[keep], j[keep]
            if len(i):
                found.append((i, j))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2


def compare_prefixes(rows: DataFrame, reach: int = 0, trees: bool = True) -> DataFrame:
    """rows: bucket, node, root, size, pos, side and sketch. Pairs u < v of nodes that may be similar, see ``prefix_matches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matches(bucket: np.ndarray, node: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            end, root = np.r_[start[1:], len(bucket)], columns[0]
            several = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            found = []
            for s, e in zip(start[several].tolist(), end[several].tolist(), strict=True):
                i, j = prefix_matches(*(c[s:e] for c in columns[:-1]), columns[-1][s:e].tolist(), reach, trees)
                if len(i):
                    found.append((np.minimum(node[i + s], node[j + s]), np.maximum(node[i + s], node[j + s])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []  # the last bucket, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from matches(*(c[:cut] for c in columns))
            held = [tuple(c[cut:] for c in columns)]
        if held:
            yield from matches(*(np.concatenate(c) for c in zip(*held, strict=True)))

    ordered = rows.select("bucket", "node", "root", "size", "pos", "side", "sketch").repartition("bucket").sortWithinPartitions("bucket", "size")
    return ordered.mapInArrow(run, "u long, v long")


def shared_shingles(work: Workspace, each: DataFrame) -> DataFrame:
    """key, node, size, pos and listed: shingles of prefixes that another text has. Most stand in one text alone, and go in the one shuffle of all."""
    rows = each.select("node", "size", "rare", F.posexplode("keys").alias("pos", "key"))
    columns, own = ["key", "node", "size", "pos"], Window.partitionBy("key")
    rare = rows.where("pos < rare").select(*columns).withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own)}).where("low <> high")
    listed = rows.where("pos >= rare").select(*columns, F.lit(True).alias("listed"))
    return work.put(rare.select(*columns, F.lit(False).alias("listed")).union(listed), "shared")


def prefix_pairs(work: Workspace, each: DataFrame, shared: DataFrame, roots: DataFrame, reach: int = 0, trees: bool = True) -> DataFrame:
    """u, v: pairs of texts with different roots that may be similar, by the prefix filter. each: prefixes(); shared: its shared_shingles(); roots: node and root.

    Only shingles whose texts have several roots go further. Each is dealt over a grid by the exact number of its rows, and its rows take their sketches along,
    so a pair that the sketches rule out never leaves the task that compares it.
    """
    rows = shared.join(roots.hint("merge"), "node")
    columns = ["key", "node", "root", "size", "pos"]
    own = Window.partitionBy("key")
    counts = {"n": F.count("*").over(own), "low": F.min("root").over(own), "high": F.max("root").over(own), "sizes": F.sum("size").over(own), "places": F.sum("pos").over(own)}
    # Most such shingles are of two texts, whose sizes and places are all that the first tests need.
    left, other = F.col("size") - F.col("pos"), F.col("sizes") - F.col("size") - (F.col("places") - F.col("pos"))
    enough = F.least(left, other) >= F.ceil(SIMILARITY / (1 + SIMILARITY) * F.col("sizes") - 1e-9)
    rare = rows.where("not listed").select(*columns).withColumns(counts).where((F.col("low") != F.col("high")) & ((F.col("n") > 2) | enough)).select(*columns, "n")
    frequent = rows.where("listed").select(*columns)
    several = frequent.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "n")
    mixed = work.put(rare.union(attach(frequent, work.put(several, "several"), ["key"], "node").select(*columns, "n")), "mixed")
    # A text's shingles that go further and its sketch meet once; a sketch is a fifth of a byte for each shingle.
    met = mixed.join(each.groupBy("node").agg(F.first("sketch").alias("sketch")).hint("merge"), "node")
    cells = grid(met, F.col("key"), F.col("n"), F.col("node"), BUCKET, "node", "root", "size", "pos", "sketch")
    out = work.put(compare_prefixes(cells, reach, trees).distinct(), "pairs")
    work.drop(mixed)
    return out


def reaches(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this similarity; two empty sets are alike."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def similar_pairs(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a spanning forest of the pairs at or above the similarity, and each set's root.

    Only pairs that share a hash of their prefixes (the smallest hashes) are compared, and only where not yet connected.
    """
    n, links = len(sets), []
    if not n:
        return links, np.empty(0, np.int64)
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    first = [sets[k][: len(sets[k]) - math.ceil(least * len(sets[k]) - 1e-9) + 1] for k in order]
    owner = np.repeat(np.arange(n), [len(x) for x in first])
    keys = np.concatenate(first)
    by = np.argsort(keys, kind="stable")
    keys, owner = keys[by], owner[by]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    end = np.r_[start[1:], len(keys)]
    meet = np.zeros((n, n), bool)
    meet[np.ix_(size == 0, size == 0)] = True
    for s, e in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
        meet[np.ix_(owner[s:e], owner[s:e])] = True
    root = np.arange(n)
    for i in range(n):
        # At least as large, but not so much larger that the similarity can't be reached.
        last = int(np.searchsorted(size, size[i] / least + 1e-9, "right"))
        for j in (np.flatnonzero(meet[i, i + 1 : last] & (root[i + 1 : last] != root[i])) + i + 1).tolist():
            if root[j] != root[i] and reaches(sets[order[i]], sets[order[j]], least):
                root[root == root[j]] = root[i]
                links.append((int(order[i]), int(order[j])))
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return links, out


def compare_sets(rows: DataFrame) -> DataFrame:
    """rows: bucket, by, part, node, hashes; each bucket of bounded size. u, v and part: each near copy and the smallest of those linked to it in the bucket, as a tree; for buckets that are a part of ``by``, also a node of each component (v null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, by, part, nodes, sets = None, 0, False, [], []

        def links() -> pa.RecordBatch:
            root = similar_pairs(sets)[1]
            least: dict[int, str] = {}
            for node, r in zip(nodes, root.tolist(), strict=True):
                least[r] = min(node, least.get(r, node))
            out = [(node, least[r]) for node, r in zip(nodes, root.tolist(), strict=True) if node != least[r]]
            if part:
                out += [(node, None) for node in least.values()]
            return pa.RecordBatch.from_arrays([pa.array([by] * len(out), pa.int64()), *(pa.array([p[k] for p in out], pa.string()) for k in (0, 1)), pa.array([part] * len(out), pa.bool_())], ["by", "u", "v", "part"])

        for batch in batches:
            for b, of, p, node, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if b != bucket:
                    yield links()
                    bucket, by, part, nodes, sets = b, of, p, [], []
                elif node == nodes[-1]:  # the same row again
                    continue
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
        yield links()

    ordered = rows.select("bucket", "by", "part", "node", "hashes").repartition("bucket").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(run, "by long, u string, v string, part boolean")


def grid(rows: DataFrame, by: Column, n: Column, node: Column, chunk: int, *keep: str) -> DataFrame:
    """Each group's rows in cells of chunk pairs: bucket, side (-1 within a chunk, else 0 or 1) and the kept columns."""
    x = rows.select(by.alias("by"), node.alias("key"), F.ceil(n / chunk).alias("of"), *keep).withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(chunk)), F.col("of")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), -1).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    return x.select(F.xxhash64("by", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("bucket"), side.alias("side"), *keep)


def linked_sets(work: Workspace, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets: node, hashes and groups (structs of root and size n).

    The stars of groups up to SETS, which meet whole; links that connect most near copies of larger ones; and the nodes of those.
    """

    def chunks(rows: DataFrame, k: int) -> DataFrame:
        of = F.ceil(F.col("n") / SETS)
        chunk = F.pmod(F.xxhash64("node", F.lit(k)), of)
        return rows.select(F.xxhash64("by", chunk, F.lit(k)).alias("bucket"), "by", (F.col("n") > SETS).alias("part"), "node", "hashes")

    placed = sets.select("node", "hashes", F.explode("groups").alias("g")).select("node", "hashes", F.col("g.root").alias("by"), F.col("g.n").alias("n"))
    more = placed.where(F.col("n") > SETS)
    large = work.put(more.select("node").distinct(), "large")
    first = work.put(compare_sets(chunks(placed, 0)), "linked")
    found, before, heads = [first.where("part")], math.inf, first.where("v IS NULL").select("by", F.col("u").alias("node"))
    while (n := heads.count()) and n <= before / 2:
        sizes = heads.groupBy("by").agg(F.count("*").alias("n")).where("n > 1")
        rows = heads.join(sizes, "by").join(more.select("by", "node", "hashes"), ["by", "node"])
        linked = work.put(compare_sets(chunks(rows, len(found)).withColumn("part", F.lit(True))), "linked")
        found.append(linked)
        before, heads = n, linked.where("v IS NULL").select("by", F.col("u").alias("node"))
    edges = work.put(reduce(DataFrame.union, (x.where("v IS NOT NULL").select("u", "v") for x in found)), "edges")
    return first.where("NOT part").select("u", "v"), edges, large


def fingerprint_groups(work: Workspace, texts: DataFrame) -> DataFrame:
    """node and root of each text: texts with fingerprints within WORD_TAU bits in some kind have one root. texts: node and fingerprints of all kinds."""
    columns = fingerprint_columns(KINDS)
    links = link(work, [texts.select(F.col(c).alias("fp")).distinct() for c in columns], WORD_TAU)
    # A text ties its fingerprints of all kinds together. Most texts have no link and share none of theirs: they need no tie.
    each = texts.select("node", F.explode(F.array_distinct(F.array(*columns))).alias("fp"))
    linked = links.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    several = each.groupBy("fp").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("fp")
    active = each.join(linked.union(several).distinct().hint("merge"), "fp", "left_semi").select("node").distinct()
    tied = work.put(texts.select("node", *columns).join(active.hint("merge"), "node"), "tied")
    ties = tied.select(F.explode(F.array_distinct(F.array(*(F.struct(F.least("fp", c).alias("u"), F.greatest("fp", c).alias("v")) for c in columns[1:])))).alias("t")).select("t.*").where("u <> v")
    found = stars(work, links.union(ties).distinct())
    named = tied.select("node", "fp").join(found.select(F.col("u").alias("fp"), F.col("v").alias("to")).hint("merge"), "fp", "left").select("node", F.coalesce("to", "fp").alias("to"))
    out = work.put(texts.select("node", "fp").join(named.hint("merge"), "node", "left").select("node", F.coalesce("to", "fp").alias("root")).dropDuplicates(["node"]), "roots")
    work.drop(links, found, tied)
    return out


def similar_texts(work: Workspace, df: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each distinct text: digest, its smallest doc_id ``first`` and its group. docs: fingerprints of df's word sets."""
    columns = fingerprint_columns(KINDS)
    texts = work.put(docs.groupBy("digest").agg(F.min("doc_id").alias("first"), *(F.min(c).alias(c) for c in columns)).withColumn("node", F.xxhash64("digest")), "texts")
    roots = fingerprint_groups(work, texts)
    frequent = frequent_shingles(df)
    each = work.put(prefixes(df, frequent), "prefixes")
    shared = shared_shingles(work, each)
    pairs = prefix_pairs(work, each, shared, roots)
    if not pairs.isEmpty():
        of = [roots.select(F.col("node").alias(e), F.col("root").alias(f"{e}_root")) for e in "uv"]
        apart = pairs.join(of[0].hint("merge"), "u").join(of[1].hint("merge"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct()
        found = stars(work, work.put(apart, "apart"))
        wider = work.put(roots.join(found.select(F.col("u").alias("root"), F.col("v").alias("to")).hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        work.drop(found, roots)
        roots = wider
    work.drop(pairs, each, shared)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    grouped = attach(roots, work.put(sizes, "sizes"), ["root"], "node")
    candidates = work.put(texts.select("node", "digest", "first").join(grouped.hint("merge"), "node").select("digest", "first", F.array(F.struct("root", "n")).alias("groups")), "candidates")
    # A candidate's text is that of its first row; where a doc_id is null or repeated, the digest tells the right one.
    # Candidates grow with the corpus: both sides meet by a sorted shuffle at every size, never by a broadcast. Most rows are none of them, and a bitmap of bounded size says so.
    digested = text_bytes(df, "doc_id").withColumn("own", digest_of(F.col("text")))
    likely = marked(work, digested, F.xxhash64("own"), candidates.select(F.xxhash64("digest").alias("hash")), "likely").where("likely")
    whole = likely.join(candidates.hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("own") == F.col("digest")))
    sets = work.put(shingle_sets(whole.select(F.col("digest").alias("node"), "groups", "text")), "sets")
    found, edges, large = linked_sets(work, sets)
    if not large.isEmpty():
        found = found.union(large_groups(work, sets.join(large, "node", "left_semi").dropDuplicates(["node"]), edges, frequent))
    work.drop(candidates, large, roots)
    out = work.put(texts.join(found.select(F.col("u").alias("digest"), "v").hint("merge"), "digest", "left").select("digest", "first", F.coalesce("v", "digest").alias("group")), "groups")
    work.drop(texts, edges, sets)
    return out


def large_groups(work: Workspace, sets: DataFrame, edges: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """u, v: each of these sets' nodes but the smallest of its group, and that. All pairs that edges don't connect are found by the prefix filter, neighbours first, and compared one by one."""
    own = work.put(sets.select("node", F.xxhash64("node").alias("key"), "hashes"), "large-sets")
    each = work.put(prefixes(own.select(F.col("node").alias("digest"), "hashes"), frequent, sets=True), "prefixes")
    shared = shared_shingles(work, each)
    found = stars(work, edges)
    tops = work.put(own.select("node", "key").join(found.select(F.col("u").alias("node"), "v").hint("merge"), "node", "left").select("node", "key", F.coalesce("v", "node").alias("top")), "tops")
    work.drop(found)
    for reach in (NEIGHBOURS, 0):
        pairs = prefix_pairs(work, each, shared, tops.select(F.col("key").alias("node"), F.xxhash64("top").alias("root")), reach, trees=False)
        if pairs.isEmpty():
            continue
        placed = pairs.select(F.xxhash64("u", "v").alias("by"), F.explode(F.array("u", "v")).alias("key")).join(own.hint("merge"), "key")
        links = compare_sets(placed.select(F.col("by").alias("bucket"), "by", F.lit(False).alias("part"), "node", "hashes"))
        of = [tops.select(F.col("node").alias(e), F.col("top").alias(f"{e}_top")) for e in "uv"]
        apart = links.join(of[0].hint("merge"), "u").join(of[1].hint("merge"), "v").select(F.greatest("u_top", "v_top").alias("u"), F.least("u_top", "v_top").alias("v")).where("u <> v").distinct()
        between = work.put(apart, "between")
        if not between.isEmpty():
            found = stars(work, between)
            wider = work.put(tops.join(found.select(F.col("u").alias("top"), "v").hint("merge"), "top", "left").select("node", "key", F.coalesce("v", "top").alias("top")), "tops")
            work.drop(found, tops)
            tops = wider
        work.drop(pairs, between)
    work.drop(own, each, shared)
    return tops.where("node <> top").select(F.col("node").alias("u"), F.col("top").alias("v"))


def similar_groups(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A row for each row of df: doc_id, digest of its text, and component_id, the smallest doc_id of its group of copies and near copies."""
    work = Workspace(spark, "copies")
    docs = work.put(fingerprints(df, word_hashes, KINDS), "fingerprints")
    groups = similar_texts(work, df, docs)
    ids = work.put(with_least(groups, "group", "first", "component_id", "digest").select("digest", "component_id"), "ids")
    work.drop(groups)
    return docs.join(ids, "digest").select("doc_id", "digest", "component_id")


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row of each group of copies and near copies: that of the smallest doc_id (nulls last), then of the least digest of its text.

    Of rows that repeat that doc_id and text the least stays, by its plain columns in order. A null text counts as empty.
    """
    work = Workspace(spark, "copies")
    docs = work.put(fingerprints(df, word_hashes, KINDS), "fingerprints")
    groups = similar_texts(work, df, docs)
    place = groups.groupBy("group").agg(F.min(F.struct(F.isnull("first").alias("unnamed"), "first", "digest")).alias("least"))
    left = work.put(place.select(F.col("least.first").alias("first"), F.col("least.digest").alias("digest")), "left")
    own = "own_digest"
    while own in df.columns:
        own += "_"
    rows = df.withColumn(own, digest_of(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    # What goes is found from narrow rows. A bitmap of it lets all rows that it clears stay where they are.
    key = lambda id_, digest: F.xxhash64(F.coalesce(F.col(id_), F.lit(-1)), digest)
    gone = docs.join(left.hint("merge"), docs["doc_id"].eqNullSafe(left["first"]) & (docs["digest"] == left["digest"]), "left_anti").select(key("doc_id", "digest").alias("hash"))
    mark = "gone_mark"
    while mark in rows.columns:
        mark += "_"
    flagged = marked(work, rows, key("doc_id", own), gone, mark)
    doubtful = flagged.where(F.col(f"`{mark}`")).drop(mark).alias("rows")
    stay = doubtful.join(left.hint("merge").alias("left"), F.col(f"rows.{own}").eqNullSafe(F.col("left.digest")) & F.col("rows.doc_id").eqNullSafe(F.col("left.first")), "left_semi")
    out = flagged.where(~F.col(f"`{mark}`")).drop(mark).union(stay)
    repeated = not docs.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    work.drop(groups, docs)
    if repeated:
        plain = F.struct(*(F.col(f"`{c.name}`") for c in df.schema if c.dataType.typeName() not in ("map", "variant")))
        out = out.groupBy("doc_id", own).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), plain).alias("row")).select("row.*")
    return out.drop(own)

"""Quality rules as a bitmask ledger, in Spark expressions only.

``ledger`` evaluates every rule once for each document and stores its measurements and one long of failure
bits. A policy is a version and the mask of the rules that it applies; verdicts and ablations come from the
stored bits by bitwise operations, without the texts.

Words are runs of characters other than blank and 0x09-0x0D. Windows of five words are compared by 64-bit
hashes of word hashes (two different windows of one text are taken for equal with probability 2^-64).

Rows: a null text has no words, so it fails ``few_words``. Empty texts likewise. Repeated rows and null ids
stay, row by row. Other columns pass through ``ledger`` untouched; the ledger is one struct column, whose
name the caller picks. The cost of a text is n log n in its words; texts of any length count whole. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import Workspace

#: The word separators as a Java pattern and as characters.
SEPARATORS, SEPARATOR_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r"
WINDOW = 5
#: Rules by name; the place in this list is the bit. Each is a condition on the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "shouting": "100 * n_shouts > 25 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeat_words"]
#: Policies by version.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["shouting"], 3: sum(BIT.values())}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(df: DataFrame, name: str = "ledger") -> DataFrame:
    """All columns of df and the struct ``name``: the measurements (long) and ``failures``, the bits of the rules that fail."""
    at = lambda xs, i: F.get(xs, i)
    none = F.array().cast("array<bigint>")
    x = df.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    x = x.select("row", "t", F.btrim("t", F.lit(SEPARATOR_CHARS)).alias("trimmed"))
    x = x.select("row", "t", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SEPARATORS)).alias("words"))
    x = x.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.endswith("!!"))).cast("long").alias("n_shouts"),
        F.filter(F.split("t", "\n", -1), lambda s: F.btrim(s, F.lit(SEPARATOR_CHARS)) != "").alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    window = F.transform(F.slice("hashes", 1, F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(at(F.col("hashes"), i + k) for k in range(1, WINDOW))))
    x = x.withColumn("windows", F.when(F.size("hashes") >= WINDOW, window).otherwise(none))
    x = x.withColumn("sorted", F.sort_array("windows"))
    # Only texts with a window that occurs twice go on to places: sorted by hash, those with an equal neighbour, by place.
    x = x.withColumn("repeats", F.exists(F.transform("sorted", lambda h, i: h == at(F.col("sorted"), i + 1)), lambda b: b))
    x = x.withColumn("placed", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda p, k: F.coalesce(p["h"] == at(F.col("placed"), k)["h"], F.lit(False))
    x = x.withColumn("twice", F.sort_array(F.transform(F.filter("placed", lambda p, k: equal(p, k - 1) | equal(p, k + 1)), lambda p: p["i"])))
    # Words under those windows: each adds what the one before does not cover.
    covered = F.transform("twice", lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - at(F.col("twice"), k - 1))))
    x = x.withColumn("n_repeat_words", F.when(F.col("repeats"), F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)).otherwise(F.lit(0).cast("long")))
    x = x.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    bits = sum((F.when(F.expr(rule), F.lit(BIT[k])).otherwise(F.lit(0)).cast("long") for k, rule in RULES.items()), F.lit(0).cast("long"))
    # Through a generator: else a filter on the bits would be pushed down with all of the above written out in it, many times over.
    return x.select("row", F.explode(F.array(F.struct(*MEASURES, bits.alias("failures")))).alias("ledger")).select("row.*", F.col("ledger").alias(name))


def passes(failures: Column, policy: int) -> Column:
    return failures.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(ledgers: DataFrame, policy: int, name: str = "ledger") -> DataFrame:
    """For each rule of a policy: the documents that fail it, those that only it rejects, and the bits that ever fail beside it.

    Equal failure bits are counted first, so at most 2^rules rows move.
    """
    seen = F.col(f"{name}.failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    counts = ledgers.select(seen.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BIT.items() if b & POLICIES[policy])))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0).cast("long")).alias("with_bits"),
    )


def verdicts(df: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """doc_id, the measurements, base_failed, kept and the failure bits."""
    got = ledger(df.select("doc_id", "text"), "q").select("doc_id", "q.*")
    base = ~passes(F.col("failures"), 1)
    return got.select("doc_id", *MEASURES, "failures", base.alias("base_failed"), (~base & passes(F.col("failures"), policy)).alias("kept"))


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The ledger is stored once; from its bits come every policy's verdict (kept_v1 and on; ``kept`` is the latest's) and an ablation.

    sole_rule: the one rule of the latest policy that rejects the document, if there is just one; n_sole: how many documents the
    corpus would gain without that rule.
    """
    latest = max(POLICIES)
    stored = Workspace(spark, "ledger").put(ledger(df.select("doc_id", "text"), "q").select("doc_id", "q"), "ledger")
    failures = F.col("q.failures")
    seen = failures.bitwiseAND(F.lit(POLICIES[latest]).cast("long"))
    gains = ablations(stored, latest, "q").select(F.col("bit").alias("seen"), F.col("rule").alias("sole_rule"), F.col("n_only").alias("n_sole"))
    versions = [passes(failures, v).alias(f"kept_v{v}") for v in POLICIES]
    x = stored.select("doc_id", "q.*", (~passes(failures, 1)).alias("base_failed"), (passes(failures, 1) & passes(failures, latest)).alias("kept"), *versions, seen.alias("seen"))
    return x.join(F.broadcast(gains), "seen", "left").drop("seen")  # a row for each rule, 63 at most


def keep(df: DataFrame, policy: int = max(POLICIES)) -> DataFrame:
    """The rows of df that the policy passes, with df's columns."""
    name = "ledger"
    while name in df.columns:
        name += "_"
    return ledger(df, name).where(passes(F.col(f"{name}.failures"), policy)).drop(name)


def sql() -> str:
    """The report in DuckDB's SQL."""
    versions = ", ".join(f"(failures & {m}) = 0 AS kept_v{v}" for v, m in POLICIES.items())
    names = " ".join(f"WHEN {b} THEN '{k}'" for k, b in BIT.items() if b & POLICIES[max(POLICIES)])
    bits = ", ".join(str(b) for b in BIT.values() if b & POLICIES[max(POLICIES)])
    word, rules = r"[^\x20\x09-\x0D]", " | ".join(f"(CASE WHEN {rule} THEN {BIT[k]} ELSE 0 END)" for k, rule in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}+') AS ws, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{word}')) AS ls FROM d),
g AS (SELECT doc_id, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM
      (SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS wins FROM w WHERE len(ws) >= 5)),
p AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(5, coalesce(i - j, 5))) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM p) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(ws, lambda x: suffix(x, '!!'))) AS BIGINT) AS n_shouts, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({rules} AS BIGINT) AS failures FROM m)
SELECT *, (failures & {BASE}) <> 0 AS base_failed, (failures & {POLICIES[max(POLICIES)]}) = 0 AS kept, {versions},
CASE failures & {POLICIES[max(POLICIES)]} {names} END AS sole_rule,
CASE WHEN (failures & {POLICIES[max(POLICIES)]}) IN ({bits}) THEN count(*) OVER (PARTITION BY failures & {POLICIES[max(POLICIES)]}) END AS n_sole FROM f"""

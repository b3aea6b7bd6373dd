"""Mixing sources to target weights over a domain-language-source tree, in Spark expressions only.

The budget of tokens flows from the root down. At each node it is dealt among the children by weight; a child
whose documents can't fill its share gives the shortage to its siblings, again by weight (water-filling).
A node never gets more than its whole subtree holds, so a shortage leaves a node only when the siblings
below can't take it, and then goes to the node's own siblings. Shares are whole tokens, rounded down.

A leaf that gets more tokens than it has repeats all its documents in whole epochs, up to ``max_epochs``. The
rest of its share is a prefix of one more epoch: documents ordered by md5 of seed, epoch and doc_id, as long as
their running tokens stay within the share. The cut is found by digits of that order: token sums of 256
buckets for each leaf, then of 4,096 within the bucket in which the share ends, and only the documents
of that last bucket are put in order. So no task holds a leaf's documents, whatever the leaf's size.

Tokens are words (runs of characters other than blank and 0x09-0x0D).

A node of weight 0 or less gets nothing, and nothing of its siblings' shortage; its documents are left out.

No task holds all siblings of a node either: they are put in order within bands of room for each unit of weight, after sums of
the bands before. Documents and other rows meet their leaf's or parent's line by (key, salt), so a key with a third of all rows is many tasks';
where Spark finds the lines small it sends them around, and texts stay where they are.

Rows: a null text has no tokens; null lang, source or doc_id count as the empty string. Documents without
tokens come with their leaf's prefix as any other. Rows with one doc_id in a leaf share their place and are taken
together: they are summed before places are put in order. Texts of any length count whole. Weights that aren't listed are 1. Columns of
any name pass through ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.llm.common import Workspace, attach
from quarry.llm.quality import SEPARATOR_CHARS, SEPARATORS

LEVELS = ("domain", "language", "origin")
#: Hex digits of the order that each round of the search for the cut reads.
DIGITS = (2, 3)
#: Bands of siblings for each doubling of their room by weight.
BANDS = 64
#: The domain of a document, in SQL both engines know: one crawl, then two kinds of site by the number of digits.
DOMAIN = "CASE WHEN coalesce(source, '') = 'src0' THEN 'crawl' WHEN length(coalesce(source, '')) <= 4 THEN 'forum' ELSE 'reference' END"


@dataclass(frozen=True)
class Mix:
    """Weights by level and name (1 if not listed), budget as a fraction of all tokens, epochs at most, seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"crawl": 3, "forum": 2, "reference": 5}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "origin": {}})
    budget: tuple[int, int] = (3, 4)
    max_epochs: int = 4
    seed: int = 17
    domain: str = DOMAIN


def n_tokens(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, SEPARATORS))).cast("long")


def leaf(mix: Mix) -> list[Column]:
    return [F.expr(mix.domain).alias("domain"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("origin")]


def place(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch's order."""
    return F.md5(F.concat(F.lit(f"{mix.seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _deal(work: Workspace, nodes: DataFrame, parent: list[str], child: str, weights: dict[str, int]) -> DataFrame:
    """nodes has parent, child, room (tokens it can take) and the parent's budget; gives each child of some weight its own budget."""
    w = F.lit(1).cast("long")
    for name, v in weights.items():
        w = F.when(F.col(child) == name, F.lit(v).cast("long")).otherwise(w)
    x = nodes.withColumn("w", w).where("w > 0").withColumn("ratio", F.col("room").cast("double") / F.col("w"))
    x = x.withColumn("band", F.when(F.col("ratio") > 0, F.floor(F.log2("ratio") * BANDS)).otherwise(F.lit(-(10**6)).cast("long")))
    x = work.put(x, "nodes")
    # The fullest relative to their weight run out first. Before each: what those took, and what weight is left.
    sums = x.groupBy(*parent, "band").agg(F.sum("room").alias("band_room"), F.sum("w").alias("band_w"))
    whole = Window.partitionBy(*(parent or [F.lit(0)]))
    to = whole.orderBy("band")
    sums = sums.select(*parent, "band", (F.sum("band_room").over(to) - F.col("band_room")).alias("room_before"), (F.sum("band_w").over(whole) - F.sum("band_w").over(to) + F.col("band_w")).alias("w_from"))
    x = attach(x, work.put(sums, "bands"), [*parent, "band"], child)
    near = Window.partitionBy(*parent, "band").orderBy("ratio", child)
    left = F.col("budget") - F.col("room_before") - (F.sum("room").over(near) - F.col("room"))
    rest = F.col("w_from") - (F.sum("w").over(near) - F.col("w"))
    x = x.withColumn("left", left).withColumn("rest", rest)
    x = work.put(x.withColumn("full", F.col("room") <= F.expr("(left * w) div rest")), "nodes")
    # The first that isn't full sets the level for itself and all after it.
    stop = F.min(F.when(~F.col("full"), F.struct("ratio", F.col(child).alias("child"), "left", "rest"))).alias("level")
    if parent:
        x = attach(x, work.put(x.groupBy(*parent).agg(stop), "levels"), parent, child)
    else:  # a few domains
        x = x.withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", F.col(child).alias("child"), "left", "rest"))).over(whole))
    before = F.col("level").isNull() | (F.struct("ratio", F.col(child).alias("child")) < F.struct("level.ratio", F.col("level.child").alias("child")))
    return x.select(*parent, child, F.when(before, F.col("room")).otherwise(F.expr("(level.left * w) div level.rest")).alias("budget"))


def budgets(work: Workspace, leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, language, origin, tokens. Adds each leaf's budget; leaves under a node without weight go."""
    rooms = leaves.withColumn("room", F.col("tokens") * mix.max_epochs)
    at: DataFrame | None = None
    for k, child in enumerate(LEVELS):
        parent = list(LEVELS[:k])
        nodes = rooms.groupBy(*parent, child).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
        if parent:
            nodes = attach(work.put(nodes, "nodes"), at, parent, child)
        else:  # the whole budget, on every child of the root: a few domains
            whole = F.sum("tokens").over(Window.partitionBy(F.lit(0))) * mix.budget[0]
            nodes = nodes.withColumn("whole", whole).withColumn("budget", F.expr(f"whole div {mix.budget[1]}"))
        at = work.put(_deal(work, nodes, parent, child, mix.weights.get(child, {})), "budgets")
    return leaves.join(at, list(LEVELS))


def cuts(spark: SparkSession, df: DataFrame, mix: Mix) -> DataFrame:
    """A row for each leaf: tokens, budget, whole epochs, and the last place of the next epoch that still counts."""
    work = Workspace(spark, "mixing")
    docs = work.put(df.select("doc_id", *leaf(mix), n_tokens(F.col("text")).alias("n")), "docs")
    leaves = work.put(docs.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves")
    at = budgets(work, leaves, mix).withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    at = at.withColumn("open", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("prefix", F.lit(""))
    at = work.put(at, "leaves")
    for digits in DIGITS:
        # Sums of the buckets in the open range; the share ends in the first one whose running sum exceeds what is open.
        inside = attach(docs, at, list(LEVELS), "doc_id").withColumn("place", place(mix, F.col("epochs"), F.col("doc_id")))
        inside = inside.where(F.col("place").startswith(F.col("prefix")))
        sums = inside.groupBy(*LEVELS, F.substr("place", F.length("prefix") + 1, F.lit(digits)).alias("digits")).agg(F.sum("n").alias("n"))
        run = sums.withColumn("run", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("digits"))).join(at.select(*LEVELS, "open"), list(LEVELS))
        end = run.where(F.col("run") > F.col("open")).groupBy(*LEVELS).agg(F.min(F.struct("digits", (F.col("run") - F.col("n")).alias("before"))).alias("end"))
        at = at.join(end, list(LEVELS), "left").withColumns({"prefix": F.concat("prefix", F.coalesce("end.digits", F.lit("~"))), "open": F.col("open") - F.coalesce("end.before", F.lit(0))}).drop("end")
        at = work.put(at, "leaves")
    inside = attach(docs, at, list(LEVELS), "doc_id").withColumn("place", place(mix, F.col("epochs"), F.col("doc_id")))
    placed = inside.where(F.col("place").startswith(F.col("prefix"))).groupBy(*LEVELS, "place", "open").agg(F.sum("n").alias("n"))
    run = placed.withColumn("run", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place")))
    last = run.where(F.col("run") <= F.col("open")).groupBy(*LEVELS).agg(F.max("place").alias("last"))
    out = work.put(at.join(last, list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", F.coalesce("last", "prefix").alias("cut")), "cuts")
    work.drop(docs)
    return out


def mixed(spark: SparkSession, df: DataFrame, mix: Mix) -> DataFrame:
    """All rows that the mix takes: df's columns as the struct ``row``, the leaf, and ``copies``, the epochs that take it."""
    ends = cuts(spark, df, mix)
    rows = df.select(F.struct("*").alias("row"), *leaf(mix), F.col("doc_id").alias("__id"))
    more = (place(mix, F.col("epochs"), F.col("__id")) <= F.col("cut")) & (F.col("epochs") < mix.max_epochs)
    x = attach(rows, ends, list(LEVELS), "__id").withColumn("copies", F.col("epochs") + more.cast("long"))
    return x.where(F.col("copies") > 0).select("row", *LEVELS, "copies")


def report(spark: SparkSession, df: DataFrame, mix: Mix) -> DataFrame:
    """A row for each document taken: doc_id, domain, language, origin, n_tokens, copies."""
    return mixed(spark, df.select("doc_id", "lang", "source", "text"), mix).select("row.doc_id", *LEVELS, n_tokens(F.col("row.text")).alias("n_tokens"), "copies")


def keep(spark: SparkSession, df: DataFrame, mix: Mix) -> DataFrame:
    """df's columns, each row as often as the mix takes it."""
    x = mixed(spark, df, mix)
    if mix.max_epochs > 1:
        x = x.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return x.select("row.*")


def sql(mix: Mix) -> str:
    """The report in DuckDB's SQL."""
    levels, steps, of = [], [], f"SELECT (sum(tokens) * {mix.budget[0]}) // {mix.budget[1]} AS budget FROM leaves"
    steps.append(f"b0 AS ({of})")
    for k, child in enumerate(LEVELS):
        parent, levels = list(LEVELS[:k]), [*LEVELS[: k + 1]]
        by = f"PARTITION BY {', '.join(parent)}" if parent else ""
        w = " ".join(f"WHEN {child} = '{n}' THEN {v}" for n, v in mix.weights.get(child, {}).items())
        w = f"CASE {w} ELSE 1 END" if w else "1"
        keys = ", ".join(levels)
        steps += [
            f"n{k} AS (SELECT {keys}, CAST(sum(tokens) * {mix.max_epochs} AS BIGINT) AS room, CAST({w} AS BIGINT) AS w FROM leaves GROUP BY {keys} HAVING {w} > 0)",
            f"""x{k} AS (SELECT *, budget - (sum(room) OVER near - room) AS lft, sum(w) OVER ({by}) - (sum(w) OVER near - w) AS rest, row_number() OVER near AS k
                FROM n{k} {'JOIN b' + str(k) + ' USING (' + ', '.join(parent) + ')' if parent else 'CROSS JOIN b0'} WINDOW near AS ({by} ORDER BY CAST(room AS DOUBLE) / w, {child}))""",
            f"y{k} AS (SELECT *, min(CASE WHEN room > (lft * w) // rest THEN k END) OVER ({by}) AS stop FROM x{k})",
            f"""b{k + 1} AS (SELECT {keys}, CAST(CASE WHEN stop IS NULL OR k < stop THEN room ELSE
                (min(CASE WHEN k = stop THEN lft END) OVER ({by}) * w) // min(CASE WHEN k = stop THEN rest END) OVER ({by}) END AS BIGINT) AS budget FROM y{k})""",
        ]
    keys = ", ".join(LEVELS)
    return rf"""
WITH d AS (SELECT doc_id, {mix.domain} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT {keys}, sum(n_tokens) AS tokens FROM d GROUP BY {keys}),
{', '.join(steps)},
l AS (SELECT {keys}, tokens, budget, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS BIGINT) ELSE 0 END AS epochs FROM leaves JOIN b3 USING ({keys})),
r AS (SELECT d.*, epochs, budget - epochs * tokens AS open, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY md5('{mix.seed}|' || epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS run FROM d JOIN l USING ({keys}))
SELECT doc_id, {keys}, n_tokens, CAST(epochs + CASE WHEN run <= open AND epochs < {mix.max_epochs} THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r WHERE epochs > 0 OR run <= open"""

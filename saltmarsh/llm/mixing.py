"""Operator 9: mixing sources to target weights, to the word. Native.

Every document gets a hash-random key; the documents are range-sorted by source and key, prefix sums of their sizes are
computed over the ranges, and each source is cut at its exact budget: whole passes over the source first (epochs),
then the documents whose prefix fits, then as many words of the next one as are left. Prefix sums come from
``bucketed.py``: no task holds a whole source, and a hot source or id has many ranges. Texts are not shuffled.

The budget: sources by code point, null last, weigh 1, 2, 3, 1, ... and share ``share`` of all words; a source's target
stops at ``most`` times its size and the excess is shared again by weight among the rest, until none is above.

Defined results: a null or blank text has size 0 and takes 0 words; a null source is a source of its own; repeated rows
count each; ties of the key go by doc_id, then size, then the row's place in the table; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bucketed import group_key, ranges_for, running
from .common import WORD, hash_key, written

SEED, MOST = "mix-1", 3
#: What a source's rows are sorted by.
ORDER = ["key", "doc_id", "size", "row"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(src, source_size) -> with weight and target, by the sorted thresholds of water filling, in one pass.

    A source is capped when the level (words a unit of weight) exceeds most * size / weight. Sorted by that ratio, the
    capped sources are a prefix; the level after capping the first k is (total - their caps) / (weight of the rest).
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("src")
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    # One row a source: the small side of everything here.
    x = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumns({"total": F.sum("source_size").over(every) * F.lit(float(share)), "weights": F.sum("weight").over(every)})
    x = x.withColumns({"caps_before": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)), "weights_before": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))})
    x = x.withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
    # The level at the first source that stays below its cap is the level of all that do.
    x = x.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"])
    return x.select("src", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def measured(df: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, src, size, key, row, and the columns of keep), written; row tells rows apart."""
    columns = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        group_key(F.col(source_col)).alias("src"),
        n_words(F.col(text_col)).alias("size"),
        hash_key(seed, F.col(id_col)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    ]
    return written(df.select(*columns, *keep), "mix-rows")


def budgeted(rows: DataFrame, share: float = 1.0, most: float = MOST) -> DataFrame:
    """Measured rows, without what they keep, with source_size, target, epochs (whole passes) and partial (words of the
    last pass, which takes the first rows by ORDER)."""
    rows = rows.select("source", "src", *ORDER)
    n = ranges_for(rows.count())
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = sizes.join(targets(sizes, share, most), "src")
    x = running(rows, ["src"], ORDER, F.col("size"), "before", n).join(plan, "src").withColumn("budget", F.round("target").cast("long"))
    rest = F.col("budget") % F.greatest(F.col("source_size"), F.lit(1))
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return x.withColumns({"epochs": F.expr("budget div greatest(source_size, 1L)"), "partial": partial})


def mix(df: DataFrame, share: float = 1.0, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): how many words of each row the mix takes, repeats counted."""
    x = budgeted(measured(df, seed, id_col, text_col, source_col), share, most)
    return x.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("partial")).cast("long").alias("taken"))


def repeated(df: DataFrame, share: float = 1.0, most: float = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows, each as often as the mix takes it: the row at a source's cut is kept whole, rows without words stay once.

    A source's passes and cut are one row, so rows are judged by their own key: nothing is joined row by row, no text is
    shuffled unless the sources are too many to broadcast.
    """
    rows = measured(df, seed, id_col, text_col, source_col, tuple(c for c in df.columns if c not in (id_col, source_col)))
    last = F.max(F.when(F.col("partial") > 0, F.struct(*ORDER)))
    cuts = written(budgeted(rows, share, most).groupBy("src").agg(F.first("epochs").alias("epochs"), last.alias("cut")), "cuts")
    once_more = F.coalesce(F.struct(*ORDER) <= F.col("cut"), F.lit(False)).cast("long")
    copies = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("epochs") + once_more)
    x = rows.join(cuts, "src").withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return x.select(*[F.col({id_col: "doc_id", source_col: "source"}.get(c, c)).alias(c) for c in df.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


SQL = f"""
WITH rows AS MATERIALIZED (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key FROM documents),
sizes AS (SELECT src, sum(size)::BIGINT AS source_size FROM rows GROUP BY src),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS weight, {MOST}.0::DOUBLE * source_size AS cap FROM sizes),
ratios AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighed),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER w, 0)) / (weights - coalesce(sum(weight) OVER w, 0)) AS level FROM ratios
  WINDOW w AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, (ratio, src)) AS final FROM levels WHERE level <= ratio),
plan AS (SELECT src, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM ratios, level),
summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  ((round(target)::BIGINT // greatest(source_size, 1)) * size + greatest(0, least(size, round(target)::BIGINT % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM summed JOIN plan USING (src)
"""

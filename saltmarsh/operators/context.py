"""Context blocks under a byte budget, citations and prompts.

Blocks, their sizes and a running sum come from Column expressions. Which blocks fit whole follows from the running
sum; only the first that doesn't can be cut, and at a known place, so no ordered fold in Python is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FORMATS = ("markdown", "xml", "numbered", "compact")


@dataclass(frozen=True)
class ContextConfig:
    max_chars: int = 4096
    layout: str = "markdown"
    include_scores: bool = True
    include_metadata: bool = True
    header: str | None = None
    truncate_last: bool = True


def _score(template: str, on: bool) -> Column:
    return F.format_string(template, "score") if on else F.lit("")


def meta_summary(config: ContextConfig) -> Column:
    """`` [source: .., category: ..]`` of the columns that are set."""
    if not config.include_metadata:
        return F.lit("")
    fields = F.concat_ws(", ", F.when(F.col("source").isNotNull(), F.concat(F.lit("source: "), "source")), F.when(F.col("category").isNotNull(), F.concat(F.lit("category: "), "category")))
    return F.when(fields == "", F.lit("")).otherwise(F.concat(F.lit(" ["), fields, F.lit("]")))


def block(config: ContextConfig, text: Column) -> Column:
    """Of the columns doc_id, idx (from 1), score, source, category."""
    i, d = F.col("idx").cast("string"), F.col("doc_id").cast("string")
    lit = F.lit
    return {
        "markdown": lambda: F.concat(lit("### ["), i, lit("] "), d, _score(" (Score: %.3f)", config.include_scores), meta_summary(config), lit("\n"), text),
        "xml": lambda: F.concat(lit('  <document id="'), d, lit('" index="'), i, lit('"'), _score(' score="%.3f"', config.include_scores), lit(">\n    "), text, lit("\n  </document>")),
        "numbered": lambda: F.concat(lit("["), i, lit("] ("), d, lit(")"), _score(" [%.3f]", config.include_scores), lit(": "), text),
        "compact": lambda: F.concat(lit("["), i, lit("] "), T.one_line(text)),
    }[config.layout]()


def block_header(config: ContextConfig) -> Column:
    i, d = F.col("idx").cast("string"), F.col("doc_id").cast("string")
    lit = F.lit
    return {
        "markdown": lambda: F.concat(lit("### ["), i, lit("] "), d, _score(" (Score: %.3f)", config.include_scores), lit("\n")),
        "xml": lambda: F.concat(lit('  <document id="'), d, lit('" index="'), i, lit('">\n    ')),
        "numbered": lambda: F.concat(lit("["), i, lit("] ("), d, lit("): ")),
        "compact": lambda: F.concat(lit("["), i, lit("] ")),
    }[config.layout]()


def assemble(hits: DataFrame, config: ContextConfig = ContextConfig()) -> DataFrame:
    """hits (query_id, rank, doc_id, score, text, source, category, url) -> one row a query: context, citations
    (index, doc_id, score, source), doc_count, total_chars (bytes), was_truncated."""
    order = Window.partitionBy("query_id").orderBy("rank")
    head = (config.header + "\n\n") if config.header is not None else ""
    x = hits.withColumn("idx", F.row_number().over(order)).withColumn("text", F.coalesce("text", F.lit("")))
    x = x.withColumn("block", block(config, F.col("text"))).withColumn("size", F.octet_length("block"))
    before = F.coalesce(F.sum(F.col("size") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(head.encode())
    x = x.withColumn("used", before).withColumn("over", F.col("used") + F.col("size") > config.max_chars)
    # All blocks before the first misfit are whole, so its running sum is right; those after it don't count.
    x = x.withColumn("misfits", F.sum(F.col("over").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.where((F.col("misfits") == 0) | ((F.col("misfits") == 1) & F.col("over")))
    header = block_header(config)
    left = F.greatest(F.lit(config.max_chars) - F.col("used"), F.lit(0))
    room = left - F.octet_length(header) - 10
    cut = F.when(room < F.octet_length("text"), F.concat(T.byte_truncate(F.col("text"), room.cast("int")), F.lit("... [truncated]"))).otherwise(F.col("text"))
    piece = F.concat(header, cut, F.lit("\n  </document>" if config.layout == "xml" else ""))
    fits = (left > F.octet_length(header) + 15) if config.truncate_last else F.lit(False)
    x = x.withColumn("shown", F.when(~F.col("over"), F.col("block")).when(fits, piece))
    cite = F.struct(F.col("idx").alias("index"), F.col("doc_id"), F.col("score"), F.coalesce("source", "url").alias("source"))
    g = x.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("idx", "shown")))).alias("blocks"),
        F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), cite))).alias("citations"),
        F.max(F.col("over")).alias("was_truncated"),
    )
    shown = F.transform("blocks", lambda b: b["shown"])
    if config.layout == "xml":
        body = F.concat(F.lit("<context>\n"), F.array_join(F.transform(shown, lambda b: F.concat(b, F.lit("\n"))), ""), F.lit("</context>"))
    else:
        body = F.array_join(shown, "\n\n")
    text = F.concat(F.lit(head), body)
    return g.select("query_id", text.alias("context"), "citations", F.size("blocks").alias("doc_count"), F.octet_length(text).alias("total_chars"), "was_truncated")

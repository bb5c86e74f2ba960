"""Sources and sinks: document batches, evaluation samples, workflows, operation files; text, JSON and TSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAMPLE_SCHEMA = "query string, retrieved_ids array<string>, ground_truth_ids array<string>"
WORKFLOW_SCHEMA = "tasks array<struct<id string, title string, description string, priority string, required_capabilities array<string>, depends_on array<string>>>"


def documents(spark: SparkSession, path: str, multi_line: bool | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A JSON array of documents or JSON lines; without ``multi_line`` told from the first character. Rows without an id
    get batch_doc_{n} by their place."""
    if multi_line is None:
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        multi_line = bool(first) and first[0].value.lstrip().startswith("[")
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("string"))
    at = F.row_number().over(Window.partitionBy(F.col("__file")).orderBy("__at")) - 1
    missing = df.where(F.col("id").isNull()).limit(1)
    if missing.isEmpty():
        return df
    df = df.withColumns({"__at": F.monotonically_increasing_id(), "__file": F.input_file_name()}).withColumn("__n", at)
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("batch_doc_"), F.col("__n").cast("string")))).drop("__at", "__file", "__n")


def metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """The column, a JSON text or struct, as VARIANT with scalar values only; decimals become doubles on reading."""
    text = F.col(column) if dict(df.dtypes)[column] == "string" else F.to_json(column)
    return df.withColumn(column, F.try_parse_json(text))


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)


def workflow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges)."""
    t = spark.read.schema(WORKFLOW_SCHEMA).option("multiLine", True).json(path).select(F.explode("tasks").alias("t")).select("t.*")
    edges = t.select(F.col("id").alias("task"), F.explode("depends_on").alias("depends_on"))
    return t.drop("depends_on"), edges


PUT, DELETE = ("put", "set", "insert"), ("delete", "del", "remove")


def parse_ops(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines -> (line, op, key, value). A line is a flat or nested JSON object or ``op key value``; blank lines and those that
    begin with # or // are left out; an unknown operation fails the query."""
    raw = F.trim(F.col(column))
    x = lines.select(raw.alias("line")).where((raw != "") & ~raw.startswith("#") & ~raw.startswith("//"))
    flat = F.from_json("line", "op string, key string, value string")
    nested = F.from_json("line", "put struct<key string, value string>, `set` struct<key string, value string>, insert struct<key string, value string>, `delete` struct<key string>, del struct<key string>, remove struct<key string>")
    x = x.withColumns({"json": F.col("line").startswith("{"), "flat": flat, "nested": nested})
    of_nested = F.coalesce(*[F.when(F.col(f"nested.{n}").isNotNull(), n) for n in (*PUT, *DELETE)])
    nested_key = F.coalesce(*[F.col(f"nested.{n}.key") for n in (*PUT, *DELETE)])
    nested_value = F.coalesce(*[F.col(f"nested.{n}.value") for n in PUT])
    word = lambda k: F.nullif(F.regexp_extract("line", r"^(\S+)(?:\s+(\S+))?(?:\s+(.*))?$", k), F.lit(""))
    op = F.lower(F.when(F.col("json"), F.coalesce("flat.op", of_nested)).otherwise(word(1)))
    key = F.when(F.col("json"), F.coalesce("flat.key", nested_key)).otherwise(word(2))
    value = F.when(F.col("json"), F.coalesce("flat.value", nested_value)).otherwise(F.coalesce(word(3), F.lit("")))
    named = F.when(op.isin(*PUT), "put").when(op.isin(*DELETE), "delete").otherwise(F.raise_error(F.concat(F.lit("unknown operation in: "), F.col("line"))))
    return x.select("line", named.alias("op"), key.alias("key"), F.when(op.isin(*PUT), value).alias("value"))


def write(df: DataFrame, path: str, kind: str) -> None:
    """json lines, tsv or text (one column, columns joined by two spaces)."""
    if kind == "json":
        df.write.json(path)
    elif kind == "tsv":
        df.write.option("sep", "\t").option("header", True).csv(path)
    elif kind == "text":
        df.select(F.concat_ws("  ", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {kind!r}")

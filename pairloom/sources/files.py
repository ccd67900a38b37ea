"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pairloom.functions import text as X
from pairloom.operators.scale import number_rows
from pairloom.session import durable

# Quoted multi-line text; '' and NULL stay apart; no trimming on either side.
CSV = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "escapeQuotes": True,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "nullValue": "", "emptyValue": '""', "encoding": "UTF-8",
}

# On reading, a bare empty field is NULL and a quoted one is ''.  The mark for the
# bare field must differ from '' and cannot occur in text.
_CSV_READ = {"nullValue": "\x00", "emptyValue": ""}


def write_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """``index`` names a key column to put first; None writes the columns as they are."""
    if index is not None:
        df = df.select(index, *[c for c in df.columns if c != index])
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read quoted CSV.  Files with line breaks inside quotes do not split, so a
    large one belongs into Parquet once (``csv_to_parquet``)."""
    return spark.read.schema(schema).options(**{**CSV, **_CSV_READ}).csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType,
                   texts: tuple[str, ...] = ()) -> DataFrame:
    df = read_csv(spark, source, schema)
    df = df.withColumns({c: X.normalise_newlines(F.col(c)) for c in texts})
    df.write.parquet(target)
    return spark.read.parquet(target)


def parse_json(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a column of JSON texts.  Bad lines are reported, not lost."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = df.where(F.trim(column) != "").select(F.from_json(
        column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record")
    return (rows.where(bad.isNull()).select(*[F.col(f"r.{n}").alias(n) for n in schema.names]),
            rows.where(bad.isNotNull()).select(bad.alias("line")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    return parse_json(spark.read.text(path), "value", schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_lines(*columns: str):
    """One JSON text per row with a fixed field order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def read_export(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """A published patch set, from its Parquet export: ``new_name=old_name``."""
    return spark.read.parquet(path).select(*[F.col(old).alias(new) for new, old in columns.items()])


def write_keys(df: DataFrame, path: str, key: str = "pair_id") -> None:
    """Save the rows to drop as a key table."""
    df.select(key).distinct().write.parquet(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "pair_id") -> None:
    """Save as a table bucketed by key: later joins and windows need no shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def assign_row_id(df: DataFrame, order: list[str], name: str = "pair_id") -> DataFrame:
    """Dense 0-based ids by a unique order.  Given once, at ingest, and kept."""
    out = number_rows(df, [F.asc(c) for c in order], name)
    return out.withColumn(name, F.col(name) - 1)


def file_row_ids(df: DataFrame, name: str = "pair_id") -> DataFrame:
    """Dense 0-based ids by file path and place in the file, for input without any key.

    ``df`` is what a file reader returns, of any splittable or unsplittable format.  A split
    (path, start of its block) is read by one task, in order, so a row's place is its place
    in the split plus the rows of all splits before it.  The rows are written once with their
    split and running number; only (split, rows, first number) is counted and summed up, one
    row per split.  Ids do not depend on how the files were split.
    """
    path, start = (F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start"))
    rows = durable(df.select("*", path.alias("_path"), start.alias("_start"),
                             F.monotonically_increasing_id().alias("_at")))
    splits = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (rows.join(durable(offsets), ["_path", "_start"])
            .withColumn(name, F.col("_at") + F.col("_shift")).drop("_path", "_start", "_at", "_shift"))

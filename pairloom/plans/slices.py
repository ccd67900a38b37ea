"""A job over the slices of a table that can be stopped and taken up again.

The folder of a job holds

* ``slices``: the rows, numbered by a unique order and written as one partition a slice,
* ``plan``: (chunk, n_rows) of every slice, written when ``slices`` is complete,
* ``out``: the result of the job, one folder a slice,
* ``done``: (chunk, n_rows) of every finished slice, added as each group of slices ends.

A run reads ``plan`` and ``done`` and works on the rest.  A slice that was cut off has no row
in ``done``; its output is written anew, over what was there.  Only the manifests, one row a
slice, reach the driver; their number is the caller's choice of ``slice_size``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pairloom.operators.records import chunk_rows

_MANIFEST = "chunk long, n_rows long"
#: Slices that are stored at a time, and slices entered in the manifest together.
AT_ONCE, GROUP = 16, 64


def _manifest(spark: SparkSession, folder: str, name: str) -> dict[int, int]:
    """Slices of a manifest; none if it is not there yet."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/{name}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r.chunk: r.n_rows for r in rows}


def prepare(df: DataFrame, order: list[str], slice_size: int, folder: str) -> dict[int, int]:
    """Write the slices and their plan, unless that is done: rows per slice.

    One range shuffle for the numbers and one write; each slice is moved to a task of its
    own, so ``slice_size`` bounds what a task holds.  A run cut off before the plan stood is
    made anew.
    """
    spark = df.sparkSession
    known = _manifest(spark, folder, "plan")
    if known:
        return known
    (chunk_rows(df, order, slice_size).repartition("chunk").write.partitionBy("chunk")
     .mode("overwrite").parquet(f"{folder}/slices"))
    sizes = spark.read.parquet(f"{folder}/slices").groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_rows"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/plan")
    return _manifest(spark, folder, "plan")


def open_slices(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the slices that are not finished, in order."""
    return sorted(set(_manifest(spark, folder, "plan")) - set(_manifest(spark, folder, "done")))


def run(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], limit: int | None = None) -> list[int]:
    """Run ``job`` on the open slices, or on the first ``limit`` of them; the slices finished.

    ``job`` gets the rows of one slice with their row_number, slice after slice in order.  What
    it returns is stored by up to AT_ONCE Spark jobs at a time; when those of GROUP slices are
    through, the stored ones are entered in the manifest.  An error ends the run after that.
    """
    chunks = open_slices(spark, folder)[:limit]
    if not chunks:
        return []
    form = spark.read.parquet(f"{folder}/slices/chunk={chunks[0]}").schema
    finished = []
    for at in range(0, len(chunks), GROUP):
        stored, broken = _store(spark, folder, job, form, chunks[at:at + GROUP])
        if stored:
            _enter(spark, folder, stored)
        if broken:
            raise broken
        finished += stored
    return finished


def _store(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], form: T.StructType,
           chunks: list[int]) -> tuple[list[int], Exception | None]:
    """Store the results of some slices: those stored, and the first error."""
    writes, broken = {}, None
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for chunk in chunks:
            try:
                done = job(spark.read.schema(form).parquet(f"{folder}/slices/chunk={chunk}"))
            except Exception as error:
                broken = error
                break
            writes[chunk] = pool.submit(done.write.mode("overwrite").parquet, f"{folder}/out/chunk={chunk}")
    errors = {chunk: write.exception() for chunk, write in writes.items()}
    return [c for c, e in errors.items() if not e], next((e for e in errors.values() if e), broken)


def _enter(spark: SparkSession, folder: str, chunks: list[int]) -> None:
    """Enter stored slices in the manifest; a result without rows counts 0."""
    counts = (spark.read.option("basePath", f"{folder}/out").parquet(*[f"{folder}/out/chunk={k}" for k in chunks])
              .groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_rows")).collect())
    rows = dict.fromkeys(chunks, 0) | {r.chunk: r.n_rows for r in counts}
    spark.createDataFrame(list(rows.items()), _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/done")


def result(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all finished slices, with their ``chunk``; the output of others is not read."""
    done = sorted(_manifest(spark, folder, "done"))
    if not done:
        raise ValueError(f"no slice of {folder} is finished")
    rows = spark.read.option("basePath", f"{folder}/out").parquet(*[f"{folder}/out/chunk={k}" for k in done])
    return rows.withColumn("chunk", F.col("chunk").cast("long"))

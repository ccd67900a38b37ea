"""Building blocks that keep global order and hot keys off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import durable, stored_texts

#: Bytes of one text column that a task takes when texts are dealt by id.
TASK_BYTES = 8 << 20


def parts_for(df: DataFrame, text: str) -> int:
    """Partitions for whole texts: as many as ``text`` needs at TASK_BYTES each, so that a task's
    share does not grow with the table.  One pass over the column."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def dealt_by_id(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Rows with whole texts, hash-partitioned by id: the one shuffle of the texts.

    Neither side of it grows with the table: the partitions follow the bytes of ``text``, and the
    texts are stored before, so that a task which deals them out has a bounded share too.
    """
    rows = stored_texts(df)
    return rows.repartition(parts_for(rows, text), row_id)


def texts_by_id(df: DataFrame, row_id: str, *texts: str) -> DataFrame:
    """(row_id, texts...): one row per id, with each column an array of the id's texts that are
    not null; nearly always one.  One shuffle of the texts; the last column sets the partitions."""
    return (dealt_by_id(df.select(row_id, *texts), row_id, texts[-1])
            .groupBy(row_id).agg(*[F.collect_list(c).alias(c) for c in texts]))


def range_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition by a unique order and store each row's part number.

    The order must end in a unique key: then ties can be cut anywhere and no part
    grows with the number of equal values.  The part number is written down,
    because the range bounds come from a sample and may differ on a second run.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return durable(ranged)


def part_offsets(parts: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Totals per part and what lies before each part.

    Columns: ``n``, ``n_before`` and, for each name in ``sums``, ``<name>`` and
    ``<name>_before``.  One row per part (and ``by`` value), so the window over
    it is as small as the number of shuffle partitions.
    """
    by = list(by)
    totals = parts.groupBy("_part", *by).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) \
        .orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    for name in ["n", *sums]:
        zero = F.lit(0).cast(totals.schema[name].dataType)
        totals = totals.withColumn(
            f"{name}_before", F.coalesce(F.sum(name).over(before), zero))
    return totals


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add a dense 1-based row number over the whole table, for a unique order.

    One range shuffle: each part is sorted and numbered while it is written, and
    the parts' offsets (one row per part) are added on reading.
    """
    numbered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_id", F.monotonically_increasing_id())
                .withColumn("_part", F.shiftrightunsigned("_id", 33).cast("int"))
                .withColumn("_idx", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
                .drop("_id"))
    parts = durable(numbered)
    offsets = part_offsets(parts, {}).select("_part", "n_before")
    return (parts.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_idx") + F.col("n_before") + 1)
            .drop("_part", "_idx", "n_before"))


def global_running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                   by: Sequence[str] = (), row_number: str | None = None) -> DataFrame:
    """Running totals (current row included) over the whole table, in two levels.

    Sums per range part first, then a window inside each part on top of the
    part's offset.  ``by`` restarts the totals per class.
    """
    by = list(by)
    parts = range_parts(df, order)
    offsets = part_offsets(parts, sums, by).select(
        "_part", *by, "n_before", *[f"{name}_before" for name in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # Without classes there is one offset row per part; with them the planner
    # picks the join by measured size.
    out = parts.join(offsets if by else F.broadcast(offsets), ["_part", *by])
    for name, c in sums.items():
        out = out.withColumn(f"_run_{name}", F.sum(c).over(inside) + F.col(f"{name}_before"))
    if row_number:
        out = out.withColumn(row_number, F.row_number().over(inside).cast("long") + F.col("n_before"))
    out = out.drop("_part", "n_before", *[f"{name}_before" for name in sums])
    return out.withColumnsRenamed({f"_run_{name}": name for name in sums})


def cut_position(df: DataFrame, order: Sequence[Column], running: dict[str, Column],
                 reached: str, target: Column) -> DataFrame:
    """The first row, in order, whose running ``reached`` total is >= ``target``.

    ``target`` is written over ``n_all`` and ``<name>_all``.  One row comes back:
    position, the running totals at that row, and the totals of the whole table.
    Parts are only summed, apart from the one that holds the cut, which is sorted.
    """
    parts = range_parts(df, order)
    offsets = part_offsets(parts, running)
    whole = Window.partitionBy(F.lit(0))
    for name in ["n", *running]:
        offsets = offsets.withColumn(f"{name}_all", F.sum(name).over(whole))
    offsets = offsets.withColumn("_target", target)
    hit = offsets.where(
        (F.col(f"{reached}_before") < F.col("_target"))
        & (F.col(f"{reached}_before") + F.col(reached) >= F.col("_target"))
    ).drop("n", *running)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = parts.join(F.broadcast(hit), "_part").select(
        (F.row_number().over(inside) + F.col("n_before")).alias("position"),
        *[(F.sum(c).over(inside) + F.col(f"{name}_before")).alias(f"_at_{name}")
          for name, c in running.items()],
        "_target", "n_all", *[f"{name}_all" for name in running])
    rows = rows.where(F.col(f"_at_{reached}") >= F.col("_target"))
    return rows.agg(
        F.min("position").alias("position"),
        *[F.min_by(f"_at_{name}", "position").alias(name) for name in running],
        *[F.max(f"{name}_all").alias(f"{name}_all") for name in ["n", *running]])

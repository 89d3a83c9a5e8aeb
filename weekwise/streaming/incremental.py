"""A resumable ingest of raw rows that keeps weekly aggregates in a table.

Every micro-batch stores *partial* aggregates (sums, counts, extremes, sets of days) of its own rows and reading combines them.
There is no state and no watermark, so a row counts however late it comes.

Layout of a table: ``parts/`` holds directories of partial aggregates, each written once under a name of its own; ``manifest/`` holds
one small file per finished directory, which says what batches it covers. A job's files appear one by one, a file appears whole,
so the row of the manifest publishes a directory. Readers open what the manifest names and nothing else: a directory that is being
written, or was left by a job that died, is invisible. Directories that a later base covers stay for readers that still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weekwise.operators._util import as_list, col

# how each measure is stored and combined: name suffixes of its partial columns
PARTS = {"sum": ("sum",), "count": ("n",), "mean": ("sum", "n"), "min": ("min",), "max": ("max",), "days": ("days",)}
MANIFEST = "first_batch LONG, last_batch LONG, directory STRING"


def utc_instant(ts: str, kind: str) -> Column:
    """Event time as the TIMESTAMP that windows need; a zoneless value is read as UTC."""
    if kind != "timestamp_ntz":
        return col(ts)
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(ts)).cast("timestamp")


def weekly_window(ts: str) -> Column:
    """Seven-day window that starts on Mondays (day 0 of the epoch was a Thursday)."""
    return F.window(col(ts), "7 days", "7 days", "4 days")


def _partial(part: str, value: Column, event: str) -> Column:
    if part == "days":
        return F.bit_or(F.when(value.isNotNull(), F.expr("shiftleft(1, weekday(`" + event + "`))")))
    return {"sum": F.sum, "n": F.count, "min": F.min, "max": F.max}[part](value)


def weekly_partials(df: DataFrame, entity, ts: str, measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Partial aggregates per entity and week: ``measures`` names a kind of PARTS and a column for each result.

    ``days`` marks the weekdays on which the column is known. Rows without an event time belong to no week and are left out.
    """
    keys = as_list(entity)
    rows = df.withColumn("__event", utc_instant(ts, df.schema[ts].dataType.typeName())).where("__event is not null")
    out = rows.groupBy(*map(col, keys), weekly_window("__event")).agg(
        *[_partial(part, value, "__event").alias(f"{name}__{part}") for name, (kind, value) in measures.items() for part in PARTS[kind]]
    )
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window.start").cast("timestamp_ntz"))
    return out.select(*map(col, keys), F.to_date(start).alias("week_start"), *[c for c in out.columns if "__" in c and c not in keys])


def _combined(parts: DataFrame, keys: list[str], measures: Mapping[str, str]) -> DataFrame:
    merge = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max, "days": F.bit_or}
    return parts.groupBy(*map(col, keys)).agg(
        *[merge[part](f"{name}__{part}").alias(f"{name}__{part}") for name, kind in measures.items() for part in PARTS[kind]]
    )


def ingest(stream: DataFrame, entity, ts: str, measures: Mapping[str, tuple[str, Column]], path: str, checkpoint: str) -> None:
    """Process everything that is new since the last run, then stop.

    Each micro-batch writes its partial aggregates into a directory of its own and publishes it. A batch that is run again after a
    restart publishes another directory for the same batch, of which readers take one, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _publish(weekly_partials(batch, entity, ts, measures), path, batch_id, batch_id)

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def _publish(parts: DataFrame, path: str, first: int, last: int) -> None:
    """Write partial aggregates, then the one file that makes them part of the table."""
    directory = f"{first}-{last}-{uuid.uuid4().hex}"
    parts.write.parquet(f"{path}/parts/{directory}")
    _add_to_manifest(parts.sparkSession, path, first, last, directory)


def _add_to_manifest(spark: SparkSession, path: str, first: int, last: int, directory: str) -> None:
    spark.createDataFrame([(first, last, directory)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _cover(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Directories that together hold every published batch once, and the last batch.

    The base that reaches furthest, then one directory for each later batch. What leaves the manifest is a row per batch since that base.
    """
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    base = rows.where("first_batch < 0").agg(F.max(F.struct("last_batch", "directory")).alias("b")).first().b
    later = rows.where("first_batch >= 0").where(F.col("last_batch") > (base.last_batch if base else -1))
    found = later.groupBy("last_batch").agg(F.min("directory").alias("directory")).orderBy("last_batch").collect()
    found = [base, *found] if base else found
    if not found:
        raise ValueError(f"{path}: nothing ingested yet")
    return [f"{path}/parts/{r.directory}" for r in found], found[-1].last_batch


def compact(spark: SparkSession, path: str, entity, measures: Mapping[str, str], key: str = "week_start") -> None:
    """Combine all batches so far into one base, so that reading stays proportional to the panel.

    Readers see the old parts until the base is complete and published, and the base from then on; a compaction that dies in
    between changes nothing and can be run again, as can two at a time. With a base that already reaches the last batch there is
    nothing to do.
    """
    directories, last = _cover(spark, path)
    if len(directories) > 1 or not directories[0].rsplit("/", 1)[1].startswith("-1-"):
        _publish(_combined(spark.read.parquet(*directories), [*as_list(entity), key], measures), path, -1, last)


def current(spark: SparkSession, path: str, entity, measures: Mapping[str, str], key: str = "week_start") -> DataFrame:
    """Measures of every entity and week over all rows ever ingested (``days``: how many different weekdays)."""
    keys = [*as_list(entity), key]
    whole = _combined(spark.read.parquet(*_cover(spark, path)[0]), keys, measures)
    done = {
        "sum": lambda n: F.col(f"{n}__sum"), "count": lambda n: F.col(f"{n}__n"), "min": lambda n: F.col(f"{n}__min"),
        "max": lambda n: F.col(f"{n}__max"), "mean": lambda n: F.try_divide(f"{n}__sum", f"{n}__n"),
        "days": lambda n: F.bit_count(F.coalesce(f"{n}__days", F.lit(0))),
    }
    return whole.select(*map(col, keys), *[done[kind](name).alias(name) for name, kind in measures.items()])

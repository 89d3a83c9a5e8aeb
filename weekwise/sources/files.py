"""Text, JSON and Parquet sources, and the sinks for panels and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weekwise.operators._util import as_list, col
from weekwise.operators.dedup import dedup_last
from weekwise.operators.quality import assert_panel, require_columns
from weekwise.sources.delimited import RANGE_BYTES, read_records


def read_delimited(
    spark: SparkSession, path: str | list[str], required: Sequence[str] = (), sep: str = ";", quote: str = '"',
    title_rows: int = 0, encoding: str | None = None, multi_line: bool = False, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Delimited text with a header record, every column STRING, read by planned byte ranges (``sources/delimited.py``).

    The first records of *every* file that are not blank, ``title_rows`` and the header, are left out by their place, so a row that equals one
    of them stays. The headers must agree, names and order (the planning job reads them); they are cleaned and checked against
    ``required``. Without ``encoding`` each file is UTF-8 (with or without byte-order mark), Windows-1252 or Latin-1, the first that
    all its bytes are valid in. Line ends are \\n, \\r\\n and \\r. With ``multi_line`` line ends within quotes belong to the value (quotes
    must then be balanced, and \\r alone ends no line); a quote that never closes takes the rest of its file. Blank lines and empty
    files give no rows; rows too short are filled with NULL. The plan is a snapshot: files that come later are not read.
    """
    records, headers = read_records(spark, path, sep, quote, title_rows, encoding, multi_line, range_bytes)
    if not headers:
        raise ValueError(f"{path}: no header line")
    if len(headers) > 1:
        raise ValueError(f"{path}: files with different headers: {headers[:2]}")
    (names,) = headers
    options = {"sep": sep, "quote": quote, "mode": "PERMISSIVE"}
    if multi_line:
        options |= {"escape": quote, "multiLine": "true", "lineSep": "\n"}
    ddl = ", ".join(f"`{n}` STRING" for n in names)
    rows = records.where(F.length(F.trim("record")) > 0)
    out = rows.select(F.inline(F.array(F.from_csv("record", ddl, options))))
    require_columns(out, required, str(path))
    return out


def read_typed_csv(spark: SparkSession, path: str, ddl: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Comma CSV with a header and a given schema; dates parsed by the reader."""
    return spark.read.schema(ddl).csv(path, header=True, dateFormat=date_format, enforceSchema=False)


def read_panel(spark: SparkSession, path: str | list[str], entity="entity", key: str = "week_start") -> DataFrame:
    """Parquet panel whose contract (key present, unique, Monday) is checked on read."""
    paths = [path] if isinstance(path, str) else path
    return assert_panel(spark.read.parquet(*paths), entity, key)


def read_partitioned(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Partitioned Parquet dataset; filters on partition columns prune directories."""
    reader = spark.read.option("recursiveFileLookup", "false")
    return (reader.schema(schema) if schema else reader).parquet(path)


def read_latest_rows(spark: SparkSession, pattern: str, keys, required: Sequence[str] = ()) -> DataFrame:
    """All Parquet files of a pattern as one feed; for each key the row of the last file path wins."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    require_columns(df, [*as_list(keys), *required], pattern)
    named = df.select("*", F.col("_metadata.file_path").alias("__file"))
    return dedup_last(named, keys, "__file").drop("__file")


def latest_match(spark: SparkSession, pattern: str) -> str:
    """Lexicographically last file or dataset directory of a pattern (lists files, reads none)."""
    found = spark.read.format("binaryFile").load(pattern).agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(pattern)
    # a directory match is listed by its files: cut the path back to the depth of the pattern
    bare = found.split(":", 1)[1] if found.startswith("file:") and "://" not in pattern else found
    bare = "/" + bare.lstrip("/") if bare is not found else bare
    return "/".join(bare.split("/")[: len(pattern.split("/"))])


def read_json_records(spark: SparkSession, path: str, ddl: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays of records (or one record per line) with an explicit schema."""
    return spark.read.schema(ddl).json(path, multiLine=multi_line, encoding="UTF-8")


def write_panel(df: DataFrame, path: str, partition="entity", mode: str = "overwrite") -> None:
    """Parquet panel with one directory per partition value.

    Rows are rebalanced on the partition columns first: one writer per directory for small ones, while
    AQE splits a directory that holds a large share of the rows.
    """
    names = as_list(partition)
    df.hint("rebalance", *names).write.mode(mode).partitionBy(*names).parquet(path)


def write_feed(
    df: DataFrame, table: str, entity="entity", key: str = "week_start", buckets: int = 64, path: str | None = None
) -> DataFrame:
    """Feed as a table that is bucketed by entity and period, sorted within buckets; gives the table.

    The catalog records buckets and order, so joins on (entity, period) of tables with equally many buckets read bucket by bucket and move no row,
    however often the master is built. Rows are dealt to buckets once, here: one file per bucket, and a long entity is spread over all
    buckets as the period is part of the key. ``path`` places the files; without it they go to the warehouse.
    """
    names = [*as_list(entity), key]
    writer = df.repartition(buckets, *map(col, names)).write.format("parquet").mode("overwrite").bucketBy(buckets, *names).sortBy(*names)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_table(
    df: DataFrame, path: str, order_by: Sequence[str] = (), twin: str | None = None, single: bool = False
) -> None:
    """Result table as CSV parts with a header, optionally sorted and with a Parquet twin.

    ``single=True`` gives one part and is meant for aggregated reports of a few rows only.
    """
    out = df.orderBy(*map(col, order_by)) if order_by else df
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).csv(path)
    if twin:
        df.write.mode("overwrite").parquet(twin)


def write_partitioned_idempotent(
    df: DataFrame, path: str, year: str = "year_onset", chunk: str = "chunk_key", resume: bool = False
) -> None:
    """Write by year and chunk so that writing a chunk again replaces just that chunk, in all years.

    A year that a chunk no longer has keeps one row of NULLs, as a directory is only replaced where rows are written; the stored column
    ``__row`` tells rows (true) from such fillers (NULL). ``read_chunks`` leaves both out, other readers need ``WHERE __row``. A table with
    a column of that name is refused. ``resume=True`` leaves chunks that are already stored untouched and writes only the others.
    """
    if "__row" in df.columns:
        raise ValueError("the column __row is the sink's own")
    try:
        stored = df.sparkSession.read.parquet(path).select(year, chunk).distinct()
    except Exception as error:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        stored = None
    if stored is not None and resume:
        df = df.join(stored.select(chunk).distinct(), chunk, "left_anti")
    elif stored is not None:
        # a row of NULLs keeps the directory, so that dynamic overwrite replaces what it held
        old = stored.select(F.col(year).cast(df.schema[year].dataType).alias(year), F.col(chunk).cast(df.schema[chunk].dataType).alias(chunk))
        gone = old.join(df.select(chunk).distinct(), chunk, "left_semi").join(df.select(year, chunk).distinct(), [year, chunk], "left_anti")
        df = df.withColumn("__row", F.lit(True)).unionByName(gone.withColumn("__row", F.lit(None).cast("boolean")), allowMissingColumns=True)
    if "__row" not in df.columns:
        df = df.withColumn("__row", F.lit(True))
    (
        df.hint("rebalance", year, chunk)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(year, chunk)
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table written by ``write_partitioned_idempotent``."""
    return spark.read.parquet(path).where(F.col("__row")).drop("__row")

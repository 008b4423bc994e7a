"""Writing tables, routed outputs, metric lines and reports."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opswell.operators.tables import oldest
from opswell.session import settle

log = logging.getLogger(__name__)


def csv_parts(df: DataFrame, path: str, parts: int | None = None) -> None:
    """Many part files, as many as the table has partitions or as asked for."""
    (df.repartition(parts) if parts else df).write.mode("overwrite").option("header", True).csv(path)


def csv_single(df: DataFrame, path: str) -> None:
    """One part file, and so one task that writes all rows: for aggregates, whose size does not follow the data's."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def attempt(write, *args, **kwargs) -> bool:
    """Runs a write and reports a failure instead of raising it."""
    try:
        write(*args, **kwargs)
        return True
    except Exception as e:  # noqa: BLE001 - any failure of the sink is reported
        log.error("write failed: %s", e)
        return False


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """mode is overwrite, ignore (keep what is there) or append."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def dataset_layout(df: DataFrame, path: str) -> None:
    """type / dataset / namespace / date folders, so that a reader of one dataset and day touches nothing else."""
    parquet(df, path, by=["type", "dataset", "namespace", "date"])


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Writes, reads back and gives one row: rows written, rows read, whether they agree."""
    spark = df.sparkSession
    parquet(df, path)
    read = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_read"))
    return df.agg(F.count(F.lit(1)).alias("rows_written")).select(
        "rows_written", read.select("rows_read").scalar().alias("rows_read")
    ).withColumn("agree", F.col("rows_written") == F.col("rows_read"))


def route(df: DataFrame, path: str, routes: Sequence[tuple[str, Column]], otherwise: str = "other") -> None:
    """Sends every row to the folder of the first route that takes it, in one pass."""
    name = F.lit(otherwise)
    for label, test in reversed(routes):
        name = F.when(test, F.lit(label)).otherwise(name)
    parquet(df.withColumn("route", name), path, by=["route"])


def create_only(spark: SparkSession, path: str, rows: DataFrame, key: str, order: Sequence[str]) -> None:
    """Appends rows whose key is not there yet, the first by `order` of each; a key that is there is left as it is."""
    rows = oldest(rows, [key], order)
    if exists(spark, path):
        rows = settle(rows.join(spark.read.parquet(path).select(key), key, "left_anti"))
    rows.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder; the target must not be there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    if exists(spark, target) or not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise FileExistsError(f"{source} was not moved to {target}")


def metric_lines(df: DataFrame, key: Column, dims: dict[str, Column], value: Column) -> DataFrame:
    """Line protocol: key,dim="v",... value with six significant digits; quotes in dimensions are escaped."""
    quoted = [
        F.concat(F.lit(f'{name}="'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"')) for name, c in dims.items()
    ]
    return df.select(F.concat(F.concat_ws(",", key, *quoted), F.lit(" "), significant(value)).alias("value"))


def significant(c: Column, digits: int = 6) -> Column:
    """A number with the given significant digits: no trailing zeros, exponents only outside 1e-4 .. 1e6."""
    c = c.cast("double")
    size = F.abs(c)
    # The exponent after rounding to the wanted digits decides on the form.
    sci = F.format_string(f"%.{digits - 1}e", c)
    exponent = F.regexp_extract(sci, "e([+-]\\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(sci, "^(.*)e", 1), "\\.?0+$", "")
    plain = F.lit(None).cast("string")
    for e in range(-4, digits):
        text = F.format_string(f"%.{max(digits - 1 - e, 0)}f", c)
        if digits - 1 - e > 0:
            text = F.regexp_replace(text, "\\.?0+$", "")
        plain = F.when(exponent == e, text).otherwise(plain)
    return F.when(size == 0, F.lit("0")).when(exponent.between(-4, digits - 1), plain).otherwise(
        F.concat(mantissa, F.lit("e"), F.regexp_extract(sci, "e([+-]\\d+)$", 1))
    )


#: date, commit, chapter, status and seconds of a finished run.
TIMING = "date string, commit string, chapter string, status string, elapsed_s double"


def append_timings(rows: DataFrame, path: str) -> None:
    """Rows of TIMING at the end of the timing table."""
    rows.select(*[f.split()[0] for f in TIMING.split(", ")]).write.mode("append").option("header", True).csv(path)


def append_timing(spark: SparkSession, path: str, date: str, commit: str, chapter: str, status: str, elapsed_s: float) -> None:
    """One row for a run that has finished."""
    append_timings(spark.createDataFrame([(date, commit, chapter, status, elapsed_s)], TIMING), path)


def set_age(spark: SparkSession, folder: str, seconds: int) -> None:
    """Dates the files of a folder back by some seconds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        fs.setTimes(f.getPath(), f.getModificationTime() - seconds * 1000, -1)

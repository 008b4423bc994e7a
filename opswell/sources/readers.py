"""Reading text, delimited files, JSON documents, Parquet and growing folders."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from opswell.operators.segments import Ordered
from opswell.operators.tables import aligned
from opswell.session import settle


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths))


def named_lines(spark: SparkSession, *paths: str, depth: int = 1) -> DataFrame:
    """Lines with the base name of their file, or with that of the folder depth - 1 levels above it."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth)
    return spark.read.option("lineSep", "\n").text(list(paths)).select("value", name.alias("file"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with their file and a number that grows along it (it has gaps, but no two lines share one).

    A file is read in blocks. A block has at most as many lines as bytes, so its
    place in the file plus a line's place in the block is such a number.
    """
    rows = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    firsts = rows.groupBy(F.col("path").alias("_path"), F.col("_block").alias("_at")).agg(F.min("_id").alias("_first"))
    same = (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_at"))
    return rows.join(firsts, same).select(
        "path", (F.col("_block") + F.col("_id") - F.col("_first")).alias("line_no"), "value"
    )


def delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    schema: str | T.StructType | None = None,
    timestamp_format: str | None = None,
    quote: str | None = None,
) -> DataFrame:
    """Delimited file; without a schema the types are inferred in an extra pass."""
    reader = spark.read.option("sep", sep).option("header", header)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    if quote is not None:
        reader = reader.option("quote", quote)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def documents(spark: SparkSession, *paths: str, schema: str | T.StructType | None = None, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """JSON documents, one per line or spread over lines; strict fails on the first field of another type."""
    reader = spark.read.option("multiLine", multi_line)
    if strict:
        reader = reader.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(list(paths))


#: A string, or a bracket outside of strings. JSON strings hold no line breaks, so a line never begins inside of one.
JSON_MARKS = r'"(?:[^"\\]|\\.)*"|[\[\]{}]'


def _pieces(base: int):
    """Of each line with its depth at the start, the parts that belong to records, and whether a record begins with one."""
    marks = re.compile(JSON_MARKS)

    def cut(line: str, depth: int):
        begins, at = False, 0 if depth > base else None
        for m in marks.finditer(line):
            mark = m.group()
            if mark in "[{":
                if depth == base:
                    begins, at = True, m.start()
                depth += 1
            elif mark in "]}":
                depth -= 1
                if depth == base and at is not None:
                    yield begins, line[at : m.end()]
                    begins, at = False, None
        if at is not None:
            yield begins, line[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "line_no", "_depth", "value"))
            rows = [(path, no, i, int(begins), text) for path, no, depth, value in zip(*columns) for i, (begins, text) in enumerate(cut(value, depth))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "line_no", "part", "begins", "text"])

    return run


def array_documents(spark: SparkSession, *paths: str, schema: str | T.StructType, in_array: bool = True) -> DataFrame:
    """JSON documents that are spread over lines: the elements of one array per file, or one document after the other.

    Unlike a multi-line read, a file is read in as many splits as its size asks for.
    Brackets outside of strings are added up along the file, so each line knows how
    deep it begins; then each line gives its parts of documents, and those of one
    document meet. Elements that are no objects are left out.
    """
    lines = numbered_lines(spark, *paths)
    # Escapes stand in strings only; without them a string ends at the next quote, which takes no nested pattern.
    bare = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*"', "")
    depth = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    lines = settle(lines.withColumn("_change", depth))
    known = Ordered(lines, ["path"], ["line_no"]).running_sums({"_after": "_change"}).df
    begun = known.select("path", "line_no", (F.col("_after") - F.col("_change")).cast("int").alias("_depth"), "value")
    parts = settle(begun.mapInArrow(_pieces(int(in_array)), "path string, line_no long, part long, begins long, text string"))
    numbered = Ordered(parts, ["path"], ["line_no", "part"]).running_sums({"record": "begins"}).df
    texts = F.array_sort(F.collect_list(F.struct("line_no", "part", "text")))["text"]
    whole = numbered.groupBy("path", "record").agg(F.array_join(texts, "\n").alias("text")).where(F.startswith("text", F.lit("{")))
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    return whole.select(F.from_json("text", schema).alias("d")).select("d.*")


def yearly(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One Parquet table per year as one table; a column a year lacks is null there."""
    return aligned([spark.read.parquet(p) for p in paths])


def growing_lines(
    spark: SparkSession,
    path: str,
    glob: str | None = None,
    max_age: str | None = None,
    files_per_trigger: int | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Stream of the lines of files that appear below a folder.

    glob chooses files by name, so packed, temporary and lock files can be left
    out; max_age leaves out files older than that against the newest one.
    """
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_age:
        reader = reader.option("maxFileAge", max_age)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def recent_lines(spark: SparkSession, path: str, glob: str, modified_after: str | None = None) -> DataFrame:
    """The batch twin of growing_lines."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(path)

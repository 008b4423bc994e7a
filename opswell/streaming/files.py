"""Running a stream over what is there, and small helpers for files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from opswell.sources.writers import exists, move
from opswell.sources.tables import Tables


def caught_up(t: Tables, stream: DataFrame, mode: str = "append", at: tuple[str, str] | None = None) -> DataFrame:
    """Runs a stream until it has read everything, into a Parquet table in the shared folder, and reads that.

    at: the table's folder and the checkpoint's, to go on where another run has stopped.
    """
    out, state = at or (t.scratch("stream"), t.scratch("progress"))
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True).start(out)
    )
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


def replayed(t: Tables, rows: DataFrame, at: str, build, mode: str = "append", write=None, slices: int = 5, closing: DataFrame | None = None) -> DataFrame | None:
    """Gives the rows to a stream in `slices` parts in the order of `at`, a time or a number, and reads what it put out.

    build: the stream's steps, from its source to its result. Each part is written
    to the source's folder as it would arrive, and the stream then goes on from its
    checkpoint until it has caught up. So there are as many micro-batches as parts at
    least, and watermarks and state pass from one to the next. write(rows, number):
    takes each batch instead of a table. closing: rows that come after all others, as
    later ones would, to move the watermark on.

    The rows are written once, one folder for each part; a folder is moved to the
    source's when its turn has come.
    """
    source, parts, out, state = t.scratch("arriving"), t.scratch("parts"), t.scratch("stream"), t.scratch("progress")
    number = F.unix_micros(at) if dict(rows.dtypes)[at] == "timestamp" else F.col(at).cast("long")
    ends = rows.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first()
    lo, step = ends["lo"] or 0, ((ends["hi"] or 0) - (ends["lo"] or 0)) // slices + 1
    place = F.coalesce(F.floor((number - lo) / step), F.lit(0)).cast("int")
    rows.withColumn("_slice", place).write.partitionBy("_slice").parquet(parts)
    rows.limit(0).write.parquet(source)
    result = None
    for i in range(slices + (closing is not None)):
        if i == slices:
            closing.write.mode("append").parquet(source)
        elif exists(t.spark, f"{parts}/_slice={i}"):
            move(t.spark, f"{parts}/_slice={i}", f"{source}/part{i}")
        result = build(t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source))
        run = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        (run.foreachBatch(write).start() if write else run.format("parquet").start(out)).awaitTermination()
    return None if write else t.spark.read.schema(result.schema).parquet(out)


def json_arrays(docs: DataFrame) -> DataFrame:
    """JSON texts of one column with brackets and commas, so that each partition's file is one JSON array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for batch in batches:
            if len(batch):
                values = batch["value"].tolist()
                yield pd.DataFrame({"value": [before + values[0]] + ["," + v for v in values[1:]]})
                before = ","
        yield pd.DataFrame({"value": ["]" if before == "," else "[]"]})

    return docs.mapInPandas(run, "value string")

"""A keyed table in versions: batches write new folders, and one rename makes them the table."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opswell.operators.tables import newest
from opswell.session import settle
from opswell.sources.writers import exists, move

#: Rows of a bucket above which it is split, and the bits of the hash that a new table's buckets have.
ROWS_PER_BUCKET = 1_000_000
FIRST_BITS = 3


class KeyedTable:
    """One row per key, the newest by `order`; of rows that are equal in it, either.

    path/versions/<n>.json lists the buckets: the leading bits of the key's hash that
    they hold, their folder and number of rows. path/data/<batch>/bucket=<i> are the
    folders. A batch reads and writes the buckets that its keys fall in, into a
    folder of its own, and then names them in the next version, which is written
    beside its place and renamed. A failure before the rename leaves the table as it
    was, and one after it has nothing left to do. A writer's batch that the table has
    seen is passed over, so a stream may deliver a batch again. Two writers that
    start from one version can't both rename theirs: the second one fails.

    A bucket that would grow above `rows_per_bucket` is split by further bits, so a
    bucket is a task's work at any size of the table.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, first_bits: int = FIRST_BITS):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)
        self.rows_per_bucket, self.first_bits = rows_per_bucket, first_bits

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for f in fs.listStatus(folder) if (name := f.getPath().getName()).endswith(".json") and name[:-5].isdigit())

    def state(self) -> dict:
        """What the newest version says; a table without one is empty."""
        versions = self._versions()
        if not versions:
            buckets = [{"bits": self.first_bits, "value": v, "folder": None, "rows": 0} for v in range(1 << self.first_bits)]
            return {"version": 0, "schema": None, "batches": {}, "buckets": buckets}
        text = self.spark.read.option("wholetext", True).text(self._file(versions[-1])).first()[0]
        return json.loads(text)

    def read(self) -> DataFrame | None:
        """The rows of the newest version; None for a table without one."""
        return self._rows(self.state(), None)

    def _rows(self, state: dict, numbers: list[int] | None) -> DataFrame | None:
        if state["schema"] is None:
            return None
        chosen = state["buckets"] if numbers is None else [state["buckets"][i] for i in numbers]
        folders = [f"{self.path}/{b['folder']}" for b in chosen if b["folder"]]
        schema = self.spark.createDataFrame([], state["schema"]).schema
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: list[dict]) -> Column:
        """The number of the bucket a key falls in: its place in a table over the longest leading bits there are."""
        bits = max(b["bits"] for b in buckets)
        place = [0] * (1 << bits)
        for i, b in enumerate(buckets):
            first = b["value"] << (bits - b["bits"])
            place[first : first + (1 << (bits - b["bits"]))] = [i] * (1 << (bits - b["bits"]))
        leading = F.shiftrightunsigned(F.xxhash64(self.key), 64 - bits).cast("int") if bits else F.lit(0)
        return F.get(F.array(*[F.lit(i) for i in place]), leading)

    def upsert(self, updates: DataFrame, batch: int | None = None, writer: str = "", fail=lambda step: None) -> bool:
        """Puts the updates into the table; False if this writer's batch is in it already.

        fail: called with the name of each step when it is done, for tests.
        """
        state = self.state()
        if batch is not None and batch <= state["batches"].get(writer, -1):
            return False
        fresh = settle(newest(updates, [self.key], self.order))
        more = {r["bucket"]: r["n"] for r in fresh.groupBy(self._bucket(state["buckets"]).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
        folder, buckets, new = f"data/{uuid.uuid4().hex}", [], []
        for i, b in enumerate(state["buckets"]):
            if i not in more:
                buckets.append(b)
                continue
            # As many halves as keep the rows within bounds, were all of them new keys.
            split = max(0, math.ceil(math.log2((b["rows"] + more[i]) / self.rows_per_bucket)))
            for v in range(1 << split):
                new.append(len(buckets))
                buckets.append({"bits": b["bits"] + split, "value": (b["value"] << split) + v, "folder": None, "rows": 0})
        old = self._rows(state, list(more)) if more else None
        rows = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
        schema = rows.schema
        target = f"{self.path}/{folder}"
        # One shuffle: a bucket holds its keys whole, so rows dealt by bucket need not move again to be grouped by key.
        dealt = rows.withColumn("bucket", self._bucket(buckets)).repartition(max(1, len(new)), "bucket")
        merged = dealt if old is None else newest(dealt, ["bucket", self.key], self.order)
        merged.write.partitionBy("bucket").parquet(target)
        fail("data")
        written = self.spark.read.schema(f"bucket INT, {_ddl(schema)}").parquet(target)
        for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
            buckets[r["bucket"]] |= {"folder": f"{folder}/bucket={r['bucket']}", "rows": r["n"]}
        state |= {"version": state["version"] + 1, "schema": _ddl(schema), "buckets": buckets}
        if batch is not None:
            state["batches"][writer] = batch
        draft = f"{self.path}/versions/{uuid.uuid4().hex}.draft"
        _write(self.spark, draft, json.dumps(state))
        fail("draft")
        move(self.spark, draft, self._file(state["version"]))
        fail("version")
        return True

    def follow(self, stream: DataFrame, checkpoint: str, writer: str):
        """A stream's writer that upserts each batch; `writer` names the stream and stays the same when it is started again."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: self.upsert(rows, n, writer))


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _write(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class Routes:
    """Sinks that one stream fills, each with a commit of its own for each batch.

    rules: sink -> condition. A row goes to every sink whose condition holds, to
    `otherwise` if none does. A batch is written once, by sink, into a folder of its
    own; then each sink takes its part by one rename, which is its commit. A batch
    that is delivered again goes only to the sinks that do not have it.
    """

    def __init__(self, spark: SparkSession, path: str, rules: dict[str, Column], otherwise: str = "other"):
        self.spark, self.path, self.rules, self.otherwise = spark, path.rstrip("/"), rules, otherwise

    def _part(self, sink: str, batch: int) -> str:
        return f"{self.path}/{sink}/batch={batch}"

    def write(self, rows: DataFrame, batch: int, fail=lambda sink: None) -> None:
        missing = [s for s in [*self.rules, self.otherwise] if not exists(self.spark, self._part(s, batch))]
        if not missing:
            return
        taken = F.filter(F.array(*[F.when(test, F.lit(sink)) for sink, test in self.rules.items()]), lambda s: s.isNotNull())
        named = F.when(F.size(taken) == 0, F.array(F.lit(self.otherwise))).otherwise(taken)
        dealt = rows.withColumn("sink", F.explode(named)).where(F.col("sink").isin(missing))
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        dealt.write.partitionBy("sink").parquet(staging)
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        for sink in missing:
            target, part = self._part(sink, batch), f"{staging}/sink={sink}"
            fs = make(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.mkdirs(make(f"{self.path}/{sink}"))
            if exists(self.spark, part):
                move(self.spark, part, target)
            else:
                fs.mkdirs(make(target))
            fail(sink)

    def read(self, sink: str, schema) -> DataFrame:
        """The rows that a sink has committed."""
        folder = f"{self.path}/{sink}"
        return self.spark.read.schema(schema).parquet(folder) if exists(self.spark, folder) else self.spark.createDataFrame([], schema)

    def follow(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.write)

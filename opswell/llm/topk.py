"""Exact top-k inner products by the three-phase uniform threshold.

The score of a vector is the sum of PARTS partial scores, one for each group of
components. Phase 1: each block of candidates gives, for each query and group,
the list of its k highest partial scores; the best of these lists, scored in
full, give the query's k-th highest score so far, t. Phase 2: t goes with the
queries to all blocks. A vector that scores t or more has a partial score of
t / PARTS or more in some group, so only those entries are looked at, and of them
only those whose sum, with t / PARTS for what is below, can reach t. Phase 3: their
remaining partial scores are resolved, and the k highest of all sums that reach t
are the answer. No vector outside can be in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opswell.llm import vectors
from opswell.session import settle

PARTS = 4
#: Candidates and queries of a block, and queries that are multiplied at a time.
CANDIDATES, QUERIES, AT_A_TIME = 4096, 1024, 256
#: MB of candidates that a task holds while the blocks of queries pass.
HELD_MB = 32


def _read(batch: pa.RecordBatch, i: int, dim: int):
    n = batch.column("n")[i].as_py()
    numbers = np.frombuffer(batch.column("numbers")[i].as_buffer(), np.int64).reshape(n, dim)
    return numbers, np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64).reshape(n, -1)


def _passing(batches: Iterator[pa.RecordBatch], dim: int):
    """(queries, their ids, their cutoffs, the blocks of candidates of their group) for AT_A_TIME queries after the other.

    A group's blocks of candidates come first and are held; its blocks of queries then pass one by one.
    """
    group, held, complete = None, [], False
    for batch in batches:
        for i in range(len(batch)):
            if batch.column("passes")[i].as_py():
                if batch.column("group")[i].as_py() != group:
                    continue  # no block of candidates has come before it
                complete = True
                (q, ids), cutoffs = _read(batch, i, dim), np.frombuffer(batch.column("cutoff")[i].as_buffer() or b"", np.float64)
                for a in range(0, len(q), AT_A_TIME):
                    yield q[a : a + AT_A_TIME], ids[a : a + AT_A_TIME, 0], cutoffs[a : a + AT_A_TIME, None], held
            else:
                if complete or batch.column("group")[i].as_py() != group:
                    group, held, complete = batch.column("group")[i].as_py(), [], False
                held.append(tuple(x.copy() for x in _read(batch, i, dim)))


def _partial(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Partial scores (queries, candidates) of each group of components, exact: in doubles where no sum can pass 2^53, in 64-bit integers otherwise."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0
    if top(q) * top(c) * q.shape[1] < 2.0**53:
        q, c = q.astype(np.float64), c.astype(np.float64)
    cuts = np.linspace(0, q.shape[1], PARTS + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:])]


FIRST = "query_id long, part int, partial long, score long, vec_id long, ids array<long>"


def _highest(p: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` highest of each row, or of all."""
    most = min(most, p.shape[1])
    return np.argpartition(p, p.shape[1] - most, axis=1)[:, p.shape[1] - most :]


def _local_lists(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, q_ids, _, held in _passing(batches, dim):
            rows, best = np.arange(len(q))[:, None], [[] for _ in range(PARTS)]
            for number, (c, _) in enumerate(held):
                parts = _partial(q, c)
                total = sum(parts)
                for g, p in enumerate(parts):
                    at = _highest(p, k + 1)  # one more, as the query may be among them
                    best[g].append((p[rows, at], total[rows, at], np.full(at.shape, number), at))
            for g in range(PARTS):
                p, total, number, at = (np.concatenate(x, axis=1) for x in zip(*best[g]))
                of_all = _highest(p, k + 1)
                p, total, number, at = (x[rows, of_all].ravel() for x in (p, total, number, at))
                ids = np.empty((len(p), held[0][1].shape[1]), np.int64)
                for n in np.unique(number):
                    ids[number == n] = held[n][1][at[number == n]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, of_all.shape[1])),
                        pa.array(np.full(len(p), g, np.int32)),
                        pa.array(p.astype(np.int64)),
                        pa.array(total.astype(np.int64)),
                        pa.array(ids[:, 0]),
                        _lists(ids),
                    ],
                    [f.split()[0] for f in FIRST.split(", ")],
                )

    return run


def _lists(ids: np.ndarray) -> pa.Array:
    kept = ids >= 0
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32), pa.array(ids[kept]))


LAST = "query_id long, score long, ids array<long>"


def _resolved(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, q_ids, t, held in _passing(batches, dim):
            for c, c_ids in held:
                parts, uniform = _partial(q, c), t / PARTS
                enough = np.logical_or.reduce([p >= uniform for p in parts])
                reach = sum(np.maximum(p, uniform) for p in parts)
                row, at = np.nonzero(enough & (reach >= t))
                total = sum(p[row, at] for p in parts)
                hit = total >= t[row, 0]
                row, at, total = row[hit], at[hit], total[hit]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(total.astype(np.int64)), _lists(c_ids[at])], ["query_id", "score", "ids"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k highest of rows (query_id, score, ids) for each query, its own id left out, ties to the smaller vec_id."""
    own = rows.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", place).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all rows but its own.

    rows: vec_id and vector (whole numbers). is_query: a condition on vec_id. Fewer
    candidates than k: all. Ties go to the smaller vec_id. Equal vectors are scored
    once, for the k + 1 smallest of their ids, as no others can be in an answer.
    Rows with the same vec_id count as candidates each; as queries they are asked
    once, with the vector that sorts first, and none of them answers itself. Shorter vectors are
    filled up with zeros. Null vectors, vectors with nulls and null vec_ids take no
    part. Without queries or candidates the result is empty.
    """
    valid = settle(rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())).select("vec_id", "vector"))
    facts = valid.agg(F.max(F.size("vector")).alias("dim"), F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("queries")).first()
    dim = facts["dim"] or 1
    at = lambda n, most: F.pmod(F.xxhash64("vector", F.element_at("ids", 1)), F.lit(max(1, -(-n // most))))
    classes = settle(vectors.blocked(vectors.distinct(valid, k + 1).withColumn("block", at(facts["n"], CANDIDATES)), dim, k + 1, "int64"))
    asked = valid.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("ids", F.array("vec_id"))
    asked = settle(asked.withColumn("block", at(facts["queries"], QUERIES)))
    blocks = max(1, -(-facts["n"] // CANDIDATES))
    held = max(1, HELD_MB * 2**20 // (CANDIDATES * 8 * (dim + k + 1)))
    groups = min(blocks, max(-(-blocks // held), 2 * rows.sparkSession.sparkContext.defaultParallelism))

    def beside(queries: DataFrame) -> DataFrame:
        """Each block of queries after all blocks of candidates of each group, a group in one task.

        They are dealt out together, not joined: the rows of a join's side say little of
        its bytes here, and a side that is taken for a small one goes through the driver.
        """
        columns = ["group", "passes", "n", "numbers", "ids"]
        kept = classes.withColumns({"group": F.pmod("block", F.lit(groups)), "passes": F.lit(False)})
        passing = queries.withColumns({"passes": F.lit(True), "group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))})
        cutoff = F.col("cutoff") if "cutoff" in queries.columns else F.lit(None).cast("binary")
        both = kept.select(*columns, F.lit(None).cast("binary").alias("cutoff")).unionByName(passing.select(*columns, cutoff.alias("cutoff")))
        return both.repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions("group", "passes")

    lists = beside(vectors.blocked(asked, dim, 1, "int64")).mapInArrow(_local_lists(dim, k), FIRST)
    best = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("partial"), "vec_id"))
    seen = lists.withColumn("_place", best).filter(F.col("_place") <= k + 1).dropDuplicates(["query_id", "vec_id"])
    cutoff = _ranked(seen, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).cast("double").alias("cutoff"))
    cut = asked.join(cutoff, asked["vec_id"] == cutoff["query_id"], "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))
    found = beside(vectors.blocked(cut, dim, 1, "int64", ["cutoff"])).mapInArrow(_resolved(dim), LAST)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def quantised(rows: DataFrame, steps: int = 1024) -> DataFrame:
    """vec_id and vector of whole numbers floor(steps * x), of embeddings whose components are all finite."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(steps)) * x.cast("double")))
    return rows.filter(vectors.finite("embedding")).select("vec_id", whole.alias("vector"))


ORACLE = """
WITH good AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

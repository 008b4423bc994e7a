"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids are fitted on a bounded sample and balanced by splitting large lists.
A small graph over them, held in memory, finds the centroids near a vector. A
vector goes into the list of its nearest centroid, and into those of others that
are almost as near. A query goes on to further lists until these hold candidates
enough, and reads all lists whose centroid's distance is within a ratio of the last
one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opswell.llm import vectors
from opswell.session import settle

#: Rows the centroids are fitted on at most, sample rows of a list, and lists at most.
FIT_ROWS, ROWS_PER_LIST, MOST_LISTS = 16_384, 64, 1024
#: Neighbours of a centroid in the graph, and centroids that a search holds.
DEGREE, BEAM = 16, 96
#: A vector is copied to lists, at most so many, whose centroids are within this ratio of its nearest one's distance; a query reads lists likewise, from the nearest with which it has candidates enough.
COPY_RATIO, MOST_COPIES = 1.06, 4
READ_RATIO, LEAST_READ, MOST_READ = 1.4, 8, 80
#: Vectors and queries that are compared at a time.
POSTINGS, QUERIES = 4096, 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(x), 4096)])


def _means(x: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        of = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centroids = centroids.copy()
        centroids[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return centroids


@dataclass
class Graph:
    """Centroids, their neighbours, and where searches begin."""

    centroids: np.ndarray
    near: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, seed: int = 1) -> Graph:
        n, r = len(centroids), np.random.default_rng(seed)
        alike = centroids @ centroids.T
        np.fill_diagonal(alike, -2)
        degree = min(DEGREE, max(n - 1, 1))
        near = np.argsort(-alike, axis=1)[:, :degree]
        # Links to anywhere keep the graph in one piece; each also gets the next by number, so every centroid can be reached.
        far = np.concatenate([r.integers(0, n, (n, 2)), (np.arange(n)[:, None] + 1) % n], axis=1)
        return cls(centroids, np.concatenate([near, far], axis=1), np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int)))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(rows, beam) centroids near each row of x and their distances, nearest first; all rows go one step at a time."""
        n, rows = len(self.centroids), np.arange(len(x))
        beam = min(beam, n)
        seen = np.zeros((len(x), n), bool)
        held = np.full((len(x), beam), -1)
        alike = np.full((len(x), beam), -9.0)
        done = np.ones((len(x), beam), bool)

        def offer(row: np.ndarray, at: np.ndarray):
            """New candidates (rows, several) for the beams of these rows."""
            nonlocal held, alike, done
            fresh = ~seen[row[:, None], at]
            seen[row[:, None], at] = True
            # A candidate named twice in a row counts once.
            order = np.argsort(at, axis=1, kind="stable")
            sorted_ = np.take_along_axis(at, order, axis=1)
            twice = np.zeros(at.shape, bool)
            np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
            value = np.where(fresh & ~twice, np.einsum("rd,rkd->rk", x[row], self.centroids[at]), -9.0)
            all_at, all_value = np.concatenate([held[row], at], axis=1), np.concatenate([alike[row], value], axis=1)
            all_done = np.concatenate([done[row], value < -8], axis=1)
            best = np.argsort(-all_value, axis=1, kind="stable")[:, :beam]
            held[row], alike[row], done[row] = (np.take_along_axis(v, best, axis=1) for v in (all_at, all_value, all_done))

        offer(rows, np.tile(self.begin, (len(x), 1)))
        while True:
            open_ = ~done
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                break
            first = np.argmax(open_[live], axis=1)
            done[live, first] = True
            offer(live, self.near[held[live, first]])
        return held, np.where(alike > -8, np.sqrt(np.maximum(0, 2 - 2 * alike)), np.inf)

    def lists(self, x: np.ndarray, ratio: float, most: int, least: int = 1, held: np.ndarray | None = None, need: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Row and list for each list of each row, nearest first.

        Without `held`, lists whose distance is at most `ratio` times the nearest one's.
        With the number of candidates that each list holds, the distance that counts is
        that of the list with which they are `need`; lists up to it, and the `least`
        nearest, are there even if they are more than `most`.
        """
        rows, found = [], []
        for a in range(0, len(x), 256):
            part = x[a : a + 256]
            at, d = self.search(part, max(BEAM, most, least))
            last = np.zeros(len(part), int)
            if held is not None:
                sums = np.cumsum(np.where(at >= 0, held[at], 0), axis=1)
                if (sums[:, -1] < need).any():
                    alike = part @ self.centroids.T
                    at = np.argsort(-alike, axis=1, kind="stable")
                    d = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(alike, at, axis=1)))
                    sums = np.cumsum(held[at], axis=1)
                last = np.where(sums[:, -1] >= need, np.argmax(sums >= need, axis=1), at.shape[1] - 1)
            place = np.arange(at.shape[1])
            near = (d <= np.take_along_axis(d, last[:, None], axis=1) * ratio + 1e-9) & (place < most)
            r, c = np.nonzero((near | (place <= last[:, None]) | (place < least)) & (at >= 0))
            rows.append(a + r)
            found.append(at[r, c])
        return np.concatenate(rows), np.concatenate(found)


def fit(sample: np.ndarray, rows_per_list: int = ROWS_PER_LIST, most: int = MOST_LISTS, seed: int = 1) -> Graph:
    """Centroids of a sample of unit vectors: means, then lists of over twice their share split in two until none is, or their number is `most`."""
    n = max(1, min(most, len(sample) // rows_per_list))
    r = np.random.default_rng(seed)
    centroids = _means(sample, sample[np.sort(r.choice(len(sample), n, replace=False))], 8)
    for _ in range(8):
        of = _nearest(sample, centroids)
        counts = np.bincount(of, minlength=len(centroids))
        large = np.flatnonzero(counts > 2 * rows_per_list)[: most - len(centroids)]
        centroids = centroids[counts > 0] if not len(large) else centroids
        if not len(large):
            break
        more = []
        for c in large:
            own = sample[of == c]
            two = _means(own, own[[0, int(np.argmin(own @ own[0]))]], 4)
            centroids[c] = two[0]
            more.append(two[1])
        centroids = _means(sample, np.concatenate([centroids, more]), 2)
    return Graph.of(centroids)


def _assign(graph: Graph, dim: int, *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 4096):
                part = batch.slice(first, 4096)
                row, of = graph.lists(unit(vectors.matrix(part.column("vector"), dim, np.float64)), *how)
                nearest = np.append(True, row[1:] != row[:-1])
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("vector").take(row), part.column("ids").take(row), pa.array(of), pa.array(nearest)], ["vector", "ids", "list", "nearest"])

    return run


def _held(posted: DataFrame, lists: int) -> np.ndarray:
    """Distinct vec_ids of each list, each counted in one list only, so that the counts of several lists add up."""
    own = posted.filter("nearest").select("list", F.explode("ids").alias("vec_id")).groupBy("vec_id").agg(F.min("list").alias("list"))
    out = np.zeros(lists, np.int64)
    for r in own.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["list"]] = r["n"]
    return out


FOUND = "query_id long, score double, ids array<long>"


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(queries, vectors) cosines in doubles, by the original numbers."""
    return np.clip(unit(q) @ unit(c).T, -1, 1)


def _compare(dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                get = lambda name, kind, i=i: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
                n, m = batch.column("q_n")[i].as_py(), batch.column("n")[i].as_py()
                q, q_ids = get("q_numbers", np.float64).reshape(n, dim), get("q_ids", np.int64)
                c, c_ids = get("numbers", np.float64).reshape(m, dim), get("ids", np.int64).reshape(m, -1)
                s = cosines(q, c)
                least = np.partition(s, max(m - k - 1, 0), axis=1)[:, max(m - k - 1, 0)]
                row, at = np.nonzero(s >= least[:, None])  # k + 1 each, as the query may be among them, and all that tie with the last
                # Rounding differs with the shape of a product; a score of its own for each pair does not.
                score = np.clip((unit(q)[row] * unit(c)[at]).sum(axis=1), -1, 1)
                ids = c_ids[at]
                kept = ids >= 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype(np.int32), pa.array(ids[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(score), lists], [f.split()[0] for f in FOUND.split(", ")])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of rows (vec_id, embedding) whose components are finite and not all zero."""
    good = vectors.finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    return rows.filter(good).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


def search(rows: DataFrame, is_query, k: int, copy_ratio: float = COPY_RATIO, read_ratio: float = READ_RATIO, most_read: int = MOST_READ) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine of each query among all rows but its own.

    rows: vec_id, embedding. is_query: a condition on vec_id. All rows are indexed;
    the centroids are fitted on FIT_ROWS of the distinct vectors at most, chosen by a
    hash. A list that is larger than POSTINGS is several blocks, each compared in
    full, so none is cut. A query reads the LEAST_READ nearest lists at least, and
    further ones until they hold k rows besides its own, so it has fewer results only
    if the table has fewer rows.

    Null and zero vectors, vectors with null or non-finite components and null
    vec_ids take no part. Shorter vectors are filled up with zeros. Equal vectors are
    indexed once, with the k + 1 smallest of their ids. Ties go to the smaller
    vec_id. Rows with the same vec_id are candidates each and one query, with the
    vector that sorts first. Without rows the result is empty.
    """
    valid = settle(usable(rows))
    dim = valid.agg(F.max(F.size("vector"))).first()[0] or 1
    classes = settle(vectors.distinct(valid, k + 1))
    sample = classes.orderBy(F.xxhash64("vector"), F.element_at("ids", 1)).select("vector").limit(FIT_ROWS).toPandas()["vector"]
    if not len(sample):
        return valid.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        fitted[i, : len(v)] = v
    graph = fit(unit(fitted))

    schema = "vector array<double>, ids array<long>, list long, nearest boolean"
    posted = settle(classes.mapInArrow(_assign(graph, dim, copy_ratio, MOST_COPIES), schema))
    asked = valid.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vector", F.array("vec_id").alias("ids"))
    held = _held(posted, len(graph.centroids))
    asked = asked.mapInArrow(_assign(graph, dim, read_ratio, most_read, LEAST_READ, held, k + 1), schema)

    def parts(of: DataFrame, most: int, width: int) -> DataFrame:
        """Blocks of a list, as many as its rows ask for."""
        sizes = of.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
        cut = of.join(sizes, "list").withColumn("_part", F.pmod(F.xxhash64("vector", F.element_at("ids", 1)), F.col("_parts")))
        return vectors.blocked(cut.withColumn("block", F.col("list") + F.col("_part") * len(graph.centroids)), dim, width, "float64").withColumn("list", F.col("block") % len(graph.centroids))

    questions = parts(settle(asked), QUERIES, 1)
    questions = questions.select("list", *[F.col(c).alias(f"q_{c}") for c in ("block", "n", "numbers", "ids")])
    pairs = questions.join(parts(posted, POSTINGS, k + 1), "list").repartition("block", "q_block")
    found = pairs.mapInArrow(_compare(dim, k), FOUND)
    # A vector that several lists hold is found several times.
    own = found.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    once = own.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate classes: b-bit MinHash over word shingles, candidates by bands, links confirmed on full sets.

1. Each text's set of shingles gives an exact key, HASHES minima of which the low
   BITS bits are packed as its signature, and a key for each band of minima.
2. Rows with the same set are one class; one row stands for it.
3. Classes that share a band are compared by the bits of their signatures. The
   share of equal fields, corrected for chance, estimates the similarity; links
   well below the threshold are out. What is left links classes to clusters.
4. In each cluster, links are confirmed on the full sets, and the confirmed links'
   components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opswell.llm.components import components
from opswell.llm.rows import carried
from opswell.llm.shingles import mix64, shingle_sets
from opswell.session import settle

#: Hash functions, low bits of each minimum that are kept, bands and minima in a band.
HASHES, BITS = 128, 2
BANDS, ROWS = 24, 5
FIELDS_PER_LONG = 64 // BITS
LONGS = HASHES // FIELDS_PER_LONG
#: Standard errors below the threshold at which an estimate still counts as a candidate.
SLACK = 4.5
#: Members of a band's bucket, and shingles of a cluster, that one task compares; larger ones are split into blocks, and pairs of blocks compared.
BUCKET_BLOCK = 4096
CLUSTER_BLOCK = 2_000_000
_CHUNK = 1 << 15


def _minima(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima of the sets, which are not empty."""
    seeds = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.full((len(sizes), HASHES), np.iinfo(np.uint64).max, np.uint64)
    starts = np.cumsum(sizes) - sizes

    def lower(a: int, b: int, at: np.ndarray, rows: slice):
        x = values[a:b]
        for k in range(HASHES):
            low = np.minimum.reduceat((x ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), at)
            np.minimum(out[rows, k], low, out=out[rows, k])

    first = 0
    while first < len(sizes):
        until = max(first + 1, int(np.searchsorted(starts, starts[first] + _CHUNK)))
        a, end = int(starts[first]), int(starts[until - 1] + sizes[until - 1])
        lower(a, min(end, a + _CHUNK), starts[first:until] - a, slice(first, until))
        for more in range(a + _CHUNK, end, _CHUNK):  # what is left of the last text
            lower(more, min(end, more + _CHUNK), np.zeros(1, np.int64), slice(until - 1, until))
        first = until
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """(texts, LONGS): the low BITS bits of each minimum, after a mix of it."""
    fields = (mix64(minima) & np.uint64((1 << BITS) - 1)).reshape(len(minima), LONGS, FIELDS_PER_LONG)
    return np.bitwise_or.reduce(fields << (np.arange(FIELDS_PER_LONG, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(minima), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix64(keys ^ minima[:, j : BANDS * ROWS : ROWS]) + np.uint64(j)
    return mix64(keys ^ np.arange(BANDS, dtype=np.uint64))


def fewest_equal(threshold: float) -> int:
    """Equal fields of two signatures below which their sets' similarity is not `threshold` by all likelihood."""
    chance = 0.5**BITS
    share = chance + (1 - chance) * threshold
    return int(np.floor(HASHES * share - SLACK * np.sqrt(HASHES * share * (1 - share))))


def equal_fields(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = differs = one ^ many
    for k in range(1, BITS):
        differs = differs | (x >> np.uint64(k))
    ones = np.uint64(sum(1 << (BITS * i) for i in range(FIELDS_PER_LONG)))
    return HASHES - np.bitwise_count(differs & ones).sum(axis=1, dtype=np.int64)


SIGNATURES = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, signature array<long>, bands array<long>"


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2000):
                part = batch.slice(first, 2000)
                values, sizes = shingle_sets(part.column("text"), width)
                some = sizes > 0
                m = _minima(values, sizes[some])
                starts = (np.cumsum(sizes) - sizes)[some]
                keys = np.zeros((2, len(sizes)), np.uint64)
                for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                    if len(starts):
                        keys[k, some] = mix64(np.add.reduceat(mix64(values ^ np.uint64(salt)), starts) ^ sizes[some].astype(np.uint64))
                empty = pa.array(~some)
                lists = [
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some) * n]).astype(np.int32), pa.array(v.ravel().view(np.int64)))
                    for n, v in ((LONGS, _packed(m)), (BANDS, _band_keys(m)))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes), *(pa.array(k.view(np.int64), mask=np.asarray(empty)) for k in keys), *lists],
                    [f.split()[0] for f in SIGNATURES.split(", ")],
                )

    return run


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Signature, exact key and band keys of each row of docs (doc_id, text), with a row number that is its own."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_signatures(width), SIGNATURES)
    return settle(rows.withColumn("row", F.monotonically_increasing_id()))


def _linked(linked_to, n: int) -> np.ndarray:
    """Component of each of n members. linked_to(i, rest): which of the members `rest` link to member i.

    A member is compared only with those that no component holds yet, so a group
    that hangs together is done in little more than one pass.
    """
    component, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        component[root] = root
        stack = [root]
        while stack and len(rest):
            hit = linked_to(stack.pop(), rest)
            found, rest = rest[hit], rest[~hit]
            component[found] = root
            stack += found.tolist()
    return component


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Batches of the rows with equal keys, from batches sorted by them and `row`; a repeated row comes once."""
    for run in _runs(batches, keys):
        cols = [np.asarray(run.column(k)) for k in keys]
        starts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1).tolist(), len(run)]
        for a, b in zip(starts[:-1], starts[1:]):
            yield run.slice(a, b - a)


def _without_repeats(batches: Iterator[pa.RecordBatch], keys: list[str]):
    last = None
    for batch in batches:
        if len(batch):
            cols = [np.asarray(batch.column(k)) for k in keys]
            same = np.zeros(len(batch), bool)
            same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in cols])
            same[0] = last == [c[0] for c in cols]
            last = [c[-1] for c in cols]
            yield batch.filter(pa.array(~same))


EDGES = "a long, b long"


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bucket_edges(threshold: float):
    fewest = fewest_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        pending: list[np.ndarray] = []

        def pairs():
            """Groups of two, many at a time."""
            x = np.concatenate(pending)
            s = x[:, :, 1:].view(np.uint64)
            hit = equal_fields(s[:, 0], s[:, 1]) >= fewest
            r = x[hit, :, 0]
            return _edges(r.min(axis=1), r.max(axis=1))

        for batch in _runs(batches, ["key", "one", "two"]):
            cols = [np.asarray(batch.column(k)) for k in ("key", "one", "two")]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            sizes = np.diff(np.append(starts, len(batch)))
            rows = np.stack([np.asarray(batch.column(c)) for c in ("row", *(f"s{i}" for i in range(LONGS)))], axis=1)
            two = starts[sizes == 2]
            if len(two):
                pending = [np.stack([rows[two], rows[two + 1]], axis=1)]
                yield pairs()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = rows[s : s + n]
                sig = own[:, 1:].copy().view(np.uint64)
                c = _linked(lambda i, rest: equal_fields(sig[i], sig[rest]) >= fewest, n)
                other = c != np.arange(n)
                a.append(own[c[other], 0])
                b.append(own[other, 0])
            if sum(map(len, a)) > 50_000:
                yield _edges(np.concatenate(a), np.concatenate(b))
                a, b = [], []
        if a:
            yield _edges(np.concatenate(a), np.concatenate(b))

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """The batches, cut anew where a key changes, so that no group of rows is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        if held and any(held[-1].column(k)[len(held[-1]) - 1].as_py() != c[0] for k, c in zip(keys, cols)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _in_blocks(rows: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Adds `one` and `two`, the pair of blocks that a row is compared in; groups that are not hot are the one pair (0, 0).

    hot: keys and `_blocks` of the groups that are too large for one task.
    """
    cut = rows.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_block", F.pmod(F.xxhash64("row"), F.col("_blocks")))
    return cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(
        *rows.columns, F.least("_block", "_other").alias("one"), F.greatest("_block", "_other").alias("two")
    )


def clusters(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, root): classes (row, signature, bands) that estimates of the similarity link, directly or through others."""
    rows = classes.select("row", *[F.col("signature")[i].alias(f"s{i}") for i in range(LONGS)], F.explode("bands").alias("key"))
    hot = rows.groupBy("key").count().filter(F.col("count") > BUCKET_BLOCK)
    hot = settle(hot.select("key", F.ceil(F.col("count") / BUCKET_BLOCK).alias("_blocks")))
    if hot.isEmpty():  # the common case needs no join; the result is the same
        blocked = rows.withColumns({"one": F.lit(0).cast("long"), "two": F.lit(0).cast("long")})
    else:
        blocked = _in_blocks(rows, ["key"], hot)
    edges = blocked.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_bucket_edges(threshold), EDGES)
    return components(settle(edges.distinct()))


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["root", "one", "two"]
        for group in _groups(_without_repeats(batches, [*keys, "row"]), keys):
            rows = np.asarray(group.column("row"))
            values, sizes = shingle_sets(group.column("text"), width)
            # Shingles of the group as small numbers: a member's set marks them, and the marks in the other sets are counted.
            distinct, numbers = np.unique(values, return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            marks = np.zeros(len(distinct), np.int64)

            def linked_to(i, rest):
                own = numbers[starts[i] : starts[i] + sizes[i]]
                large = np.maximum(sizes[i], sizes[rest])
                hit = 100 * np.minimum(sizes[i], sizes[rest]) >= percent * large  # sizes alone rule some out
                near = rest[hit]
                if len(near):
                    marks[own] = 1
                    n = sizes[near]
                    at = np.arange(int(n.sum())) + np.repeat(starts[near] - (np.cumsum(n) - n), n)
                    common = np.add.reduceat(marks[numbers[at]], np.cumsum(n) - n)
                    marks[own] = 0
                    hit[hit] = 100 * common >= percent * (sizes[i] + n - common)
                return hit

            c = _linked(linked_to, len(rows))
            low = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(low, c, rows)
            yield _edges(low[c], rows)

    return run


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, text_key, n_shingles and root (the row that names its component) of each row of docs (doc_id, text)."""
    signed = signatures(docs, width)
    filled = signed.filter("n_shingles > 0")
    same = filled.groupBy("set_a", "set_b").agg(F.min("row").alias("class"))
    members = settle(filled.select("row", "doc_id", "text_key", "n_shingles", "set_a", "set_b").join(same, ["set_a", "set_b"]).drop("set_a", "set_b"))
    stands = filled.join(members.filter("row = class").select("row"), "row", "left_semi")
    found = clusters(stands.select("row", "signature", "bands"), percent / 100)

    # Full sets are made from the texts of clustered classes only. The clustered rows grow with the table, so they are never broadcast, however few they are.
    clustered = settle(stands.select("row", "doc_id", "text_key", "n_shingles").join(found.withColumnRenamed("node", "row"), "row"))
    large = clustered.groupBy("root").agg(F.sum("n_shingles").alias("_n")).filter(F.col("_n") > CLUSTER_BLOCK)
    blocked = _in_blocks(clustered, ["root"], large.select("root", F.ceil(F.col("_n") / CLUSTER_BLOCK).alias("_blocks")))
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text")
    wanted = blocked.join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("root", "one", "two", "row", "text")
    sets = wanted.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "row")
    links = settle(sets.mapInArrow(_confirmed(width, percent), EDGES).distinct())
    joined = components(links).select(F.col("node").alias("class"), "root")

    rooted = members.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    columns = ["row", "doc_id", "text_key", "n_shingles", "root"]
    return settle(rooted.select(*columns).unionByName(signed.filter("n_shingles = 0").withColumn("root", F.col("row")).select(*columns)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Words are separated by ASCII white space, A-Z in lower case. Rows are linked if
    100 * common shingles >= percent * all shingles of the two. component_id is the
    smallest doc_id that links reach; kept tells the row that has it.

    Null, empty and blank texts have an empty set, are linked with nothing and are
    their own component. Texts of fewer than `width` words are one shingle. Rows with
    the same doc_id are nodes of their own; those of a component all get its smallest
    doc_id, and one that has it as its own is kept, repeated or not. A null doc_id
    counts as larger than any other; alone it has a null component and is not kept.
    Without rows the result is empty.
    """
    rooted = classes(docs, width, percent)
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return rooted.join(smallest, "root").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with their columns, of which each component keeps one: that of the smallest doc_id, nulls last. Rows without words all stay."""
    rooted = classes(docs.select("doc_id", "text"), width, percent)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_first"))
    stay = first.select(F.col("_first.row").alias("row"), F.lit(1).alias("_n")).join(rooted, "row")
    # Rows that agree in doc_id and text are told apart by nothing else here: as many of them stay as were chosen.
    chosen = stay.groupBy("doc_id", "text_key").agg(F.sum("_n").alias("_n")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_n")
    place = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.xxhash64("_doc")))
    with_key = carried(docs).withColumn("_text_key", F.xxhash64("text"))
    found = with_key.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    return found.withColumn("_place", place).filter("_place <= _n").select("_doc.*")

"""A byte-level convolutional network in numpy that scores whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Numbers of a byte, bytes of a filter, bytes from one place to the next, filters, and units of the last layer.
DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Bytes of a chunk; chunks overlap by what a filter covers, so that no place between chunks is missed.
CHUNK = 512
STEP = CHUNK - WIDTH + STRIDE
#: Bound of the rows that the network is fitted on, whole, and of their bytes.
FIT_ROWS, FIT_BYTES = 3000, 12 << 20
#: Chunks that are cut out at a time.
PART = 512
STEPS, BATCH, RATE = 400, 64, 0.005
#: Score from which a text counts as good.
ACCEPT = 0.3


class Chunks:
    """Overlapping chunks that cover all bytes of each text, zeros after its end; counts: how many each text has, one at least. Null is empty.

    They are cut out of the texts when they are asked for, some at a time.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.counts = 1 + np.maximum(0, -(-(np.diff(self.offsets) - CHUNK) // STEP))
        self.starts = np.cumsum(self.counts) - self.counts

    def __len__(self) -> int:
        return int(self.counts.sum())

    def part(self, first: int, until: int) -> np.ndarray:
        """The chunks from number `first` to before `until`, as (n, CHUNK) bytes."""
        number = np.arange(first, min(until, len(self)))
        row = np.searchsorted(self.starts, number, "right") - 1
        begin = self.offsets[row] + (number - self.starts[row]) * STEP
        out = np.zeros((len(number), CHUNK), np.uint8)
        for i, (a, b) in enumerate(zip(begin.tolist(), np.minimum(begin + CHUNK, self.offsets[row + 1]).tolist())):
            out[i, : b - a] = self.data[a:b]
        return out


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of some texts, (n, CHUNK) bytes, and how many each text has."""
    some = Chunks(texts)
    return some.part(0, len(some)), some.counts


@dataclass
class Network:
    """Bytes to numbers, filters over them, the maximum of each filter in each chunk, the mean and the maximum of those over the chunks, and two layers to one probability."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(
            f(256, DIM, scale=0.5), f(WIDTH * DIM, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
            f(2 * FILTERS, HIDDEN, scale=0.15), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.3), np.zeros(1, np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def windows(self, some: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * DIM) numbers that the filters see."""
        x = np.lib.stride_tricks.sliding_window_view(self.embed[some].reshape(len(some), -1), WIDTH * DIM, axis=1)
        return x[:, :: STRIDE * DIM]

    def pooled(self, some: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter in each chunk, and its place."""
        best, place = np.zeros((len(some), FILTERS), np.float32), np.zeros((len(some), FILTERS), np.int64)
        for a in range(0, len(some), block):
            x = self.windows(some[a : a + block])
            y = (np.ascontiguousarray(x).reshape(-1, WIDTH * DIM) @ self.filters).reshape(x.shape[0], x.shape[1], FILTERS)
            place[a : a + block] = y.argmax(axis=1)
            best[a : a + block] = np.take_along_axis(y, place[a : a + block, None], axis=1)[:, 0]
        return best + self.bias, place

    def highest(self, some: np.ndarray, block: int = 32) -> np.ndarray:
        out = np.zeros((len(some), FILTERS), np.float32)
        for a in range(0, len(some), block):
            x = self.windows(some[a : a + block])
            y = np.ascontiguousarray(x).reshape(-1, WIDTH * DIM) @ self.filters
            out[a : a + block] = y.reshape(x.shape[0], x.shape[1], FILTERS).max(axis=1)
        return out + self.bias

    def combined(self, best: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        live = np.maximum(best, 0)
        features = np.concatenate([np.add.reduceat(live, starts) / counts[:, None], np.maximum.reduceat(live, starts)], axis=1)
        hidden = np.tanh(features @ self.inner + self.inner_bias)
        return features, hidden, 1 / (1 + np.exp(-(hidden @ self.outer + self.outer_bias[0]).astype(np.float64)))

    def score(self, texts: pa.Array, most: int = PART) -> np.ndarray:
        """A probability for each text, from all its bytes.

        Chunks are cut out and pooled `most` at a time, also within a text; what is
        kept of a chunk is the answer of each filter.
        """
        if not len(texts):
            return np.zeros(0)
        some = Chunks(texts)
        best = np.concatenate([self.highest(some.part(a, a + most)) for a in range(0, len(some), most)])
        return self.combined(best, some.starts, some.counts)[2]


def fit(some: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int | None = None, seed: int = 1) -> Network:
    """Learns from the chunks of texts and their labels by Adam, in `steps` (STEPS) batches or some more. Without both labels every text gets the same score."""
    net = Network.fresh(seed)
    if not len(labels) or labels.min() == labels.max():
        net.outer[:] = 0
        net.outer_bias[0] = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
        return net
    net.outer_bias[0] = np.log(labels.mean() / (1 - labels.mean()))
    r = np.random.default_rng(seed)
    weights = net.weights()
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    starts = np.cumsum(counts) - counts
    epochs = -(-(steps or STEPS) // -(-len(labels) // BATCH))
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            n = counts[docs]
            at = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in docs])
            begin = np.cumsum(n) - n
            own = some[at]
            best, place = net.pooled(own)
            features, hidden, p = net.combined(best, begin, n)
            off = ((p - labels[docs]) / len(docs)).astype(np.float32)
            back_hidden = off[:, None] * net.outer * (1 - hidden**2)
            back = back_hidden @ net.inner.T
            row = np.repeat(np.arange(len(docs)), n)
            live = np.maximum(best, 0)
            top = live == features[row, FILTERS:]
            ties = np.add.reduceat(top.astype(np.float32), begin)
            grad = (back[row, :FILTERS] / n[row][:, None] + back[row, FILTERS:] * top / ties[row]) * (best > 0)
            # Only the place of each maximum has a share in the answer.
            x = net.windows(own)[np.arange(len(own))[:, None], place]
            g_filters = np.einsum("cfk,cf->kf", x, grad)
            g_x = (grad[:, :, None] * net.filters.T[None]).reshape(len(own), FILTERS, WIDTH, DIM)
            bytes_ = own[np.arange(len(own))[:, None, None], place[:, :, None] * STRIDE + np.arange(WIDTH)]
            g_x, bytes_ = g_x.reshape(-1, DIM), bytes_.ravel()
            g_embed = np.stack([np.bincount(bytes_, g_x[:, d], 256) for d in range(DIM)], axis=1)
            grads = [g_embed, g_filters, grad.sum(axis=0), features.T @ back_hidden, back_hidden.sum(axis=0), hidden.T @ off, np.array([off.sum()], np.float32)]
            t += 1
            for i, (w, g) in enumerate(zip(weights, grads)):
                g = g.astype(np.float32) + 1e-4 * w * (w.ndim > 1)
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w -= (RATE * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Network:
    """A network fitted on docs (doc_id, text) and labels (doc_id, label).

    At most `rows` labelled documents come to the driver, in the order of a hash of
    doc_id, with their whole texts; as many as have `most_bytes` together. Texts
    longer than that are passed over. Rows without a label or doc_id
    are not learned from. Of a doc_id with several labels the smallest counts; of
    several texts, all.
    """
    one = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by `rows`, so it can be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("size", F.octet_length("text"))
    fitting = texts.filter(F.col("size") <= most_bytes).orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "size")
    sizes = [r[0] for r in fitting.select("size").limit(rows).collect()]
    held = int((np.cumsum(sizes) <= most_bytes).sum())
    got = fitting.limit(held).select("text", "label").collect()
    some, counts = chunks(pa.array([r.text for r in got], pa.large_string()))
    return fit(some, counts, np.array([r.label for r in got], np.float32))


def score(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The columns of `keep` with score (0 to 1) of docs (text and `keep`), and rows in the same number. Null texts score as empty ones."""

    text = "text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(net.score(batch.column(text)))], [*keep, "score"])

    rows = docs.select(*keep, *([] if text in keep else [F.col("text").alias("_text")]))
    schema = rows.select(*keep).schema.add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out(c: str = "doc_id"):
    """True for the fifth of doc_ids that labels are not learned from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of `keep` with score and predicted (1 from ACCEPT on) for all docs, learned from labels (doc_id, label) that are not held out.

    Empty and null texts are scored like any other, of any length in bounded memory.
    Repeated rows are scored each. Without labels every score is 0.5; without
    documents the result is empty.
    """
    net = learn(docs, labels.filter(~held_out()))
    return score(docs, net, keep).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that are predicted to be good; nulls, repeated rows and empty tables as in `classify`."""
    # The text goes to Python once, beside the other columns as one.
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"])
    found = classify(docs.select("doc_id", rest.alias("_rest"), "text"), labels, ["_rest", "text"])
    return found.filter("predicted = 1").select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])

"""Operator 6, quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In a chunk, learned byte
vectors go through learned filters (width 8, step 2), each filter's largest response is kept and
a hidden layer follows; mean and maximum of the hidden values over the chunks combine
into one probability. The network is trained with Adam on at most `ROWS` labelled texts (those
with the smallest hash of the id), `VIEWS` chunks of each drawn anew every epoch. Of a text with more than
`DRAWN` chunks, that many reach the trainer, drawn over the whole text; scoring reads every byte.

Defined results: a null or empty text is one chunk of padding and gets a score too; rows with a
null or repeated id are scored each; without labels every score is 0.5; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, utf8

#: Bounds of the training sample: rows, and chunks of a row.
ROWS, DRAWN, VIEWS, STEPS = 3000, 64, 4, 420
CHUNK, STEP, PAD = 256, 224, 0
VECTOR, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 24, 12


def chunks(data: np.ndarray) -> np.ndarray:
    """Rows of CHUNK bytes, STEP apart, that cover all bytes; padded at the end."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.uint8)
    padded[: len(data)] = data
    return sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class Network:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN
    out_bias: np.ndarray

    def windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * VECTOR) inputs of the filters."""
        flat = self.vectors[x].reshape(len(x), -1)
        return sliding_window_view(flat, WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]

    def chunk_values(self, x: np.ndarray) -> np.ndarray:
        """Hidden values of chunks."""
        out = np.empty((len(x), HIDDEN), np.float32)
        for k in range(0, len(x), 128):
            w = self.windows(x[k : k + 128])
            pooled = (np.ascontiguousarray(w).reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(w.shape[0], w.shape[1], FILTERS).max(1)
            out[k : k + 128] = np.tanh(np.maximum(pooled + self.bias, 0) @ self.hidden + self.hidden_bias)
        return out

    def combine(self, values: np.ndarray, owner_starts: np.ndarray) -> np.ndarray:
        """Probability of each text from its chunks' hidden values."""
        n = np.diff(np.append(owner_starts, len(values)))[:, None]
        both = np.concatenate([np.add.reduceat(values, owner_starts) / n, np.maximum.reduceat(values, owner_starts)], 1)
        return 1 / (1 + np.exp(-(both @ self.out + self.out_bias[0]).astype(np.float64)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each text of a batch; chunks of neighbouring texts go through together."""
        scores, held, starts, waiting = [], [], [], 0
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = chunks(data[a:b])
            starts.append(waiting)
            held.append(own)
            waiting += len(own)
            if waiting >= 1024:
                scores.append(self._held(held, starts))
                held, starts, waiting = [], [], 0
        if held:
            scores.append(self._held(held, starts))
        return np.concatenate(scores) if scores else np.zeros(0)

    def _held(self, held: list[np.ndarray], starts: list[int]) -> np.ndarray:
        return self.combine(np.concatenate([self.chunk_values(x) for x in held]) if len(held) == 1 else self.chunk_values(np.concatenate(held)), np.array(starts))


def _fresh(rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    return Network(draw(256, VECTOR, scale=0.5), draw(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5), zero(FILTERS), draw(FILTERS, HIDDEN, scale=FILTERS**-0.5), zero(HIDDEN), draw(2 * HIDDEN, scale=0.2), zero(1))


def _gradient(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss for texts of x.shape[1] chunks each: x (texts, views, CHUNK)."""
    texts, views = x.shape[:2]
    flat = x.reshape(-1, CHUNK)
    w = np.ascontiguousarray(net.windows(flat))
    response = (w.reshape(-1, WIDTH * VECTOR) @ net.filters).reshape(len(flat), -1, FILTERS)
    where = response.argmax(1)
    pooled = np.take_along_axis(response, where[:, None], 1)[:, 0] + net.bias
    active = np.maximum(pooled, 0)
    h = np.tanh(active @ net.hidden + net.hidden_bias).reshape(texts, views, HIDDEN)
    top = h.argmax(1)
    both = np.concatenate([h.mean(1), np.take_along_axis(h, top[:, None], 1)[:, 0]], 1)
    p = 1 / (1 + np.exp(-(both @ net.out + net.out_bias[0])))
    d = ((p - y) / texts).astype(np.float32)
    d_both = d[:, None] * net.out
    d_h = np.repeat(d_both[:, None, :HIDDEN] / views, views, 1)
    extra = np.zeros_like(d_h)
    np.put_along_axis(extra, top[:, None], d_both[:, None, HIDDEN:], 1)
    d_z = ((d_h + extra) * (1 - h * h)).reshape(-1, HIDDEN)
    d_pooled = (d_z @ net.hidden.T) * (pooled > 0)
    rows = np.arange(len(flat))[:, None]
    picked = w[rows, where]  # (chunks, FILTERS, WIDTH * VECTOR)
    d_filters = np.einsum("cf,cfk->kf", d_pooled, picked)
    d_picked = (d_pooled[:, :, None] * net.filters.T[None]).reshape(len(flat), FILTERS, WIDTH, VECTOR)
    at = (where * STRIDE)[:, :, None] + np.arange(WIDTH)
    letters = flat[rows[:, :, None], at]
    d_vectors = np.zeros_like(net.vectors)
    for k in range(VECTOR):
        d_vectors[:, k] = np.bincount(letters.ravel(), d_picked[..., k].ravel(), 256)
    return [d_vectors, d_filters, d_pooled.sum(0), active.T @ d_z, d_z.sum(0), both.T @ d, np.array([d.sum()], np.float32)]


def train(cut: list[np.ndarray], labels: list[int], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam with a falling rate on chunks (rows of CHUNK bytes) drawn anew every epoch; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = _fresh(rng)
    if not cut:
        net.out[:] = 0
        return net
    y = np.array(labels, np.float32)
    names = list(vars(net))
    m, v = ([np.zeros_like(getattr(net, k)) for k in names] for _ in range(2))
    step, size = 0, 64
    epochs = -(-steps // -(-len(cut) // size))
    total = epochs * -(-len(cut) // size)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for k in range(0, len(order), size):
            some = order[k : k + size]
            x = np.stack([cut[i][rng.integers(0, len(cut[i]), VIEWS)] for i in some])
            step += 1
            rate = 0.01 * (1 - step / (total + 1)) + 1e-4
            for j, (name, g) in enumerate(zip(names, _gradient(net, x, y[some]), strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                value = getattr(net, name)
                value -= (rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id"):
    """Whether a row's label may not be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Trains on a bounded sample of the labelled rows that aren't held out."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(id_col).alias("order"))
    chosen = marked.orderBy("order", "label_id", "label").limit(rows)
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data")).join(F.broadcast(chosen), F.col(id_col) == F.col("label_id"))  # chosen: `rows` rows at most
    # the places of the chunks as `chunks` cuts them: all, or DRAWN of them by a hash, one from each of DRAWN equal runs
    count = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), F.octet_length("data") - CHUNK) / STEP) + 1).cast("long")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(DRAWN - 1)), lambda k: F.floor((k + F.pmod(F.xxhash64("order", k), F.lit(1000)) / 1000) * F.col("count") / DRAWN))
    places = F.when(F.col("count") <= DRAWN, F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).otherwise(drawn)
    cut = F.transform("places", lambda k: F.substring("data", (k * STEP + 1).cast("int"), F.lit(CHUNK)))
    found = found.withColumn("count", count).withColumn("places", places).select("order", "label_id", "label", cut.alias("cut"))
    got = found.orderBy("order", "label_id", "cut").limit(rows).collect()
    return train([np.stack([chunks(np.frombuffer(c, np.uint8))[0] for c in r["cut"]]) for r in got], [r["label"] for r in got])


def score(df: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with a score column; all other columns pass through."""
    fields = [f for f in df.schema if f.name != score_col]
    at = [f.name for f in fields].index(text_col)

    def run(batches):
        for b in small(batches):
            own = np.round(net.score(*utf8(b.column(at))), 6)  # how texts are batched shows in the last digits only
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{score_col}` double"
    return df.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = fit(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

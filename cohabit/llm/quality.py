"""Quality classifier (operator 2): a factorisation machine over documents.

raw = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2],  score = sigmoid(scale raw + shift)

The bracket is the sum-of-squares identity, so all pairs of features interact in time
linear in the features.  Features are hashed words, binned structure statistics of
the text, and binned numeric metadata columns that the caller names.

The model is fitted on at most ``max_rows`` labelled rows (those with the smallest
hash of their key) by sharded AdaGrad with parameter averaging: each round is one Spark
job, and only ``shards`` parameter vectors of fixed size meet at the driver.  An eighth of those rows is kept
from training and sets scale and shift (Platt 1999, with smoothed targets), so that scores are probabilities.  Scoring
is one map over whole texts without a shuffle.

Defined results: null and empty texts have no words and get the score of their
statistics; without labelled rows every score is 0.5; labels that are null are not
used; repeated rows are scored alike.  Added columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SOLID, Words, words
from .common import discard, without, written

WORD_BITS, STATS, BINS, META_BINS = 15, 16, 24, 64
_LINE = np.array([b != 0x0A for b in range(256)])
_NAMES = ("upper", "lower", "digit", "space", "newline", "dot", "mark", "bar", "odd", "other", "beyond")


def _class(b: int) -> int:
    ch = chr(b)
    if b >= 0x80:
        return 10
    for k, has in enumerate((ch.isupper(), ch.islower(), ch.isdigit(), ch in " \t\r", ch == "\n", ch in ".,;:", ch in "!?", ch in "|", ch in "#$%&*~^_=+<>")):
        if has:
            return k
    return 9


_CLASS = np.array([_class(b) for b in range(256)], dtype=np.int32)
_SYMBOL = np.isin(_CLASS, (5, 6, 7, 8, 9))


@dataclass(frozen=True)
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    n_rows: int = 0
    scale: float = 1.0
    shift: float = 0.0

    @staticmethod
    def size(n_meta: int) -> int:
        return (1 << WORD_BITS) + STATS * BINS + n_meta * META_BINS


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def _features(w: Words, lines: Words, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR arrays (pointers, indices, values) of the rows of one chunk; meta: rows x columns, NaN for null."""
    n, n_words, n_bytes = w.rows, np.diff(w.at), np.diff(w.offsets)
    bucket = (w.hashes() & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    keys, tf = np.unique((w.row_of_word() << WORD_BITS) | bucket, return_counts=True)
    row, idx = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    val = np.log1p(tf)
    at = np.searchsorted(row, np.arange(n + 1))
    val /= np.sqrt(np.maximum(_row_sums(val * val, at), 1e-12))[row] if len(row) else 1

    hist = np.bincount(np.repeat(np.arange(n) * 11, n_bytes) + _CLASS[w.data], minlength=n * 11).reshape(n, 11)
    share = np.sqrt(hist / np.maximum(n_bytes, 1)[:, None])
    line_keys, line_tf = np.unique(np.stack((lines.row_of_word().astype(np.uint64), lines.hashes())), axis=1, return_counts=True)
    line_row = line_keys[0].astype(np.int64)
    n_lines, again = np.diff(lines.at), np.bincount(line_row, weights=line_tf - 1, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, tf)
    ends = _row_sums(_SYMBOL[w.data[w.end - 1]], w.at) if len(w.end) else np.zeros(n)
    stats = np.column_stack((share[:, [0, 2, 3, 4, 5, 6, 7, 8, 9, 10]], np.log1p(n_words) / 12, (n_bytes / np.maximum(n_words, 1)) / 24, np.diff(at) / np.maximum(n_words, 1), again / np.maximum(n_lines, 1), ends / np.maximum(n_words, 1), most / np.maximum(n_words, 1)))
    bins = np.minimum((np.clip(stats, 0, 1) * BINS).astype(np.int64), BINS - 1) + np.arange(STATS) * BINS + (1 << WORD_BITS)
    if meta.shape[1]:
        m = np.where(np.isnan(meta), META_BINS - 1, np.clip(2 * np.log2(np.maximum(np.nan_to_num(meta), 0) + 1), 0, META_BINS - 2)).astype(np.int64)
        bins = np.hstack((bins, m + np.arange(meta.shape[1]) * META_BINS + (1 << WORD_BITS) + STATS * BINS))
    k = bins.shape[1]
    ptr = at + np.arange(n + 1) * k
    out_i, out_v = np.empty(ptr[-1], dtype=np.int32), np.empty(ptr[-1], dtype=np.float32)
    to = np.arange(len(idx)) + row * k
    out_i[to], out_v[to] = idx, val
    to = (at[1:] + np.arange(n) * k)[:, None] + np.arange(k)
    out_i[to], out_v[to] = bins, 1 / np.sqrt(k)
    return ptr, out_i, out_v


def _chunks(b: pa.RecordBatch, text: str, metadata: tuple[str, ...]) -> Iterator[tuple[int, int, tuple]]:
    texts = b.column(b.schema.get_field_index(text))
    meta = np.column_stack([np.zeros((len(b), 0)), *(b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in metadata)])
    for w, lines in zip(words(texts, SOLID), words(texts, _LINE), strict=True):
        yield w.first, w.rows, _features(w, lines, meta[w.first : w.first + w.rows])


def _raw(model: Model, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the factor sums of each row (no row is empty)."""
    vx = model.v[idx] * val[:, None]
    s = np.add.reduceat(vx, ptr[:-1])
    pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), ptr[:-1]))
    return model.w0 + np.add.reduceat(model.w[idx] * val, ptr[:-1]) + pairs, s


def _train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, rate: float, l2: float, batch: int, seed: int) -> Model:
    w0, w, v = model.w0, model.w.copy(), model.v.copy()
    gw, gv, g0 = np.full(len(w), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = [rows[i] for i in order[lo : lo + batch]]
            ptr = np.concatenate(([0], np.cumsum([len(x[0]) for x in part])))
            idx, val = np.concatenate([x[0] for x in part]), np.concatenate([x[1] for x in part])
            raw, s = _raw(Model(w0, w, v), ptr, idx, val)
            g = (1 / (1 + np.exp(-raw)) - np.array([x[2] for x in part])).astype(np.float32)
            each = np.repeat(g, np.diff(ptr))
            grad = each[:, None] * val[:, None] * (np.repeat(s, np.diff(ptr), axis=0) - v[idx] * val[:, None])
            u, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, each * val, len(u)).astype(np.float32) + l2 * w[u]
            dv = np.column_stack([np.bincount(inv, grad[:, f], len(u)) for f in range(v.shape[1])]).astype(np.float32) + l2 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            g0 += float(g.sum()) ** 2
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * dv / np.sqrt(gv[u])
            w0 -= rate * float(g.sum()) / np.sqrt(g0)
    return Model(w0, w, v, len(rows))


def calibrate(raw: np.ndarray, y: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Scale and shift of a logistic fit of y by raw, by Newton's method; 1 and 0 if a class is missing."""
    n1, n0 = float((y > 0.5).sum()), float((y <= 0.5).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = float(raw.std()) or 1.0
    x = np.column_stack(((raw - raw.mean()) / spread, np.ones(len(raw))))
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - goal * (x @ t)) + 1e-3 * t @ t)
    t = np.array([1.0, 0.0])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-(x @ t)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - goal) + 2e-3 * t)
        while np.abs(step).max() > 1e-9 and loss(t - step) > loss(t):
            step /= 2
        t = t - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(t[0] / spread), float(t[1] - t[0] * raw.mean() / spread)) if t[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), max_rows: int = 20_000, factors: int = 4, rounds: int = 4, epochs: int = 3, rate: float = 0.1, l2: float = 1e-4, batch: int = 64, shards: int = 8, seed: int = 7) -> Model:
    """Fits on at most ``max_rows`` labelled rows of ``labels`` (key, label) whose texts are in ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = known.select(F.col(key), F.col(label).cast("double").alias("y")).orderBy(F.xxhash64(key), "y").limit(max_rows).select(F.col(key).alias("k"), "y")
    names = tuple(f"m{i}" for i in range(len(metadata)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, n, (ptr, idx, val) in _chunks(b, "text", names):
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + n], b.column(1)[lo : lo + n], pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(idx)), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(val))], names=["h", "y", "idx", "val"])

    # at most max_rows narrow rows are broadcast
    used = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(m) for c, m in zip(metadata, names, strict=True)])
    joined = used.join(F.broadcast(chosen), "k").select(F.xxhash64("k").alias("h"), "y", "text", *names)
    rows = written(joined.mapInArrow(extract, "h long, y double, idx array<int>, val array<float>"), "quality-train")
    size, spark = Model.size(len(metadata)), docs.sparkSession
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, factors)).astype(np.float32))

    def trainer(at, r: int):
        def step(group):
            group = group.sort_by([("h", "ascending")])
            own = [(np.asarray(i.values), np.asarray(x.values), y) for i, x, y in zip(group["idx"], group["val"], group["y"].to_pylist(), strict=True)]
            m = _train(at.value, own, epochs, rate / (1 + r), l2, batch, seed + r)
            return pa.table({"n": [len(own)], "w0": [m.w0], "w": pa.array([m.w.tobytes()], pa.binary()), "v": pa.array([m.v.tobytes()], pa.binary())})

        return step

    apart = F.pmod(F.xxhash64("h"), F.lit(8)) == 0
    for r in range(rounds):
        at = spark.sparkContext.broadcast(model)
        found = rows.where(~apart).groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(trainer(at, r), "n long, w0 double, w binary, v binary").collect()
        total = sum(x["n"] for x in found)
        at.unpersist()
        if not total:
            return Model(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
        found.sort(key=lambda x: (x["n"], x["w0"]))
        mean = lambda k: sum(np.frombuffer(x[k], np.float32) * np.float32(x["n"] / total) for x in found)
        model = Model(sum(x["w0"] * x["n"] for x in found) / total, mean("w"), mean("v").reshape(size, factors), total)

    at = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            idx, val = b.column(1), b.column(2)
            ptr = np.concatenate(([0], np.cumsum(idx.value_lengths().to_numpy()))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_raw(at.value, ptr, idx.flatten().to_numpy(), val.flatten().to_numpy())[0].astype(np.float64)), b.column(0)], names=["raw", "y"])

    seen = rows.where(apart).select("y", "idx", "val").mapInArrow(measure, "raw double, y double").toArrow()  # an eighth of max_rows at most
    order = np.lexsort((seen["y"].to_numpy(), seen["raw"].to_numpy()))
    scale, shift = calibrate(seen["raw"].to_numpy()[order], seen["y"].to_numpy()[order])
    discard(rows)
    return Model(model.w0, model.w, model.v, model.n_rows + seen.num_rows, scale, shift)


def score(docs: DataFrame, model: Model, text: str = "text", metadata: tuple[str, ...] = (), to: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row."""
    at = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(len(b))
            for lo, n, csr in _chunks(b, text, metadata):
                raw = at.value.scale * _raw(at.value, *csr)[0].astype(np.float64) + at.value.shift
                out[lo : lo + n] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(out) if c == to else b.column(i) for i, c in enumerate(b.schema.names)], names=b.schema.names)

    plain = without(docs, to).withColumn(to, F.lit(None).cast("double"))
    return plain.mapInArrow(run, plain.schema)


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the keys that are never learned from; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0

"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature.

Words (as they stand, with their case) and word shapes (which sorts of characters, last character, repeat of the word before)
are hashed to buckets. Each bucket has a sparse random index vector; a bucket's vector is the sum of the index vectors of the
buckets around it, over the training texts, normalised. A document's features are the mean vectors of its words and of its
shapes, and a few of its counts. A network of one hidden layer maps them to a logit, divided by the temperature that makes
held-back labels likeliest.

Fitted on at most `most_rows` labelled documents (those with the least hash of doc_id), so every size of input fits alike;
the vectors' sums are made in tasks and added up. All documents are scored. Labels, language, source and doc_id are no inputs.

Defined results: empty and null texts get the score of zero means; without labels every score is 0.5; repeated rows are scored
each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import fold_of, slices

BUCKETS, SHAPES, WIDTH, NONZERO = 1 << 15, 1 << 10, 32, 6
#: Rows in which the sums of index vectors are added up.
PIECES = 33
_SORTS = np.zeros(256, np.uint8)
_SORTS[97:123], _SORTS[65:91], _SORTS[48:58], _SORTS[128:] = 1, 2, 4, 32
for _c in b".,;:'\"()-":
    _SORTS[_c] = 8
_SORTS[(_SORTS == 0)] = 16
_LAST = np.zeros(256, np.uint8)
for _i, _cs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b"|", b"#$%&*@"), 1):
    for _c in _cs:
        _LAST[_c] = _i


def _index(n: int, seed: int) -> np.ndarray:
    """n sparse random vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((n, WIDTH), np.float32)
    at = rng.random((n, WIDTH)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (n, NONZERO)), axis=1)
    return out


def _buckets(data: np.ndarray, offsets: np.ndarray):
    """(word bucket, shape bucket) of each word, and bounds."""
    starts, ends, bounds = wordhash.spans(data, offsets)
    h = wordhash.hashes(data, starts, ends, fold=False)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    sorts = np.bitwise_or.reduceat(np.append(np.where(_SPACE[data], np.uint8(0), _SORTS[data]), np.uint8(0)), starts)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[bounds[:-1][bounds[:-1] < len(h)]] = False
    shape = (sorts.astype(np.int64) << 4) | (_LAST[data[ends - 1]].astype(np.int64) << 1) | again
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), shape, bounds


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _contexts(batches):
    """Sums of index vectors around each bucket, words (word and shape neighbours), then shapes, as PIECES rows of bytes a task."""
    wi, si = _index(BUCKETS, 1), _index(SHAPES, 2)
    words, shapes = np.zeros((BUCKETS, WIDTH), np.float64), np.zeros((SHAPES, WIDTH), np.float64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), 1 << 20):
            w, s, bounds = _buckets(data, offsets)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            near = np.zeros((len(w), WIDTH), np.float32)
            for k in (1, 2):
                same = (doc[k:] == doc[:-k])[:, None]
                near[k:] += np.where(same, wi[w[:-k]] + si[s[:-k]], 0)
                near[:-k] += np.where(same, wi[w[k:]] + si[s[k:]], 0)
            for j in range(WIDTH):
                words[:, j] += np.bincount(w, near[:, j], BUCKETS)
                shapes[:, j] += np.bincount(s, near[:, j], SHAPES)
    sums = np.split(np.vstack([words, shapes]).astype(np.float32), PIECES)
    yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())], names=["piece", "sums"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("sums"))
    return pa.table([table.column("piece")[:1], pa.array([total.tobytes()], pa.binary())], names=["piece", "sums"])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def _pooled(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Features of each text."""
    w, s, bounds = _buckets(data, offsets)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    mean = np.zeros((len(n), WIDTH), np.float64)
    some = np.flatnonzero(n > 0)
    if len(some):
        mean[some] = np.add.reduceat(words[w], bounds[:-1][some], axis=0)
    counts = np.bincount(doc * SHAPES + s, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
    per = np.maximum(n, 1)[:, None]
    sizes = np.log1p(np.stack([n, np.diff(offsets)], axis=1))
    flags = np.stack([counts[:, (np.arange(SHAPES) & mask) > 0].sum(axis=1) for mask in (1, 2 << 4, 4 << 4, 16 << 4, 32 << 4)], axis=1) / per
    last = np.stack([counts[:, ((np.arange(SHAPES) >> 1) & 7) == k].sum(axis=1) for k in range(8)], axis=1) / per
    return np.hstack([mean / per, counts @ shapes / per, flags, last, sizes])


class Network:
    """Standardised inputs, one hidden layer of tanh units, a logit over a temperature. Trained by Adam on mini-batches."""

    def __init__(self, hidden: int = 32, epochs: int = 60, seed: int = 7):
        self.hidden, self.epochs, self.rng, self.temperature = hidden, epochs, np.random.Generator(np.random.PCG64(seed)), 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        back = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        d, rng = x.shape[1], self.rng
        p = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        rows = np.flatnonzero(~back)
        for _ in range(self.epochs):
            rng.shuffle(rows)
            for part in np.array_split(rows, max(1, len(rows) // 128)):
                a, hid = z[part], np.tanh(z[part] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-(hid @ p[2] + p[3]))) - y[part]) / len(part)
                back_hid = np.outer(g, p[2]) * (1 - hid**2)
                grads = [a.T @ back_hid + 1e-4 * p[0], back_hid.sum(axis=0), hid.T @ g + 1e-4 * p[2], g.sum(keepdims=True)]
                t += 1
                for i, q in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * q
                    v[i] = 0.999 * v[i] + 0.001 * q * q
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        if back.any():
            s = self.logit(x[back])
            loss = [np.mean(np.logaddexp(0, -(2 * y[back] - 1) * s / c)) for c in np.geomspace(0.25, 8, 60)]
            self.temperature = float(np.geomspace(0.25, 8, 60)[int(np.argmin(loss))])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return (np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _featured(words: np.ndarray, shapes: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1), 1 << 20):
                x = _pooled(data, offsets, words, shapes)
                x = x.astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(list(x), pa.list_(pa.float32())), pa.array([v.tobytes() for v in x], pa.binary())], names=["label", "x", "raw"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> dict | None:
    """The model, from at most most_rows labelled documents outside the held-out fold; None without any."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null").filter(fold_of(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id")).limit(most_rows)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("label", "text")  # known: at most most_rows rows
    partial = sample.select("text").repartition(8).mapInArrow(_contexts, "piece int, sums binary")
    added = partial.groupBy("piece").applyInArrow(_added, "piece int, sums binary").toArrow()  # 8 MB in all
    sums = np.zeros((BUCKETS + SHAPES, WIDTH))
    for piece, x in zip(added.column("piece").to_pylist(), added.column("sums")):
        sums.reshape(PIECES, -1)[piece] = np.frombuffer(x.as_buffer(), np.float64)
    words, shapes = _unit(sums[:BUCKETS]), _unit(sums[BUCKETS:])
    # rows come as bytes: as numbers in lists they would take ten times the memory in the driver
    rows = sample.mapInArrow(_featured(words, shapes), "label int, x array<float>, raw binary").orderBy(F.xxhash64("x")).limit(most_rows).select("label", "raw").toArrow()
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(v.as_py() for v in rows.column("raw")), "<f4").reshape(rows.num_rows, -1).astype(np.float64)
    y = rows.column("label").to_numpy().astype(float)
    del rows, added
    return {"words": words, "shapes": shapes, "network": Network().fit(x, y)}


def scored(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, names: tuple = ("score", "predicted")) -> DataFrame:
    """docs' columns and two more: score and predicted, or other names where docs has these."""
    at, share = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = share.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(at), 1 << 20):
                score = model["network"].score(_pooled(data, offsets, model["words"], model["shapes"])) if model else np.full(last - first, 0.5)
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scored(rows, model).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")

"""Hidden Markov language model over word classes, trained by Baum-Welch, with exact likelihoods of whole texts.

A word's class is the low bits of its hash; the end of a text is a class of its own. The model of a text is
P(classes) x product of P(word | class): the first from a hidden Markov model, the second from counts,
(c + 0.5) / (C + 0.5 (V + 1)) with C and V the tokens and distinct words of the class in training.

Counts. The order of word hashes is cut into fragments; a fragment gets each document's part of its distinct words, counts the
training tokens of each word, and sums for each document log10(c + 0.5) over its tokens. These partial sums are added per
document, so no table of words is ever joined with the documents or sent anywhere.

Training. Documents are kept as sequences of 16-bit classes. It starts from how often each class follows each other in all
training documents: these counts are at most classes x classes numbers, however many documents there are, and rounds of
expectation and maximisation over them, by blocks in the cluster, give the model under which neighbouring classes are likeliest.
Then come rounds over the whole sequences. In every one each task runs scaled forward-backward over its
training documents and returns expected counts (states x states and states x classes); these are added up in the cluster, by
parts first, and the driver only normalises one such table. The recursions run over segments side by side: each is entered
`OVERLAP` symbols early from both ends, by where the chain has forgotten how it began, and every transition within a document is
counted once. Scoring runs the scaled forward recursion over each whole text, uncut.

Defined results: null and empty texts are the end alone; repeated rows are documents each, and texts under one doc_id keep
apart; without training documents all counts are 0 and the model is uniform; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import binaries, fold_of, pack5, shuffle_parts, slices, stored, unpack5

CLASSES = 1 << 12
END = CLASSES
#: Symbols of a segment whose counts are taken, and those before and after it that only carry the recursions in.
SEGMENT, OVERLAP = 192, 32
#: Classes whose followers are counted in one row.
BLOCK = 64
#: Distinct words of documents that a fragment should have at most.
FRAGMENT = 3_000_000
_BATCH_BYTES = 2 << 20


def _texts(ids: pa.Array, text: pa.Array):
    """(rows, keys, word hashes, bounds); a key names a document by doc_id and text."""
    for first, last, data, offsets in slices(text, _BATCH_BYTES):
        w, bounds = wordhash.words(data, offsets)
        raw = data.data if data.flags.c_contiguous else data.tobytes()
        keys = [(0 if d is None else d) * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(raw[a:b]) & 0xFFFFFFFFFFFFFFFF for d, a, b in zip(ids[first:last].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]
        yield first, last, np.array(keys, np.uint64).view(np.int64), w, bounds


def _sequences(batches):
    for batch in batches:
        for first, last, keys, w, bounds in _texts(batch.column(0), batch.column(1)):
            n = np.diff(bounds)
            symbols = np.full(len(w) + len(n), END, np.uint16)
            place = np.arange(len(w)) + np.repeat(np.arange(len(n)), n)
            symbols[place] = (w & np.uint64(CLASSES - 1)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(keys), batch.column(2)[first:last], pa.array(n + 1), binaries(symbols, n + 1).cast(pa.binary())], names=["doc_id", "key", "fold", "n_tokens", "symbols"])


def _parts(fragments: int):
    """Rows (fragment, keys, counts, words, times) of arrays: the distinct words of documents by fragment."""

    def run(batches):
        for batch in batches:
            for first, last, keys, w, bounds in _texts(batch.column(0), batch.column(1)):
                if not len(w):
                    continue
                train = batch.column(2)[first:last].to_numpy(zero_copy_only=False) != 1
                doc = np.repeat(np.arange(len(keys)), np.diff(bounds))
                order = np.lexsort((w, doc))
                w, doc = w[order], doc[order]
                edge = np.flatnonzero((np.diff(w, prepend=~w[:1]) != 0) | (np.diff(doc, prepend=-1) != 0))
                times, w, doc = np.diff(edge, append=len(w)), w[edge], doc[edge]
                # more than 255 times: as many entries as it takes
                more = -(-times // 255)
                w, doc, left = np.repeat(w, more), np.repeat(doc, more), np.repeat(times - (more - 1) * 255, more)
                last_of = np.cumsum(more) - 1
                times = np.full(len(w), 255, np.int64)
                times[last_of] = left[last_of]
                part = ((w >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                key = part * len(keys) + doc
                order = np.argsort(key, kind="stable")
                key, w, times = key[order], w[order], times[order]
                edge = np.flatnonzero(np.diff(key, prepend=-1))
                count, key = np.diff(edge, append=len(w)), key[edge]
                part, doc = key // len(keys), key % len(keys)
                rows = np.flatnonzero(np.diff(part, prepend=-1))
                segments, tokens = np.diff(rows, append=len(part)), np.add.reduceat(count, rows)
                cols = [pa.array(part[rows]), binaries(keys[doc], segments), binaries(train[doc].astype(np.uint8), segments), binaries(count.astype("<u4"), segments), binaries(pack5(w, 6), tokens), binaries(times.astype(np.uint8), tokens)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.binary()) if pa.types.is_large_binary(c.type) else c for c in cols], names=["fragment", "keys", "train", "counts", "words", "times"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Of one fragment: for each document (kind 0) its sum of log10(c + 0.5) and its known tokens; for each class (kind 1) C and V."""
    join = lambda name: b"".join(x.as_py() for x in table.column(name))
    keys, train, count = np.frombuffer(join("keys"), "<i8"), np.frombuffer(join("train"), np.uint8), np.frombuffer(join("counts"), "<u4")
    low, times = unpack5(join("words"), 6), np.frombuffer(join("times"), np.uint8).astype(np.float64)
    owner = np.repeat(np.arange(len(keys)), count)
    words, at = np.unique(low, return_inverse=True)
    c = np.bincount(at, times * train[owner], len(words))
    sums = np.bincount(owner, times * np.log10(c + 0.5)[at], len(keys))
    known = np.bincount(owner, times * (c > 0)[at], len(keys))
    cls = (words & np.uint64(CLASSES - 1)).astype(np.int64)
    n, v = np.bincount(cls, c, CLASSES), np.bincount(cls, c > 0, CLASSES)
    some = np.flatnonzero(n)
    kind = np.repeat(np.array([0, 1], np.int32), [len(keys), len(some)])
    return pa.table([pa.array(kind), pa.array(np.concatenate([keys, some])), pa.array(np.concatenate([sums, n[some]])), pa.array(np.concatenate([known, v[some].astype(float)]))], names=["kind", "key", "x", "y"])




class Model:
    """start (K), move (K x K) and emit (K x classes) probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, states: int, seed: int = 11) -> Model:
        rng = np.random.Generator(np.random.PCG64(seed))
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        move = unit(rng.random((states, states)) + 4 * np.eye(states))
        return cls(np.full(states, 1 / states), move, unit(rng.random((states, CLASSES + 1)) ** 4 + 0.01))

    @classmethod
    def from_counts(cls, start, move, emit) -> Model:
        unit = lambda x: x / x.sum(axis=-1, keepdims=True)
        return cls(unit(start + 0.1), unit(move + 0.1), unit(emit + 0.01))


def expected_counts(model: Model, symbols: np.ndarray):
    """(start, move, emit) counts of a stream of documents, each closed by END; segments of it run side by side."""
    k = len(model.start)
    start_p, move, emit = model.start.astype(np.float32), model.move.astype(np.float32), model.emit.T.astype(np.float32).copy()
    n = -(-len(symbols) // SEGMENT)
    padded = np.full(OVERLAP + n * SEGMENT + OVERLAP, END, symbols.dtype)
    padded[OVERLAP : OVERLAP + len(symbols)] = symbols
    steps = SEGMENT + 2 * OVERLAP
    at = np.arange(steps)[:, None] + SEGMENT * np.arange(n)[None, :]  # time x segments
    stream, fresh = padded[at], (np.append(END, padded[:-1]) == END)[at]
    inside = np.float32(1 / k)
    alpha, out = np.empty((steps, n, k), np.float32), np.empty((SEGMENT, n, k), np.float32)
    b = emit[stream]
    for t in range(steps):
        prior = alpha[t - 1] @ move if t else np.full((n, k), inside, np.float32)
        prior[fresh[t]] = start_p
        a = prior * b[t]
        alpha[t] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
    moves = np.zeros((k, k))
    beta = np.ones((n, k), np.float32)
    for t in range(steps - 1, OVERLAP - 1, -1):
        after = b[t] * beta
        if t < OVERLAP + SEGMENT:
            gamma = alpha[t] * beta
            out[t - OVERLAP] = gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30)
            through = ~fresh[t]
            pre = alpha[t - 1][through]
            scale = np.maximum(((pre @ move) * after[through]).sum(axis=1, keepdims=True), 1e-30)
            moves += (pre.T @ (after[through] / scale)) * move
        beta = after @ move.T
        beta[fresh[t]] = 1
        beta /= np.maximum(beta.max(axis=1, keepdims=True), 1e-30)
    post, flat = out.transpose(1, 0, 2).reshape(-1, k)[: len(symbols)], symbols
    emits = np.stack([np.bincount(flat, post[:, i], CLASSES + 1) for i in range(k)])
    first = np.append(END, flat[:-1]) == END
    return post[first].sum(axis=0, dtype=np.float64), moves, emits


def _streams(column: pa.Array):
    """Whole documents one after the other, in pieces of about 1 MB."""
    at, sizes = 0, np.cumsum([len(x) for x in (b.as_buffer() for b in column)])
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 20), side="right")))
        yield np.frombuffer(b"".join(b.as_py() for b in column[at:end]), "<u2")
        at = end


def _pairs(batches):
    """Rows (block, cells, counts) of a task's documents: how often a class follows a class of the block; a first symbol follows END."""
    width = CLASSES + 1
    total = np.zeros(width * width, np.uint32)
    for batch in batches:
        for stream in _streams(batch.column(0)):
            cells, n = np.unique(np.append(END, stream[:-1]) * width + stream, return_counts=True)
            total[cells] += n.astype(np.uint32)
    for block in range(-(-width // BLOCK)):
        part = total[block * BLOCK * width : (block + 1) * BLOCK * width]
        cells = np.flatnonzero(part)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.astype("<u4").tobytes()], pa.binary()), pa.array([part[cells].astype("<u8").tobytes()], pa.binary())], names=["block", "cells", "counts"])


def _pair_sums(dense: bool):
    """Adds up rows of one block; dense: as 32-bit floats, of all its cells (then none are named) where half of them or more are in use."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        total = np.zeros(min(BLOCK, CLASSES + 1 - block * BLOCK) * (CLASSES + 1), np.uint64)
        for cells, counts in zip(table.column("cells"), table.column("counts")):
            total[np.frombuffer(cells.as_buffer(), "<u4")] += np.frombuffer(counts.as_buffer(), "<u8")
        cells = np.flatnonzero(total)
        if dense and 2 * len(cells) >= len(total):
            cols = {"cells": b"", "counts": total.astype("<f4").tobytes()}
        else:
            cols = {"cells": cells.astype("<u4").tobytes(), "counts": total[cells].astype("<f4" if dense else "<u8").tobytes()}
        return pa.table([table.column("block")[:1], *(pa.array([x], pa.binary()) for x in cols.values())], names=["block", *cols])

    return run


def _dense(block: int, cells: pa.Scalar, counts: pa.Scalar) -> np.ndarray:
    """A row of _pair_sums(True) as classes of the block x classes."""
    cells, counts = np.frombuffer(cells.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<f4")
    if len(cells):
        counts, few = np.zeros(min(BLOCK, CLASSES + 1 - block * BLOCK) * (CLASSES + 1), np.float32), counts
        counts[cells] = few
    return counts.reshape(-1, CLASSES + 1)


def expected_pairs(model: Model, held: np.ndarray, first: int, counts: np.ndarray):
    """(start, move, emit) counts of pairs of neighbours, each by itself; counts[r, x]: how often x follows class first + r.

    held: how likely each state is at a pair's first symbol. Row END holds first symbols.
    """
    counts = counts.astype(np.float32)
    emit, joint, rows = model.emit.astype(np.float32), (held[:, None] * model.move).astype(np.float32), counts[: max(0, END - first)]
    alone = model.start[:, None] * model.emit
    alone = alone / alone.sum(axis=0) * counts[len(rows) :].sum(axis=0)
    b = emit[:, first : first + len(rows)]
    weight = rows / np.maximum(b.T @ joint @ emit, 1e-30)
    after, before = weight @ emit.T, b @ weight
    emits = emit * (joint.T @ before) + alone
    emits[:, first : first + len(rows)] += b * (joint @ after.T)
    return alone.sum(axis=1), joint * (b @ after), emits


def _expect_pairs(model: Model, held: np.ndarray):
    """One row of bytes a task: its blocks' expected counts."""

    def run(batches):
        k, some = len(model.start), False
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES + 1))]
        for batch in batches:
            for block, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                some = True
                for x, y in zip(total, expected_pairs(model, held, block * BLOCK, _dense(block, cells, counts))):
                    x += y
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in total]).tobytes()], pa.binary())], names=["counts"])

    return run


def _expect(model: Model):
    """One row of bytes a task: its expected counts."""

    def run(batches):
        k = len(model.start)
        total = [np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES + 1))]
        for batch in batches:
            for stream in _streams(batch.column(0)):
                for x, y in zip(total, expected_counts(model, stream)):
                    x += y
        for i in range(k):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.concatenate([total[0][i : i + 1], total[1][i], total[2][i]]).tobytes()], pa.binary())], names=["state", "counts"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("counts"))
    return pa.table([table.column("state")[:1], pa.array([total.tobytes()], pa.binary())], names=["state", "counts"])


def start_documents(sequences: DataFrame, tokens: int, most_tokens: int) -> list[np.ndarray]:
    """Whole documents in order of their key's hash, of most_tokens symbols together at most; those that do not fit are passed over.

    For trials on few documents; training does not use it.
    """
    # about twice as many as it takes have a hash under the bar; copies under one key count together
    bar = int(-(1 << 63) + ((1 << 64) - 1) * min(1, 2 * most_tokens / max(1, tokens)))
    hashed = sequences.withColumn("hash", F.xxhash64("key")).filter(F.col("hash") <= F.lit(min(bar, (1 << 63) - 1)))
    sizes = hashed.groupBy("hash").agg(F.sum("n_tokens").alias("n")).filter(F.col("n") <= most_tokens)
    chosen, total = [], 0
    for r in sizes.orderBy("hash").limit(most_tokens).collect():  # a document has one symbol at least
        if total + r.n <= most_tokens:
            chosen.append((r.hash,))
            total += r.n
    if not chosen:
        return []
    few = hashed.join(F.broadcast(sequences.sparkSession.createDataFrame(chosen, "hash long")), "hash", "left_semi")  # at most most_tokens rows
    return [np.frombuffer(r.symbols, "<u2") for r in few.orderBy("hash").select("symbols").collect()]  # most_tokens symbols of 2 bytes


def start_model(sequences: DataFrame, states: int, rounds: int) -> Model:
    """The model that rounds over the counts of neighbours in all sequences lead to from random values."""
    rows = sequences.select("symbols").mapInArrow(_pairs, "block int, cells binary, counts binary")
    parts = rows.withColumn("part", F.pmod(F.xxhash64("cells", "counts"), F.lit(64))).groupBy("block", "part").applyInArrow(_pair_sums(False), "block int, cells binary, counts binary")
    # few blocks a file, and none of mostly zeros: a task hands all that it reads to Python at once, and files tell little of what they hold
    blocks = stored(parts.repartition(-(-(CLASSES + 1) // BLOCK), "block").groupBy("block").applyInArrow(_pair_sums(True), "block int, cells binary, counts binary"), "pairs")
    model, held = Model.initial(states), np.full(states, 1 / states)
    for _ in range(rounds):
        found = blocks.mapInArrow(_expect_pairs(model, held), "counts binary").collect()  # one row a task, of which there are not more than blocks
        if not found:
            break
        start, move, emit = np.split(sum(np.frombuffer(r.counts, np.float64) for r in found), [states, states + states * states])
        move = move.reshape(states, states)
        model = Model.from_counts(start, move, emit.reshape(states, -1))
        held = (move.sum(axis=1) + 0.1) / (move.sum() + 0.1 * states)
    return model


def train(sequences: DataFrame, states: int = 8, rounds: int = 3, start_rounds: int = 80) -> Model:
    """sequences: column symbols, of the training documents only. All of them take part in the start and in every round."""
    model = start_model(sequences, states, start_rounds)
    for _ in range(rounds):
        per_task = sequences.select("symbols").mapInArrow(_expect(model), "state int, counts binary")
        parts = per_task.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64))).groupBy("state", "part").applyInArrow(_added, "state int, counts binary")
        rows = parts.groupBy("state").applyInArrow(_added, "state int, counts binary").collect()  # one row a state
        if not rows:
            break
        counts = np.stack([np.frombuffer(r.counts, np.float64) for r in sorted(rows, key=lambda r: r.state)])
        if not counts.sum():
            break
        model = Model.from_counts(counts[:, 0], counts[:, 1 : 1 + states], counts[:, 1 + states :])
    return model


def log10_forward(model: Model, emit: np.ndarray, streams: list[np.ndarray]) -> np.ndarray:
    """log10 of the sum over state paths for each stream; emit: classes x K, in any scale."""
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    sizes = np.array([len(streams[i]) for i in order])
    flat = np.concatenate([streams[i] for i in order]) if order else np.zeros(0, np.uint16)
    first = np.cumsum(sizes) - sizes
    alpha = np.tile(model.start, (len(order), 1))
    out = np.zeros(len(order))
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    for t, n in enumerate(active.tolist()):
        a = (alpha[:n] @ model.move if t else alpha[:n]) * emit[flat[first[:n] + t]]
        scale = a.sum(axis=1)
        out[:n] += np.log10(scale)
        alpha[:n] = a / scale[:, None]
    back = np.empty(len(order))
    back[order] = out
    return back


def _scores(model: Model, per_class: np.ndarray):
    """The model's log10 probability of each text, but for the sums over its words' counts. per_class: C + 0.5 (V + 1), 1 for END."""

    def run(batches):
        emit = (model.emit / per_class).T.copy()
        for batch in batches:
            for at in range(0, batch.num_rows, 3000):
                part = batch.slice(at, 3000)
                streams = [np.frombuffer(b.as_buffer(), "<u2") for b in part.column(4)]
                score = log10_forward(model, emit, streams)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(score)], names=["doc_id", "key", "fold", "n_tokens", "classes_score"])

    return run


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; fold 1 of doc_id is held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("fold", fold_of(F.col("doc_id")).cast("long"))
    sequences = stored(rows.mapInArrow(_sequences, "doc_id long, key long, fold long, n_tokens long, symbols binary"), "sequences")
    is_train = F.col("fold") != 1
    n, ends, total = sequences.agg(F.coalesce(F.sum(F.when(is_train, F.col("n_tokens"))), F.lit(0)), F.count(F.when(is_train, 1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    fragments = max(64, shuffle_parts(spark), -(-total // FRAGMENT))
    parts = rows.mapInArrow(_parts(fragments), "fragment long, keys binary, train binary, counts binary, words binary, times binary")
    counted = parts.groupBy("fragment").applyInArrow(_counted, "kind int, key long, x double, y double")
    sums = stored(counted.groupBy("kind", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), "sums")
    classes = sums.filter("kind = 1").select("key", "x", "y").collect()  # at most CLASSES rows
    per_class = np.full(CLASSES + 1, 0.5)
    for r in classes:
        per_class[r.key] = r.x + 0.5 * (r.y + 1)
    per_class[END] = 1
    v = int(sum(r.y for r in classes)) + (ends > 0)
    model = train(sequences.filter(is_train), states, rounds)
    scored = sequences.mapInArrow(_scores(model, per_class), "doc_id long, key long, fold long, n_tokens long, classes_score double")
    # the same doc_id and text twice: the sums hold both, so they are shared out
    words = sums.filter("kind = 0").select("key", "x", F.col("y").alias("known"))
    same = sequences.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    words = words.join(same, "key").select("key", (F.col("x") / F.col("times")).alias("x"), (F.col("known") / F.col("times")).alias("known"))
    x, known = F.coalesce("x", F.lit(0.0)), F.coalesce("known", F.lit(0.0))
    return scored.join(words, "key", "left").select(
        "doc_id",
        (F.col("fold") == 1).alias("held_out"),
        "n_tokens",
        (F.round(known).cast("long") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (x + F.lit(float(np.log10(ends + 0.5))) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        (x + F.col("classes_score")).alias("score"),
    )

"""Periodic runs of words (repetitions of three periods or more) within documents, by seed and extend on diagonals.

A run with period q and length of at least max(least, times * q) has, on the diagonal of lag q, max(least - q, (times - 1) * q) places whose
words are equal to those q later: its guaranteed overlap. Lags are dealt to classes (about 10 % of n in number for short texts, growing as the
logarithm); for each class the k-grams of its smallest guaranteed overlap k are indexed by their hashes, and each
occurrence is paired with the next one of the same document. That is enough: a class holds lags up to 2k/3 only, and were a
k-gram of the run to occur again before lag q, the run would by Fine and Wilf's theorem have a smaller period than q. Larger classes
look only at places whose smaller k-grams occurred again. A pair is a seed; it is extended along its diagonal in both directions, and
a table of how far each lag's diagonal is covered keeps the other seeds of the same stretch from being extended again.
A stretch that is long enough and has no smaller period is a run.

Words are compared by 64-bit hashes; every run found is then held against the text, and a document where that fails
is searched again by its words themselves, so results are exact.

Work is by document: no shuffle, and memory is bounded by a batch of texts or the longest text. Defined results: a null, empty or
short text has no runs; repeated rows each get a row; a null identifier is kept; of equally good runs the order is by start, then period;
columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import slices

_BATCH_BYTES = 2 << 20
_SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def classes(most: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(k, smallest lag, largest lag) for lags of 1 to most: k is the least overlap of the class's runs and no lag exceeds 2k/3."""
    out, low = [], 1
    overlap = lambda q: max(least - q, (times - 1) * q)
    while low <= most:
        high, k = low, overlap(low)
        while 3 * (high + 1) <= 2 * min(k, overlap(high + 1)):
            high += 1
            k = min(k, overlap(high))
        out.append((k, low, high))
        low = high + 1
    return out


def _grams(prefix: np.ndarray, inverse: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    return wordhash.mix((prefix[at + k] - prefix[at]) * inverse[at])


def _prefix(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = wordhash._power(len(w) + 1)
    prefix = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * power[: len(w)], out=prefix[1:])
    return prefix, inverse


def _next(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, next place with the same gram) for places in ascending order."""
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    return at[order[:-1][same]], at[order[1:][same]]


def _stretch(w: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest [start, end) around i whose words equal those lag later; compares blocks of doubling size."""
    n, step, end = len(w) - lag, 64, i
    while end < n:
        m = min(step, n - end)
        differ = w[end : end + m] != w[end + lag : end + lag + m]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + m, step * 2
    start, step = i, 64
    while start > 0:
        m = min(step, start)
        differ = (w[start - m : start] != w[start - m + lag : start + lag])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = start - m, step * 2
    return start, end


def _primitive(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether [start, end), which has period q and is twice as long or longer, has no smaller one: such a one divides q."""
    rest, r = q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            d = q // r
            if np.array_equal(w[start : end - d], w[start + d : end]):
                return False
            while rest % r == 0:
                rest //= r
        r += 1
    return True


def runs(w: np.ndarray, least: int = 24, times: int = 3, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the sequence w of numbers, by start, then period. at: places worth a look, if known."""
    n, found, furthest = len(w), [], {}
    prefix, inverse = _prefix(w.astype(np.uint64))
    at = np.arange(n) if at is None else at
    for k, low, high in classes(n // times, least, times):
        at = at[at + k <= n]
        i, j = _next(_grams(prefix, inverse, at, k), at)
        if not len(i):
            break
        at = np.unique(np.concatenate([i, j]))
        lag = j - i
        fits = (lag >= low) & (lag <= high)
        i, lag = i[fits], lag[fits]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        fresh = (np.diff(lag, prepend=-1) != 0) | (np.diff(i, prepend=-2) != 1)
        for place, q in zip(i[fresh].tolist(), lag[fresh].tolist()):
            if place < furthest.get(q, 0):
                continue
            start, end = _stretch(w, place, q)
            furthest[q] = max(end, place + 1)
            if end - start + q >= max(least, times * q) and _primitive(w, start, end + q, q):
                found.append((start, end - start + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run the first period's."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _searched(rewrite: Callable | None, least: int, times: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            all_runs, texts = [], []
            for first, last, data, offsets in slices(batch.column(1), _BATCH_BYTES):
                starts, ends, bounds = wordhash.spans(data, offsets)
                if rewrite is not None:
                    index = [rewrite(ids[first + d], int(n)) for d, n in enumerate(np.diff(bounds))]
                    if any(x is not None for x in index):
                        index = np.concatenate([b + (np.arange(n) if x is None else x) for x, b, n in zip(index, bounds, np.diff(bounds))]).astype(np.int64)
                        starts, ends = starts[index], ends[index]
                text, at = wordhash.joined(data, starts, ends)
                w = wordhash.hashes(data, starts, ends, fold=False)
                hinted = _repeated(w, bounds, least, times)
                found = {}
                for d in np.unique(hinted[0]).tolist():
                    lo, hi = int(bounds[d]), int(bounds[d + 1])
                    found[d] = _exact(w[lo:hi], text, at[lo : hi + 1], hinted[1][slice(*np.searchsorted(hinted[0], (d, d + 1)))] - lo, least, times)
                stay = np.ones(len(w), bool)
                for d, rs in found.items():
                    stay[bounds[d] : bounds[d + 1]] = kept(int(bounds[d + 1] - bounds[d]), rs)
                if not stay.all():
                    text, at = wordhash.joined(text, at[:-1][stay], at[1:][stay] - 1)
                    bounds = np.append(0, np.cumsum(stay))[bounds]
                raw, cut = text.tobytes(), at[bounds].tolist()
                texts += [raw[a : max(b - 1, a)] for a, b in zip(cut[:-1], cut[1:])]
                all_runs += [[{"start": s, "length": n, "period": q} for s, n, q in found.get(d, ())] for d in range(last - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_runs, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def _repeated(w: np.ndarray, bounds: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of all k-grams of the first class that occur again in their text, for a whole batch at once."""
    k = classes(1, least, times)[0][0]
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(w))
    inside = at + k <= bounds[1:][doc]
    at, doc = at[inside], doc[inside]
    g = _grams(*_prefix(w), at, k) ^ wordhash.mix(doc.astype(np.uint64))
    i, j = _next(g, at)
    places = np.unique(np.concatenate([i, j]))
    return np.searchsorted(bounds, places, side="right") - 1, places


def _exact(w: np.ndarray, text: np.ndarray, at: np.ndarray, places: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    found = runs(w, least, times, places)
    if all(np.array_equal(text[at[s] : at[s + n - q]], text[at[s + q] : at[s + n]]) for s, n, q in found):
        return found
    number: dict[bytes, int] = {}
    exact = np.array([number.setdefault(text[a:b].tobytes(), len(number)) for a, b in zip(at[:-1], at[1:])], np.int64)
    return runs(exact, least, times)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable | None = None, least: int = 24, times: int = 3) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period, in words), collapsed (words joined by a space, of each run its first period).

    rewrite(doc_id, n) may return the place of the word to take for each of n words, or None to leave the text alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_searched(rewrite, least, times), _SCHEMA)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of op12: in a tenth of all documents, by the crc32 of the identifier, the text from a place on repeats itself."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digests(found: DataFrame) -> DataFrame:
    """The columns of op12: number of runs, the run of greatest exponent, digests of all runs and of the collapsed text."""
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> case when a is null or r.length * a.period > a.length * r.period then r else a end)"
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.withColumn("best", F.expr(best))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

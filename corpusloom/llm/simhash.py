"""Near-duplicate detection by 64-bit SimHash fingerprints and multi-index hashing, exact for a distance of 2.

A text's fingerprint has bit i set if over half the XXH64 values (UTF-8, seed 42) of its 3-word shingles, repeats included, have
it. Equal fingerprints are one entry from there on, so a third of all rows being copies of one text costs one entry.

Multi-index hashing with two segments of 32 bits: of two fingerprints that differ in 2 bits or fewer, either the first segments
differ in 1 bit or none, or the second segments are equal. So there is a table of the fingerprints by each segment; every
fingerprint enumerates the 33 values within 1 bit of its first segment (and its second segment itself), fetches what the table
has there, and whole distances are verified. A bucket of more than BUCKET entries (fingerprints of many near copies share a segment)
is not compared entry by entry: it is opened by the other segment, in which each entry stands under the values within 1 bit of its own.
Entries that meet under one value of both segments are all within 2 bits of each other (1 bit from that value), and any two
of the bucket that link meet so; there are at most 65 of them, of which each is linked with the least. Links become components.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a text of 1 or 2 words has its
whole sequence as its one shingle; repeated rows each get a row; a null doc_id gets a row and is never a component_id unless its
component has no other; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import slices, stored
from corpusloom.llm.components import connected_components

#: Entries of a bucket that are compared one by one.
BUCKET = 64
_BATCH_BYTES = 2 << 20
_SHINGLES = 1 << 16
_LOW = 0xFFFFFFFF


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text of a batch."""
    starts, ends, bounds = wordhash.spans(data, offsets)
    text, at = wordhash.joined(wordhash.LOWER[data], starts, ends)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    i = np.arange(len(starts))
    last = bounds[1:][doc] - 1
    first = (i + size - 1 <= last) | ((counts[doc] < size) & (i == bounds[:-1][doc]))
    i, doc = i[first], doc[first]
    last = np.minimum(i + size - 1, last[first])
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(at[i].tolist(), (at[last + 1] - 1).tolist())), np.uint64, len(i))
    ones, total = np.zeros((len(counts), 64), np.int64), np.bincount(doc, minlength=len(counts))
    for k in range(0, len(h), _SHINGLES):
        bits = np.unpackbits(h[k : k + _SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[k : k + _SHINGLES]
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprinted(size: int):
    def run(batches):
        for batch in batches:
            parts = [fingerprints(data, offsets, size) for _, _, data, offsets in slices(batch.column(1), _BATCH_BYTES)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def _ball(x: str, first: int) -> Column:
    """x and what differs from it in one of 32 bits from bit first on."""
    return F.expr(f"concat(array({x}), transform(sequence({first}, {first + 31}), i -> {x} ^ shiftleft(1L, i)))")


def links(entries: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (column fp, long) at a distance of 1 or 2: enough of them to connect all that link."""
    segments = {0: F.expr("shiftrightunsigned(x, 32)"), 1: F.expr(f"x & {_LOW}L")}
    x = entries.select(F.col("fp").alias("x"))
    edges, keys = [], []
    for k, segment in segments.items():
        rows = x.withColumn("s", segment)
        hot = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("s")
        # a hot bucket stands in the table as one mark instead of its entries
        held = rows.join(hot, "s", "left_anti").select("s", F.col("x").alias("y")).unionByName(hot.select("s", F.lit(None).cast("long").alias("y")))
        probes = x.select("x", F.explode(_ball("shiftrightunsigned(x, 32)", 0)).alias("s")) if k == 0 else rows
        # a merge join at every size: Spark takes the 33 probes of an entry for one row, and would broadcast them all
        met = probes.join(held.hint("merge"), "s")
        edges.append(met.filter("y is not null and x != y and bit_count(x ^ y) <= 2").select(F.col("x").alias("a"), F.col("y").alias("b")))
        own = rows.join(hot, "s", "left_semi")
        if k == 0:
            keys.append(met.filter("y is null").select(F.expr(f"shiftleft(s, 32) | (x & {_LOW}L)").alias("z"), "x"))
            keys.append(own.select(F.explode(_ball("x", 0)).alias("z"), "x"))
        else:
            keys.append(own.select(F.explode(_ball("x", 32)).alias("z"), "x"))
    opened = keys[0].unionByName(keys[1]).unionByName(keys[2]).groupBy("z").agg(F.collect_set("x").alias("xs")).filter("size(xs) > 1")
    star = opened.select(F.array_min("xs").alias("a"), F.explode("xs").alias("b")).filter("a != b and bit_count(a ^ b) <= 2")
    return edges[0].unionByName(edges[1]).unionByName(star)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id (the least doc_id reachable by links, itself included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    documents = stored(rows.mapInArrow(_fingerprinted(size), "doc_id long, fp long"), "fingerprints")
    entries = stored(documents.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    labels = connected_components(links(entries, bucket)).select(F.col("node").alias("fp"), "label")
    entries = entries.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    across = entries.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = entries.join(across, "label").select("fp", "component_id")
    return documents.join(ids, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))

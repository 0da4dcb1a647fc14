"""Similarity join of documents by Jaccard similarity of their word-shingle sets, exact, by vertical partitioning.

Documents with equal sets form one class (a class is the unit from here on). The order of all shingles, by their hashes, is cut
into fragments. In a first pass each fragment gets the part of every class's set that falls into it and counts, for itself,
which shingles two classes or more have; summed per class, these partial overlaps show that most classes share less than the
threshold of their shingles with all others together, and these leave. For the rest, the shared shingles with their document
frequencies come back from the fragments; in order of frequency they give the prefix within which linked classes must meet.

Pairs are not formed for all members of a posting list. First each member is paired with one leader of its list, the class
with the fewest shingles of its own and so the likeliest partner; the links so found join classes to components. Then only members that aren't in their list's main component are paired, with members of
other components, so that no link between two components is missed and a group of like documents costs as many pairs as
members; a pair is formed at the first shingle of both prefixes only, and only if parities of the two sets do not already show
too many differences. Pairs are decided by their overlap: the shared shingles of a class are kept by PARTS vertical parts, each a range of fragments; a pair
goes to each part that both have, its partial overlap is counted there, and the partial overlaps are summed per pair.

A shingle is a fragment number and 40 more bits of a 64-bit hash. Two unequal shingles of a pair of documents of 1,000 words count
as one with a probability under 1e-7.

Defined results: a document with 1 to 4 words has its whole word sequence as its only shingle; null, empty and blank texts have
none, link with nothing and are their own component; repeated rows are documents of the same class; columns other than the
two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import binaries, pack5, shuffle_parts, slices, stored, unpack5
from corpusloom.llm.components import connected_components

#: Shingles a fragment should have at most.
FRAGMENT = 3_000_000
_BATCH_BYTES = 4 << 20
#: Vertical parts in which the overlaps of pairs are counted.
PARTS = 8
#: Words of 64 bits of a set's parities: bit i tells whether the number of its shingles with hash i is odd.
PARITY = 8


def _sets(text: pa.Array, size: int):
    """(row, sorted distinct shingle hashes) of each text, and the class of the set as a signed 64-bit number."""
    for first, last, data, offsets in slices(text, _BATCH_BYTES):
        w, bounds = wordhash.words(data, offsets)
        h, at = wordhash.shingles(w, bounds, size)
        for i in range(last - first):
            x = np.unique(h[at[i] : at[i + 1]])
            yield first + i, x, xxhash.xxh3_64_intdigest(x.data) - (1 << 63)


def _classes(size: int):
    def run(batches):
        for batch in batches:
            rows = [(len(x), c) for _, x, c in _sets(batch.column(1), size)]
            n, cls = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "n", "cls"])

    return run


def _fragments(size: int, fragments: int):
    """Rows (fragment, cls, n, counts, shingles) of arrays: parts of sets, those of one fragment together."""

    def flush(held):
        cls = np.array([c for c, _ in held], np.int64)
        n = np.array([len(x) for _, x in held], np.int64)
        h = np.concatenate([x for _, x in held])
        owner = np.repeat(np.arange(len(held)), n)
        part = ((h >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part * len(held) + owner, kind="stable")
        key, h = (part * len(held) + owner)[order], h[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        count, key = np.diff(edge, append=len(h)), key[edge]
        part, owner = key // len(held), key % len(held)
        rows = np.flatnonzero(np.diff(part, prepend=-1))
        segments = np.diff(rows, append=len(part))
        tokens = np.add.reduceat(count, rows)
        names = ["fragment", "cls", "n", "counts", "shingles"]
        arrays = [pa.array(part[rows], pa.int64()), binaries(cls[owner], segments), binaries(n[owner].astype("<u4"), segments), binaries(count.astype("<u4"), segments), binaries(pack5(h), tokens)]
        return pa.RecordBatch.from_arrays([a.cast(pa.binary()) if a.type == pa.large_binary() else a for a in arrays], names=names)

    def run(batches):
        seen, held, total = set(), [], 0
        for batch in batches:
            for _, x, c in _sets(batch.column(0), size):
                if len(x) and c not in seen:
                    seen.add(c)
                    held.append((c, x))
                    total += len(x)
                    if total >= 4 << 20:
                        yield flush(held)
                        held, total = [], 0
            if len(seen) > 1_000_000:  # only spares repeats within a partition
                seen.clear()
        if held:
            yield flush(held)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment, each class's shingles that other classes have too, with their frequencies."""
    cols = {k: table.column(k) for k in table.schema.names}
    join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in cols[name]), kind)
    cls, n, count = join("cls", "<i8"), join("n", "<u4").astype(np.int64), join("counts", "<u4").astype(np.int64)
    h = unpack5(b"".join(x.as_py() for x in cols["shingles"]))
    _, first = np.unique(cls, return_index=True)
    once = np.zeros(len(cls), bool)
    once[first] = True
    owner = np.repeat(np.arange(len(cls)), count)
    mine = once[owner]
    h, owner = h[mine], owner[mine]
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    edge = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    df = np.diff(edge, append=len(h))
    df = np.repeat(df, df)
    several = df > 1
    h, owner, df = h[several], owner[several], df[several]
    order = np.argsort(owner, kind="stable")
    h, owner, df = h[order], owner[order], np.minimum(df[order], 65535)
    edge = np.flatnonzero(np.diff(owner, prepend=-1))
    many, who = np.diff(edge, append=len(owner)), owner[edge]
    fragment = cols["fragment"][0].as_py() if table.num_rows else 0
    arrays = [pa.array(cls[who]), pa.array(n[who]), pa.array(np.full(len(who), fragment, np.int64)), pa.array(many, pa.int64()), binaries(pack5(h), many).cast(pa.binary()), binaries(df.astype("<u2"), many).cast(pa.binary())]
    return pa.table(arrays, names=["cls", "n", "fragment", "many", "shingles", "df"])


_SHARED = "cls long, n long, fragment long, many long, shingles binary, df binary"


def _prefixes(percent: int, fragments: int):
    """Of each class: its shared shingles in order of fragments, and those that any linked class must share one of."""

    def run(batches):
        for batch in batches:
            cls, n, parts = batch.column(0), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            sets, prefixes, parities = [], [], []
            ends = np.arange(1, PARTS, dtype=np.uint64) * np.uint64(-(-fragments // PARTS)) << np.uint64(40)
            for size, part in zip(n, parts):
                part.sort(key=lambda p: p["fragment"])
                h = np.concatenate([unpack5(p["shingles"]) for p in part])
                fragment = np.repeat(np.array([p["fragment"] for p in part], np.uint64), [len(p["df"]) // 2 for p in part])
                df = np.frombuffer(b"".join(p["df"] for p in part), "<u2")
                full = (fragment << np.uint64(40)) | h
                need = -(-percent * size // 100)
                order = np.lexsort((full, df))[: len(full) - need + 1]
                sets.append([x.tobytes() for x in np.split(np.sort(full), np.searchsorted(np.sort(full), ends))])
                prefixes.append(full[order].view(np.int64))
                odd = np.bincount((wordhash.mix(full) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([cls, batch.column(1), batch.column(2), pa.array(sets, pa.list_(pa.binary())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))], names=["cls", "n", "many", "shingles", "prefix", "parity"])

    return run


def _partial(batches):
    """The overlap of a pair within one vertical part."""
    for batch in batches:
        both = []
        for s, t in zip(batch.column(2), batch.column(3)):
            u, v = np.frombuffer(s.as_buffer(), "<u8"), np.frombuffer(t.as_buffer(), "<u8")
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            both.append(int((v[at] == u).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64())], names=["a", "b", "both"])


def _links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose classes reach the threshold, from the sums of their partial overlaps."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    right = parts.select(F.col("cls").alias("b"), "part", F.col("shingles").alias("sb"))
    left = parts.select(F.col("cls").alias("a"), "part", F.col("shingles").alias("sa"))
    full = pairs.select("a", "b", part).join(right, ["b", "part"]).join(left, ["a", "part"]).select("a", "b", "sa", "sb")
    total = full.mapInArrow(_partial, "a long, b long, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))
    return total.join(pairs, ["a", "b"]).filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def class_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, cls), (labels: cls, label) of the classes that have links with others."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    documents = stored(rows.mapInArrow(_classes(size), "doc_id long, n long, cls long"), "classes")
    total = documents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(64, shuffle_parts(spark), -(-total // FRAGMENT))
    dealt = rows.select("text").mapInArrow(_fragments(size, fragments), "fragment long, cls binary, n binary, counts binary, shingles binary")
    shared = dealt.groupBy("fragment").applyInArrow(_shared, _SHARED)
    whole = shared.groupBy("cls", "n").agg(F.sum("many").alias("many"), F.collect_list(F.struct("fragment", "shingles", "df")).alias("parts"))
    whole = whole.filter(F.expr(f"100 * many >= {percent} * n")).select("cls", "n", "many", "parts")
    classes = stored(whole.mapInArrow(_prefixes(percent, fragments), "cls long, n long, many long, shingles array<binary>, prefix array<long>, parity array<long>"), "shared")
    parts = classes.select("cls", F.posexplode("shingles").alias("part", "shingles")).filter("length(shingles) > 0")
    before = F.expr("concat(array(cast(null as bigint)), slice(prefix, 1, size(prefix) - 1))").alias("before")
    posts = classes.select(F.explode(F.arrays_zip("prefix", before)).alias("p"), "cls", "n", "many").select(F.col("p.prefix").alias("shingle"), F.col("p.before").alias("before"), "cls", "n", "many")
    # an overlap is at most the lesser number of shared shingles
    near = f"100 * least(many, also) >= {percent} * (n + m - least(many, also))"

    leaders = posts.groupBy("shingle").agg(F.min(F.struct((F.col("n") - F.col("many")).alias("own"), "n", "cls", "many")).alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    stars = posts.join(leaders, "shingle").select(F.col("l.cls").alias("a"), F.col("cls").alias("b"), "n", "many", F.col("l.n").alias("m"), F.col("l.many").alias("also"))
    stars = stars.filter("a != b").filter(near).select("a", "b", F.col("m").alias("na"), F.col("n").alias("nb")).distinct()
    first = stored(_links(stars, parts, percent), "links")
    labels = connected_components(first)

    comp = labels.select(F.col("node").alias("cls"), "label")
    posts = posts.join(comp, "cls", "left").select("shingle", "before", "cls", "n", "many", F.coalesce("label", "cls").alias("label"))
    sizes = posts.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("k"))
    mains = sizes.groupBy("shingle").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("shingle", "main")
    parities = classes.select("cls", *[F.get("parity", F.lit(i)).alias(f"x{i}") for i in range(PARITY)])
    posts = stored(posts.join(mains, "shingle").join(parities, "cls"), "postings")
    # a pair that shares the shingle before too, in the common order of prefixes, is formed there
    probes = posts.filter("label != main").select("shingle", F.col("before").alias("prior"), F.col("cls").alias("a"), F.col("n").alias("m"), F.col("many").alias("also"), F.col("label").alias("la"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(PARITY)])
    # sets differ by their own shingles and by at least as many shared ones as parities
    differ = f"n - many + m - also + {' + '.join(f'bit_count(x{i} ^ y{i})' for i in range(PARITY))}"
    alike = f"{100 + percent} * ({differ}) <= {100 - percent} * (n + m)"
    cross = probes.join(posts, "shingle").filter("la != label").filter("label = main or a < cls").filter(near).filter("before is null or prior is null or before != prior").filter(alike)
    cross = cross.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b"), F.when(F.col("a") < F.col("cls"), F.col("m")).otherwise(F.col("n")).alias("na"), F.when(F.col("a") < F.col("cls"), F.col("n")).otherwise(F.col("m")).alias("nb")).distinct()
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _links(cross, parts, percent)
    labels = connected_components(known.unionByName(second))
    return documents, labels.select(F.col("node").alias("cls"), "label")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), class_id."""
    documents, labels = class_components(docs, id_col, text_col, size, percent)
    least = documents.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(labels, "cls", "left").select("cls", "least", "label")
    linked = least.filter("label is not null").groupBy("label").agg(F.min("least").alias("across"))
    ids = least.join(linked, "label", "left").select("cls", F.coalesce("across", "least").alias("component_id"))
    out = documents.filter("n > 0").join(ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"))
    none = documents.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(none)

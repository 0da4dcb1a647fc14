"""Byte-level BPE encoding and decoding: ranked merges folded over byte arrays by Spark's higher-order functions.

Texts are read in blocks of whole documents. Splitting a block's texts by the pattern gives the block's distinct words and, for
each text, the numbers of its words in order. The words go by hash to a slot, where each distinct word of the whole corpus is
folded once, in the JVM: its pieces start as single bytes (two hex digits each), and each step joins the adjacent pair of the
least rank, with the ranks in a literal map (cut into small maps by a hash, as a map is searched from its start). A word's ids
then go back to the blocks that have it, once a block; there decoding puts together the binary pieces of the ids, and texts take
their words' ids and bytes by number.

In words of over 64 bytes a step joins all places of the leftmost pair of the least rank at once where no other pair has that
rank: as a piece is made of pieces of lesser ranks, a new pair never comes before the places that are still to be joined. So a
long run of one letter takes few steps. A word that is a piece itself takes its rank at once.

Defined results: null and empty texts have no ids; repeated rows are encoded each; a document of any length is one entry of a
block; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import wordhash
from corpusloom.llm.common import shuffle_parts, stored_in_buckets
from corpusloom.llm.tokens import public_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A block holds about so many characters, a partition of slots the words of about so many.
BLOCK_CHARS = 16 << 20
SLOT_CHARS = 32 << 20
_GROUPS = 1 << 14
_PLACES = 1 << 31
#: Up to so many hex digits a step joins one place, beyond that all places of its pair; ids are the same.
_SHORT = 128
_LAST = 1 << 23


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_maps(ranks: dict[bytes, int]) -> Column:
    """A literal array of maps: entry i has the ranks of the pieces (hex digits) whose crc32 is i modulo _GROUPS."""
    groups: list[dict] = [{} for _ in range(_GROUPS)]
    for piece, rank in ranks.items():
        digits = piece.hex().upper()
        groups[zlib.crc32(digits.encode()) % _GROUPS][digits] = rank
    return F.from_json(F.lit(json.dumps(groups)), "array<map<string,bigint>>")


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def encoded(word: Column, maps: Column) -> Column:
    """Ids of a word: a fold over its bytes. The map is bound once, so that a task holds it once."""
    return _let(maps, lambda m: _let(F.hex(F.encode(word, "UTF-8")), lambda digits: _folded(digits, m)))


def _folded(digits: Column, maps: Column) -> Column:
    def rank(digits: Column) -> Column:
        return F.try_element_at(F.get(maps, (F.crc32(digits.cast("binary")) % _GROUPS).cast("int")), digits)

    def state(p: Column) -> Column:
        """The pieces, rank * _PLACES + place of each pair (null where it is no piece), and the least of these."""
        pairs = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(p[i - 1], p[i])) * _PLACES + i)
        return _let(F.when(F.size(p) > 1, pairs), lambda r: F.struct(p.alias("pieces"), r.alias("pairs"), F.array_min(r).alias("best")))

    def one(s: Column, i: Column) -> Column:
        p = s["pieces"]
        return F.concat(F.slice(p, 1, i - 1), F.array(F.concat(p[i - 1], p[i])), F.slice(p, i + 2, F.size(p)))

    def every(s: Column, i: Column) -> Column:
        """All places of the pair at once, left to right, if the rank has no other pair."""
        p, of = s["pieces"], lambda x: F.floor(x / _PLACES)
        others = F.exists(s["pairs"], lambda x: (of(x) == of(s["best"])) & (p[(x % _PLACES).cast("int") - 1] != p[i - 1]))
        text = F.concat(F.lit(";"), F.array_join(p, ",;"), F.lit(","))
        pair, whole = F.concat(F.lit(";"), p[i - 1], F.lit(",;"), p[i], F.lit(",")), F.concat(F.lit(";"), p[i - 1], p[i], F.lit(","))
        return F.when(others, one(s, i)).otherwise(F.regexp_extract_all(F.replace(text, pair, whole), F.lit("[0-9A-F]+"), F.lit(0)))

    def fold(join) -> Column:
        def step(s: Column, _: Column) -> Column:
            return F.when(s["best"].isNull(), s).otherwise(_let((s["best"] % _PLACES).cast("int"), lambda i: _let(join(s, i), state)))

        single = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))
        steps = F.sequence(F.lit(1), F.greatest(F.length(digits) / 2 - 1, F.lit(1)).cast("int"))
        return F.transform(F.aggregate(steps, _let(single, state), step, lambda s: s["pieces"]), rank)

    return _let(rank(digits), lambda r: F.when(r.isNotNull(), F.array(r)).when(F.length(digits) <= _SHORT, fold(one)).otherwise(fold(every)))


#: White space other than single blanks and newlines inside a run; texts with it are split as a whole, and empty ones.
_ODD = "\\A\\z|[\\x1c-\\x1f\\t\\r\\v\\f]|  | \\n|\\n |\\A[ \\n]|[ \\n]\\z|[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _pieces(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs of counts items that begin at starts."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


def word_numbers(texts: pa.Array, pattern: regex.Pattern) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in order, number of words of each text).

    Where blanks stand alone, words never cross them: the runs between blanks are made distinct first, and each is split once,
    with the blank before it; a text's first run has none and is split by itself.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, _ODD)
    plain, whole = texts.filter(pc.invert(odd)), texts.filter(odd)
    lists = pc.split_pattern(plain, " ")
    runs = lists.flatten().dictionary_encode()
    inner = pattern.findall("".join([" " + r for r in runs.dictionary.to_pylist()]))
    alone = [pattern.findall(t.split(" ", 1)[0]) for t in plain.to_pylist()] + [pattern.findall(t) for t in whole.to_pylist()]
    coded = pa.array(inner + [w for words in alone for w in words], pa.string()).dictionary_encode()
    # every run gives words from the one that begins with a blank to the next such; those of `alone` come after
    starts = np.append(np.flatnonzero([w[0] == " " for w in inner]), len(inner)).astype(np.int64)
    ends = len(inner) + np.cumsum([0, *map(len, alone)], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    item = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, count = starts[item], np.diff(starts)[item]
    n_plain = len(plain)
    first[bounds[:-1]], count[bounds[:-1]] = ends[:n_plain], np.diff(ends)[:n_plain]
    # all items in order of texts: the runs of plain texts, one item for each whole text
    is_odd = odd.to_numpy(zero_copy_only=False)
    text_of = np.concatenate([np.repeat(np.flatnonzero(~is_odd), np.diff(bounds)), np.flatnonzero(is_odd)])
    order = np.argsort(text_of, kind="stable")
    first, count = np.concatenate([first, ends[n_plain:-1]])[order], np.concatenate([count, np.diff(ends)[n_plain:]])[order]
    sizes = np.bincount(text_of[order], count, len(texts)).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[_pieces(first, count)], sizes


#: Words travel as one text a slot, each ended by a newline; their own returns and newlines are written in two characters.
_BLOCKS = "block long, doc_ids array<bigint>, sizes array<int>, numbers binary, parts array<struct<slot: int, words: string>>"


def _split(pattern: str, slots: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext

        compiled, block = regex.compile(pattern), TaskContext.get().partitionId() << 32
        docs, held, size = [], [], 0

        def flush():
            words, numbers, sizes = word_numbers(pa.concat_arrays(held), compiled)
            escaped = pc.replace_substring(pc.replace_substring(words, "\r", "\r1"), "\n", "\r2")
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
            data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
            slot = (wordhash.hashes(data, offsets[:-1], offsets[1:], fold=False) >> np.uint64(20)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))  # words are numbered by slot
            edge = np.flatnonzero(np.diff(slot[order].astype(np.int64), prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)).astype(np.int32)), escaped.take(pa.array(order)))
            parts = pa.StructArray.from_arrays([pa.array(slot[order][edge].astype(np.int32)), pc.binary_join(lists, "\n")], ["slot", "words"])
            planes = np.ascontiguousarray(place[numbers].astype("<u4").view(np.uint8).reshape(-1, 4).T)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([block], pa.int64()), one(pa.concat_arrays(docs)), one(pa.array(sizes.astype(np.int32))), pa.array([zstandard.ZstdCompressor(1).compress(planes)], pa.binary()), one(parts)]
            return pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "sizes", "numbers", "parts"])

        for batch in batches:
            for a, b in runs_of(batch.column(1), block_chars // 16):
                docs.append(batch.column(0)[a:b])
                held.append(batch.column(1)[a:b])
                size += pc.sum(pc.binary_length(held[-1])).as_py() or 0
                if size >= block_chars:
                    yield flush()
                    docs, held, size, block = [], [], 0, block + 1
        if docs:
            yield flush()

    return run


def runs_of(texts: pa.Array, most: int):
    """(first, last) of runs of texts with about `most` bytes each."""
    total, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, side="right")))
        yield first, last
        first = last


def _grouped(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Consecutive values put together up to each of ends, as binary."""
    if not len(values):
        return pa.array([b""] * len(ends), pa.binary())
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1][np.append(0, ends)]
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.ascontiguousarray(offsets)), values.buffers()[2]])


def _assembled(ranks: dict[bytes, int]):
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece

    def run(batches):
        table, decimals = pa.array(pieces, pa.binary()), pa.array([b"%d," % i for i in range(len(pieces))], pa.binary())
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            for r in range(batch.num_rows):
                docs, sizes = cols["doc_ids"][r].values, cols["sizes"][r].values.to_numpy().astype(np.int64)
                given = {p["slot"].as_py(): p for p in cols["given"][r]} if cols["given"][r].is_valid else {}
                parts = [given[k] for k in sorted(given)]  # words are numbered by slot
                at = [p["at"].values.to_numpy().astype(np.int64) for p in parts]
                base = np.cumsum([0, *map(len, at)])
                place = np.concatenate([x + y for x, y in zip(at, base)]) if at else np.zeros(0, np.int64)
                digits = np.frombuffer(b"".join(p["ids"].as_py() for p in parts), np.uint8).reshape(-1, 3).astype(np.int64)
                flat = digits @ np.array([1 << 16, 1 << 8, 1])
                last = np.flatnonzero(flat & _LAST)  # the last id of each word
                ids = pa.array(flat & (_LAST - 1))
                counts = np.diff(last, prepend=-1)
                back = np.empty(len(place), np.int64)
                back[place] = np.arange(len(place))
                counts, order = counts[back], pa.array(back)
                raws, texts = (_grouped(t.take(ids), last + 1).take(order) for t in (table, decimals))
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cols["numbers"][r].as_py()), np.uint8).reshape(4, -1)
                numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
                bounds, n, id_hashes, text_hashes = np.append(0, np.cumsum(sizes)), [], [], []
                for a, b in token_runs(bounds, 1 << 20):
                    mine = numbers[bounds[a] : bounds[b]]
                    marks = bounds[a : b + 1] - bounds[a]
                    n.append(np.diff(np.append(0, np.cumsum(counts[mine]))[marks]))
                    id_hashes += _hashes(texts.take(pa.array(mine)), marks, 1)
                    text_hashes += _hashes(raws.take(pa.array(mine)), marks, 0)
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.concatenate(n)), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_runs(bounds: np.ndarray, most: int):
    """(first, last) of runs of documents with about `most` words each."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield first, last
        first = last


def _hashes(values: pa.Array, marks: np.ndarray, tail: int) -> list[str]:
    """sha256 of the values between marks put together, without the last `tail` bytes."""
    data = memoryview(values.buffers()[2] or b"")
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1] if len(values) else np.zeros(1, np.int32)
    at = offsets[marks].tolist()
    return [hashlib.sha256(data[a : max(a, b - tail)]).hexdigest() for a, b in zip(at, at[1:])]


def three_bytes(ids: Column) -> Column:
    """Hex digits of ids, three bytes each; the last one is marked."""
    return F.array_join(F.transform(ids, lambda x, i: F.lpad(F.hex(x + F.when(i == F.size(ids) - 1, _LAST).otherwise(0)), 6, "0")), "")


def encoded_words(parts: DataFrame, ranks: dict[bytes, int], partitions: int) -> DataFrame:
    """Rows (block, slot, at, ids) for rows (block, slot, words); every distinct word is folded once."""
    maps = rank_maps(ranks)
    parts = parts.repartition(partitions, "slot")  # all that follows keeps to the slots
    places = parts.select("slot", "block", F.posexplode(F.split("words", "\n")).alias("at", "word"))
    text = F.replace(F.replace("word", F.lit("\r2"), F.lit("\n")), F.lit("\r1"), F.lit("\r"))
    order = Window.partitionBy("word", "slot").orderBy("block")
    first = places.withColumn("ids", F.when(F.lag("block").over(order).isNull(), _let(encoded(text, maps), three_bytes)))
    every = first.withColumn("ids", F.last("ids", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lists = every.groupBy("slot", "block").agg(F.collect_list(F.struct("at", "ids")).alias("x"))
    return lists.select("block", "slot", F.transform("x", lambda e: e["at"]).alias("at"), F.unhex(F.array_join(F.transform("x", lambda e: e["ids"]), "")).alias("ids"))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to)."""
    spark, ranks = docs.sparkSession, load_ranks(path or public_path(VOCABULARY))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    partitions = min(20_000, max(64, shuffle_parts(spark), -(-chars // SLOT_CHARS)))
    slots = 8 * partitions  # several slots a partition, so that partitions are even
    blocks = stored_in_buckets(rows.mapInArrow(_split(pattern or public_pattern(), slots, block_chars), _BLOCKS), "bpe-blocks", min(100_000, max(shuffle_parts(spark), chars // (4 * block_chars))), "block")
    parts = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.slot", "p.words")
    given = encoded_words(parts, ranks, partitions).groupBy("block").agg(F.collect_list(F.struct("slot", "at", "ids")).alias("given"))
    full = blocks.select("block", "doc_ids", "sizes", "numbers").join(given, "block", "left")
    return full.drop("block").mapInArrow(_assembled(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

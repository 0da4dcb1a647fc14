"""Phrase collocation mining: counts of frequent phrases by broadcast double-array tries over whole texts, and their scores.

Everything is per language. A word is counted with its language: its symbol is a 64-bit hash of both, checked to be
unambiguous among all words of the corpus that matter (else another hash function is taken).

1. Words are counted by block of text and summed. Words below the least count leave: no phrase with one of them can reach it.
2. Candidates of two words: each block of text deals its distinct pairs of neighbours, as 40-bit words with counts up to 255, to
   fragments by a hash of the pair. A fragment keeps the pairs whose counts reach the least count; joined with the frequent words, these are the
   candidates. 40-bit words may stand for several words: that adds candidates and loses none (Apriori-safe).
3. Candidates are cut into slices of bounded size by a hash, an executor builds a double-array trie of each slice, and up to TRIES of them at
   a time are broadcast. Every task turns its texts into arrays of word hashes; a bit table tells at which positions a phrase may begin, the phrase's
   hash names its trie, and numpy advances the states of all these positions together, level by level. Accepting states are counted
   by bincount; the counts of all tasks are summed, by lots of tasks and then over the lots.
4. Candidates of three words: positions where both pairs are frequent, found by the tries of step 3, dealt and counted as in 2 and 3.

The tries are bounded (SLICE phrases each), not their number: texts are read once for each TRIES slices. Scores are exact integers (decimals of 38
digits). Defined results: null and empty texts have no words; a null language counts as `und`; repeated rows count again; phrases
with equal score and count are ordered by their UTF-8 bytes; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import wordhash
from corpusloom.llm.common import binaries, discard, shuffle_parts, slices, stored, unpack5
from corpusloom.llm.double_array import Trie

#: Phrases of one trie, and tries that are broadcast together: about 15 MB each.
SLICE = 200_000
TRIES = 6
#: Items of a fragment, words of a block.
FRAGMENT = 2_000_000
BLOCK = 1_500_000
_BATCH_BYTES = 2 << 20
#: Bits of the table of positions at which a phrase may begin.
_SIEVE = 24
_LOW40 = (1 << 40) - 1
_PUNCTUATION = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(_PUNCTUATION)] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True


def _blocks(batches, seed: int, texts: bool = False):
    """(languages, lang of each word, hash of each word, piece of each word, texts) of about BLOCK words; texts: the words' spans, if asked."""
    values, held, count = wordhash.byte_values(seed), [], 0
    for batch in batches:
        lang = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
        names = lang.dictionary.to_pylist()
        salt = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in names], np.uint64)
        code = lang.indices.to_numpy(zero_copy_only=False)
        for first, last, data, offsets in slices(batch.column(1), _BATCH_BYTES):
            starts, ends, bounds = wordhash.spans(data, offsets, _SEPARATOR)
            counts = np.diff(bounds)
            of = np.repeat(code[first:last], counts)
            h = wordhash.mix(wordhash.hashes(data, starts, ends, values=values) ^ salt[of]) if len(of) else np.zeros(0, np.uint64)
            breaks = np.cumsum(_BREAK[data])
            piece = breaks[starts] + np.repeat(np.arange(len(counts)), counts) if len(of) else np.zeros(0, np.int64)
            yield_text = (wordhash.LOWER[data], starts, ends) if texts else None
            if texts:
                yield names, of, h, piece, yield_text
                continue
            held.append((h, piece + (held[-1][1][-1] + 1 if held and len(held[-1][1]) else 0)))
            count += len(h)
            if count >= BLOCK:
                yield None, None, *(np.concatenate(x) for x in zip(*held)), None
                held, count = [], 0
    if held:
        yield None, None, *(np.concatenate(x) for x in zip(*held)), None


def _words(seed: int):
    """(lang, h, word, n) of the distinct words of each part of a block."""

    def run(batches):
        for names, of, h, _, (data, starts, ends) in _blocks(batches, seed, texts=True):
            kinds, first, n = np.unique(h, return_index=True, return_counts=True)
            text, at = wordhash.joined(data, starts[first], ends[first])
            raw, cut = text.tobytes(), at.tolist()
            word = pa.array([raw[a : b - 1] for a, b in zip(cut[:-1], cut[1:])], pa.binary()).cast(pa.string())
            lang = pa.DictionaryArray.from_arrays(pa.array(of[first].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(kinds.view(np.int64)), word, pa.array(n)], names=["lang", "h", "word", "n"])

    return run


def _spots(h: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
    """Places where `size` words of one piece begin."""
    n = len(h) - size + 1
    return np.flatnonzero(piece[:n] == piece[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """As _phrase_hash_column: the words' hashes, which are random already, are rotated and joined by exclusive or."""
    out = columns[0]
    for k, c in enumerate(columns[1:], 1):
        out = out ^ _rotated(c, 21 * k)
    return out


def _phrase_hash_column(columns: list[str]) -> Column:
    turned = [columns[0]] + [f"(shiftleft({c}, {21 * k}) | shiftrightunsigned({c}, {64 - 21 * k}))" for k, c in enumerate(columns[1:], 1)]
    return F.expr(" ^ ".join(turned))


def _dealt(columns: list[np.ndarray], fragments: int):
    """A batch of rows (fragment, phrases, seen) of the distinct phrases of a block, their words cut to 40 bits."""
    columns = [c & np.uint64(_LOW40) for c in columns]
    key = columns[0]
    for c in columns[1:]:
        key = wordhash.mix(key + c * np.uint64(0x9E3779B97F4A7C15))
    kinds, first, n = np.unique(key, return_index=True, return_counts=True)
    part = ((kinds >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)  # ascending, as kinds are
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    sizes = np.diff(edge, append=len(part))
    packed = np.concatenate([c[first].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5] for c in columns], axis=1)
    arrays = [pa.array(part[edge]), binaries(packed, sizes).cast(pa.binary()), binaries(np.minimum(n, 255).astype(np.uint8), sizes).cast(pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["fragment", "phrases", "seen"])


_DEALT = "fragment long, phrases binary, seen binary"


def _frequent(size: int, least: int):
    """Of one fragment, the phrases (words of 40 bits) whose counts reach the least one."""

    def run(table: pa.Table) -> pa.Table:
        words = unpack5(b"".join(x.as_py() for x in table.column("phrases"))).reshape(-1, size)
        seen = np.frombuffer(b"".join(x.as_py() for x in table.column("seen")), np.uint8)
        key = words[:, 0]
        for k in range(1, size):
            key = wordhash.mix(key + words[:, k] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=~key[order][:1])) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(seen[order].astype(np.int64), edge) if len(edge) else edge
        enough = order[np.repeat(total >= least, np.diff(edge, append=len(order)))]
        words = np.unique(words[enough], axis=0).view(np.int64)
        return pa.table([pa.array(words[:, k]) for k in range(size)], names=[f"p{k}" for k in range(size)])

    return run


def _tries(size: int):
    """Of one slice, its trie."""

    def run(table: pa.Table) -> pa.Table:
        phrases = np.stack([table.column(f"h{k}").to_numpy() for k in range(size)], axis=1).view(np.uint64)
        phrases = phrases[np.lexsort(phrases.T[::-1])]
        sieve = np.unique(_phrase_hash(list(phrases.T)) & np.uint64((1 << _SIEVE) - 1)).astype("<u4")
        trie = Trie.build(phrases)
        return pa.table([table.column("slice")[:1], pa.array([phrases.astype("<u8").tobytes()], pa.binary()), pa.array([trie.dump()], pa.binary()), pa.array([sieve.tobytes()], pa.binary())], names=["slice", "phrases", "trie", "sieve"])

    return run


class _Loaded:
    """The tries of a pass in a task."""

    def __init__(self, size: int, parts: int, tries: list[tuple[int, bytes, bytes]]):
        self.size, self.parts = size, parts
        self.tries = {k: Trie.load(raw) for k, raw, _ in tries}
        self.whole = len(tries) == parts
        self.sieve = np.zeros(1 << _SIEVE, bool)
        for _, _, raw in tries:
            self.sieve[np.frombuffer(raw, "<u4")] = True

    def matches(self, h: np.ndarray, spots: np.ndarray):
        """(slice, places among spots, numbers of the phrases there)."""
        key = _phrase_hash([h[spots + k] for k in range(self.size)])
        may = np.flatnonzero(self.sieve[key & np.uint64((1 << _SIEVE) - 1)])
        part = key[may].view(np.int64) % self.parts
        for k, trie in self.tries.items():
            mine = may[part == k]
            number = trie.match(np.stack([h[spots[mine] + i] for i in range(self.size)], axis=1)) if len(mine) else np.zeros(0, np.int64)
            yield k, mine[number >= 0], number[number >= 0]

    def elsewhere(self, h: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Places among spots whose phrase belongs to a trie of another pass."""
        key = _phrase_hash([h[spots + k] for k in range(self.size)])
        return np.flatnonzero(~np.isin(key.view(np.int64) % self.parts, list(self.tries)))


def _counted(size: int, parts: int, sent, seed: int):
    """Packed counts, as _packed has them: how often the task's texts hold each phrase of the tries."""

    def run(batches):
        loaded = _Loaded(size, parts, sent.value)
        total = {k: np.zeros(0, np.int64) for k in loaded.tries}
        for _, _, h, piece, _ in _blocks(batches, seed):
            for k, _, number in loaded.matches(h, _spots(h, piece, size)):
                n = np.bincount(number, minlength=len(total[k]))
                n[: len(total[k])] += total[k]
                total[k] = n
        for k, n in total.items():
            yield _packed(k, n)

    return run


#: Phrases whose counts travel in one row, and rows that are added in one group before the sums are.
_ROW = 4096
_LOT = 256
_PACKED = "slice long, part long, numbers binary, counts binary"


def _packed(k: int, n: np.ndarray, part: int = 0) -> pa.RecordBatch:
    """Rows (slice, part, numbers in the part, counts) of the counts n of a trie's phrases from `part` on, without those that are 0."""
    some = np.flatnonzero(n)
    edge = np.flatnonzero(np.diff(some // _ROW, prepend=-1))
    sizes = np.diff(edge, append=len(some))
    arrays = [pa.array(np.full(len(edge), k)), pa.array(part + some[edge] // _ROW), binaries((some % _ROW).astype("<u2"), sizes).cast(pa.binary()), binaries(n[some].astype("<i8"), sizes).cast(pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["slice", "part", "numbers", "counts"])


def _added(table: pa.Table) -> np.ndarray:
    numbers, counts = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), kind) for c, kind in (("numbers", "<u2"), ("counts", "<i8")))
    out = np.zeros(_ROW, np.int64)
    np.add.at(out, numbers, counts)
    return out


def _summed(found: DataFrame, least: int) -> DataFrame:
    """(slice, number, a) of packed counts: the rows of a part are added by lots of tasks, then the lots' sums."""

    def lot(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(table.column("slice")[0].as_py(), _added(table), table.column("part")[0].as_py())])

    def whole(table: pa.Table) -> pa.Table:
        n = _added(table)
        some = np.flatnonzero(n >= least)
        return pa.table([pa.array(np.full(len(some), table.column("slice")[0].as_py())), pa.array(table.column("part")[0].as_py() * _ROW + some), pa.array(n[some])], names=["slice", "number", "a"])

    lots = found.withColumn("lot", F.floor(F.spark_partition_id() / _LOT)).groupBy("slice", "part", "lot").applyInArrow(lot, _PACKED)
    return lots.groupBy("slice", "part").applyInArrow(whole, "slice long, number long, a long")


def _longer(size: int, parts: int, sent, seed: int, fragments: int):
    """Dealt phrases of size + 1 words whose first and last `size` words are phrases of the tries, as far as these are at hand."""

    def run(batches):
        loaded = _Loaded(size, parts, sent.value)
        for _, _, h, piece, _ in _blocks(batches, seed):
            spots = _spots(h, piece, size)
            first = np.zeros(len(h) + 1, bool)
            for _, at, _ in loaded.matches(h, spots):
                first[spots[at]] = True
            last = first.copy()
            if not loaded.whole:  # the pass that holds the last words' trie would know; this one keeps the phrase
                last[spots[loaded.elsewhere(h, spots)]] = True
            at = _spots(h, piece, size + 1)
            at = at[first[at] & last[at + 1]]
            if len(at):
                yield _dealt([h[at + k] for k in range(size + 1)], fragments)

    return run


def _passes(spark: SparkSession, sliced: DataFrame, parts: int):
    """The tries of each pass, as broadcasts."""
    for low in range(0, parts, TRIES):
        rows = [(r["slice"], bytes(r["trie"]), bytes(r["sieve"])) for k in range(low, min(low + TRIES, parts)) for r in sliced.filter(F.col("slice") == k).select("slice", "trie", "sieve").collect()]
        if rows:
            sent = spark.sparkContext.broadcast(rows)
            rows = None
            yield sent


def _count(texts: DataFrame, candidates: DataFrame, size: int, seed: int, least: int, longer_fragments: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(phrases h0.. with their count a, at least the least one; dealt phrases of one word more, if asked)."""
    spark = texts.sparkSession
    names = [f"h{k}" for k in range(size)]
    total = candidates.count()
    parts = max(1, -(-total // SLICE))
    cut = candidates.withColumn("slice", F.pmod(_phrase_hash_column(names), F.lit(parts).cast("long")))
    schema = "slice long, phrases binary, trie binary, sieve binary"
    sliced = stored(cut.select("slice", *names).groupBy("slice").applyInArrow(_tries(size), schema), f"tries-{size}")
    counts, dealt = None, None
    for sent in _passes(spark, sliced, parts):
        found = stored(_summed(texts.mapInArrow(_counted(size, parts, sent, seed), _PACKED), least), f"counts-{size}")
        counts = found if counts is None else counts.unionByName(found)
        if longer_fragments:
            more = stored(texts.mapInArrow(_longer(size, parts, sent, seed, longer_fragments), _DEALT).groupBy("fragment").applyInArrow(_frequent(size + 1, least), ", ".join(f"p{k} long" for k in range(size + 1))), "longer")
            dealt = more if dealt is None else dealt.unionByName(more)
        sent.unpersist()
    if counts is None:
        counts = spark.createDataFrame([], "slice long, number long, a long")
        dealt = spark.createDataFrame([], ", ".join(f"p{k} long" for k in range(size + 1)))
    spelled = sliced.select("slice", "phrases").mapInArrow(_spelled(size), "slice long, number long, " + ", ".join(f"{n} long" for n in names))
    return stored(counts.join(spelled, ["slice", "number"]).select(*names, "a"), f"phrases-{size}"), dealt


def _spelled(size: int):
    """(slice, number, words) of the phrases of the tries."""

    def run(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), k)), pa.array(np.arange(len(words))), *[pa.array(words[:, i]) for i in range(size)]], names=["slice", "number", *[f"h{i}" for i in range(size)]])

    return run


def _candidates(frequent: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """The phrases of frequent words of one language that the 40-bit words may stand for."""
    for k in range(size):
        side = words.select((F.col("h").bitwiseAND(F.lit(_LOW40))).alias(f"p{k}"), F.col("h").alias(f"h{k}"), F.col("lang").alias(f"lang{k}"))
        frequent = frequent.join(side, f"p{k}")
        if k:
            frequent = frequent.filter(F.col("lang0") == F.col(f"lang{k}"))
    return frequent.select(*[f"h{k}" for k in range(size)]).distinct()


def counted_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words: lang, h, word, f; pairs: h0, h1, a; triples: h0, h1, h2, a; languages: lang, total) of those that occur at least `least` times."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    for seed in range(64):
        found = texts.mapInArrow(_words(seed), "lang string, h long, word string, n long").groupBy("lang", "h", "word").agg(F.sum("n").alias("f"))
        every = stored(found, "words")
        twice = every.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("f").alias("f")).filter(f"k > 1 and f >= {least}")
        if twice.isEmpty():
            break
        discard(every)
    else:
        raise ValueError("no hash function tells all words apart")
    languages = every.groupBy("lang").agg(F.sum("f").alias("total"))
    total = every.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    words = stored(every.filter(F.col("f") >= least), "frequent-words")
    fragments = max(64, shuffle_parts(docs.sparkSession), -(-total // FRAGMENT))

    def pairs(batches):
        for _, _, h, piece, _ in _blocks(batches, seed):
            at = _spots(h, piece, 2)
            if len(at):
                yield _dealt([h[at], h[at + 1]], fragments)

    frequent = texts.mapInArrow(pairs, _DEALT).groupBy("fragment").applyInArrow(_frequent(2, least), "p0 long, p1 long")
    two = stored(_candidates(frequent, words, 2), "candidates-2")
    doubles, dealt = _count(texts, two, 2, seed, least, fragments)
    three = stored(_candidates(dealt.distinct(), words, 3), "candidates-3")
    triples, _ = _count(texts, three, 3, seed, least)
    return words, doubles, triples, languages


def _score(a: str, left: str, right: str) -> str:
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    return f"cast(1000000 as decimal(19, 0)) * {wide(a)} * {wide(a)} div ({wide(left)} * {wide(right)})"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two or three words that occurs at least `least` times scores floor(10^6 a^2 / (l r)) by its worst cut. It leaves if a
    longer one that holds it occurs at least percent % as often.
    """
    words, pairs, triples, languages = counted_phrases(docs, lang_col, text_col, least)
    word = lambda k: words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 0 else []))
    inside = triples.select("h0", "h1", "a").unionByName(triples.select(F.col("h1").alias("h0"), F.col("h2").alias("h1"), "a")).groupBy("h0", "h1").agg(F.max("a").alias("longer"))
    alone = pairs.join(inside, ["h0", "h1"], "left").filter(f"longer is null or 100 * longer < {percent} * a")
    two = alone.join(word(0), "h0").join(word(1), "h1").select("lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), "a", F.col("f0").alias("l"), F.col("f1").alias("r"), F.expr(_score("a", "f0", "f1")).alias("score"))
    first = pairs.select("h0", "h1", F.col("a").alias("a01"))
    last = pairs.select(F.col("h0").alias("h1"), F.col("h1").alias("h2"), F.col("a").alias("a12"))
    three = triples.join(first, ["h0", "h1"]).join(last, ["h1", "h2"]).join(word(0), "h0").join(word(1).drop("f1"), "h1").join(word(2), "h2")
    cut = lambda k, left, right: F.struct(F.expr(_score("a", left, right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.withColumn("cut", F.least(cut(1, "f0", "a12"), cut(2, "a01", "f2")))
    three = three.select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(languages, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


_PIECES = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest({_PIECES}), '[^\x20\x09]+') AS ws FROM documents),
one AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM pieces) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
two AS (SELECT lang, w1, w2, count(*) AS a FROM (SELECT lang, unnest(ws[:-2]) AS w1, unnest(ws[2:]) AS w2 FROM pieces WHERE len(ws) >= 2) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM (SELECT lang, unnest(ws[:-3]) AS w1, unnest(ws[2:-2]) AS w2, unnest(ws[3:]) AS w3 FROM pieces WHERE len(ws) >= 3) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(a) AS most FROM (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, w1 || ' ' || w2 AS phrase, a, x.f AS l, y.f AS r, 1 AS k FROM two
  JOIN one x ON x.lang = two.lang AND x.w = w1 JOIN one y ON y.lang = two.lang AND y.w = w2
  WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = two.lang AND g.w1 = two.w1 AND g.w2 = two.w2 AND 100 * g.most >= 50 * two.a)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.f, y.a, 1 FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.a, y.f, 2 FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w = t.w3),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""

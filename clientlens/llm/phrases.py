"""Phrase collocation mining by dynamic itemset counting.

1. Every whole text is cut once into words and pieces; a chunk of words becomes a row (its distinct
   words, their hashes and the number of each place's word) in one of ``SHARDS`` shards of a
   table in the shared folder.
2. The shards are scanned in a cycle.  A step counts, in one shard, the phrases of all lengths that
   are active, so lengths are interleaved: words are active from the start, and a longer phrase
   becomes active at the step after both of its subphrases (without the last, without the first
   word) have reached the threshold by the counts so far.  From then on it is counted for exactly
   one full cycle, so every shard once.  The scan ends when nothing is open any more.
3. A pair of words is active only once the bucket it hashes to (of ``BUCKETS`` saturating counters of
   all pairs, summed over tasks) has reached the threshold, too, which rules out nearly all pairs
   that are too rare while a bucket holds few of them.
4. Counts so far are a table of phrases: partial counts of a step are combined per task, summed with
   it, and phrases that completed their cycle leave it, counted or dropped.  Phrases that reached the
   threshold go to the workers as a table of fixed size (a byte for each of ``SLOTS`` slots of
   hashes: the step from which it counts as reached), whatever their number.  Two phrases in one
   slot or bucket only make a phrase active too early or for nothing: its first active step is a
   function of slots and buckets, the same for all its places, so it is counted for one full cycle
   still.

A phrase at or above the threshold has subphrases at or above it, which reach it within their own
cycle, so no phrase is missed; its prefixes and suffixes, which the cuts need, are counted too.
Scores are exact (decimals of 38 digits).  Joins of phrases with the counts of their parts are
salted, as one word may be a part of very many.

Defined results: null text is empty, null lang is `und`; every row counts, whatever its id; ties are
ranked by count, then by the phrase's UTF-8 bytes; texts without words add nothing; a language
without a phrase at the threshold has no rows; an empty table gives an empty result."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import arrow_rows, documents, drop_shared, shared_path, shared_table
from clientlens.functions.runs import LOWER, numbered, runs, text_slices
from clientlens.llm.shingles import mix

#: Fixed values of the contract.
MIN_COUNT = 100
LONGEST = 5
TOP = 2000

SHARDS = 2        # steps of a cycle
SLOTS = 1 << 24   # bytes of a table of reached phrases (16 MB, whatever their number)
BUCKETS = 1 << 23  # counters of pairs (a byte each, whatever the number of pairs)
CHUNK = 1 << 19   # bytes of text a chunk, or one longer text
TOKENS = 1 << 17  # words counted at once in a worker: its arrays stay at some tens of MB
TEXT_ROWS, CHUNK_ROWS = 1000, 8  # rows of an Arrow batch: texts, chunks
SALTS = 16
NEVER = 255

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~(_BLANK | _BREAK)

CHUNK_SCHEMA = "lang string, words array<string>, hashes binary, ids binary, n long, shard int"
COUNT_SCHEMA = "lang string, phrase string, hash long, k int, since int, n long"
SLICE = 1 << 16  # counters sent together
SENT = 1 << 13   # phrases sent together: what the JVM holds of a batch outside its heap stays small


def _lean(run):
    """``run``, giving the memory its arrays took back to the system when the task ends: workers wait for
    their next task, and what they keep counts against the executor all that time."""
    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
    return lean


# ------------------------------------------------------------ words and shards


def _chunks(shards: int, chunk: int):
    def run(batches):
        at = TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column(0)
            names = pc.unique(langs)
            code = pc.index_in(langs, names).to_numpy()
            for a, b, data, starts in text_slices(batch.column(1), chunk):
                data = LOWER[data]
                first, end = runs(_WORD[data], starts[:-1])
                if not len(first):
                    continue
                ids, words = numbered(data, first, end)
                hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), np.uint64).reshape(-1, 2)
                doc = np.searchsorted(starts, first, "right") - 1
                breaks = np.cumsum(_BREAK[data])
                # a place between two words of different pieces or texts is marked by -1
                cut = np.concatenate([[False], (doc[1:] != doc[:-1]) | (breaks[first[1:]] != breaks[first[:-1]])])
                for c in np.unique(code[a:b][doc]):
                    own = code[a:b][doc] == c
                    # words of other languages between two places also end a piece
                    jump = cut | np.concatenate([[False], ~own[:-1]])
                    i, gap = ids[own].astype(np.int32), jump[own]
                    out = np.full(len(i) + int(gap.sum()), -1, np.int32)
                    out[np.arange(len(i)) + np.cumsum(gap)] = i
                    used, local = np.unique(out[out >= 0], return_inverse=True)
                    out[out >= 0] = local
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[int(c)].as_py()], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), words.take(pa.array(used))),
                         pa.array([hashes[used].tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary()), pa.array([len(i)], pa.int64()), pa.array([at % shards], pa.int32())],
                        names=["lang", "words", "hashes", "ids", "n", "shard"])
                    at += 1
    return _lean(run)


def sharded(docs: DataFrame, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The words of all texts as a table of chunks, partitioned by shard."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    path = shared_path(spark, "phrases-shards")
    with arrow_rows(spark, TEXT_ROWS):
        rows.mapInArrow(_chunks(shards, chunk), CHUNK_SCHEMA).write.partitionBy("shard").parquet(path)
    out = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    out._shared_path = path
    return out


# -------------------------------------------------------------------- a step


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def lang_key(lang: str) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(lang), np.uint64)


def grams(words: np.ndarray, lang: str, longest: int, admit=None):
    """Per length k: the places in a stretch of word hashes (rows of two, 0 between pieces) at which a phrase
    of k words starts, its hashes, and the step from which it is active.  ``admit`` (k, hashes,
    since) -> (which of them have longer ones, since when); by default all, from the start."""
    at = np.flatnonzero(words[:, 0])
    hashes, since = mix(words[at] ^ lang_key(lang)), np.zeros(len(at), np.int64)
    for k in range(1, longest + 1):
        if k == 2 and admit:  # the pair's own bucket
            ok, since = admit(0, hashes, since)
            at, hashes, since = at[ok], hashes[ok], since[ok]
        yield k, at, hashes, since
        if admit:
            ok, since = admit(k, hashes, since)
            at, hashes, since = at[ok], hashes[ok], since[ok]
        pair = np.flatnonzero(at[1:] == at[:-1] + 1)  # the parts without the last and the first word
        at, since = at[pair], np.maximum(since[pair], since[pair + 1])
        hashes = mix(hashes[pair] + words[at + k])  # the second part ends there


def _admit(reached: np.ndarray, buckets: np.ndarray, step: int):
    """Which phrases' longer ones are active at ``step``, by the tables of reached slots and buckets."""
    def admit(k, hashes, since):
        table = reached if k else buckets
        own = table[slot_of(hashes[:, 0] if k else hashes[:, 1], len(table))].astype(np.int64)
        ok = own <= step
        return ok, np.maximum(since, np.where(ok, own, 0))
    return admit


def _chunk_words(hashes, ids) -> np.ndarray:
    """The word hashes at the places of a chunk: rows of two, (0, 0) between pieces."""
    table = np.frombuffer(hashes.as_buffer(), np.uint64).reshape(-1, 2)
    table = np.concatenate([np.maximum(table, np.uint64(1)), np.zeros((1, 2), np.uint64)])
    return table[np.frombuffer(ids.as_buffer(), np.int32)]


def _stretches(batches, spelled: bool = False):
    """Chunks of one language joined to about TOKENS places: (lang, word hashes, and with ``spelled`` the
    number of each place's word and the words)."""
    wait: dict[str, list] = {}
    size: dict[str, int] = {}

    def joined(lang):
        parts = wait.pop(lang)
        size.pop(lang)
        hashes = np.concatenate([x for p in parts for x in (np.zeros((1, 2), np.uint64), p[0])])
        if not spelled:
            return lang, hashes, None, None
        base = np.cumsum([0] + [len(p[2]) for p in parts[:-1]])
        numbers = np.concatenate([x for p, b in zip(parts, base) for x in (np.full(1, -1, np.int64), p[1] + b)])
        return lang, hashes, numbers, pa.concat_arrays([p[2] for p in parts])

    for batch in batches:
        words = batch.column("words") if spelled else [None] * batch.num_rows
        for lang, hashes, ids, w in zip(batch.column("lang").to_pylist(), batch.column("hashes"), batch.column("ids"), words):
            own = _chunk_words(hashes, ids)
            wait.setdefault(lang, []).append((own, np.frombuffer(ids.as_buffer(), np.int32).astype(np.int64) if spelled else None, w.values if spelled else None))
            size[lang] = size.get(lang, 0) + len(own)
            if size[lang] >= TOKENS:
                yield joined(lang)
    for lang in list(wait):
        yield joined(lang)


def _step(shared, step: int, cycle: int, longest: int):
    def run(batches):
        reached, buckets = (np.frombuffer(x, np.uint8) for x in shared.value)
        for lang, words, numbers, names in _stretches(batches, True):
            for k, at, hashes, since in grams(words, lang, longest, _admit(reached, buckets, step)):
                open_ = np.flatnonzero(since + cycle > step)
                if not len(open_):
                    continue
                # equal phrases next to each other
                order = open_[np.lexsort((hashes[open_, 1], hashes[open_, 0]))]
                own = hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
                first, n = order[new], np.diff(np.append(new, len(order)))
                phrase = names.take(pa.array(numbers[at[first]]))
                for i in range(1, k):
                    phrase = pc.binary_join_element_wise(phrase, names.take(pa.array(numbers[at[first] + i])), " ")
                out = pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), phrase, pa.array(hashes[first, 0].view(np.int64)),
                     pa.array(np.full(len(n), k, np.int32)), pa.array(since[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "phrase", "hash", "k", "since", "n"])
                for i in range(0, len(n), SENT):
                    yield out.slice(i, SENT)
    return _lean(run)


def _pairs_of(buckets: int):
    """Arrow batches of chunks -> (slice, counters): the task's pairs by bucket, saturating at NEVER."""
    def run(batches):
        total = np.zeros(buckets, np.uint8)
        for lang, words, _, _ in _stretches(batches):
            for k, _, hashes, _ in grams(words, lang, 2):
                if k == 2 and len(hashes):
                    own, n = np.unique(slot_of(hashes[:, 1], buckets), return_counts=True)
                    total[own] = np.minimum(total[own].astype(np.int64) + n, NEVER)
        size = min(SLICE, buckets)
        for i in range(0, buckets, size):
            if total[i : i + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([total[i : i + size].tobytes()], pa.binary())], names=["slice", "counters"])
    return _lean(run)


def _summed(batches):
    """(slice, counters) sorted by slice -> one row per slice, saturating; one slice is held."""
    at, total = None, None
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64)
            if i != at:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "counters"])
                at, total = i, own
            else:
                total = np.minimum(total + own, NEVER)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "counters"])


def _pair_buckets(part: DataFrame, buckets: int) -> np.ndarray:
    """Saturating counts of a shard's pairs by bucket; the driver gets a byte a bucket."""
    schema = "slice int, counters binary"
    rows = part.mapInArrow(_pairs_of(buckets), schema).repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed, schema)
    out, size = np.zeros(buckets, np.int64), min(SLICE, buckets)
    for r in rows.toLocalIterator():
        out[r["slice"] * size : (r["slice"] + 1) * size] += np.frombuffer(bytes(r["counters"]), np.uint8)
    return out


def _slots(hashes: DataFrame, slots: int) -> np.ndarray:
    """Slots of a table's hashes: a bitmap in slices of 4 KB, at most slots / 32768 rows whatever the
    number of phrases."""
    slot = F.col("hash").bitwiseAND(F.lit(slots - 1)) + 1
    rows = hashes.select(F.bitmap_bucket_number(slot).alias("slice"), F.bitmap_bit_position(slot).alias("bit"))
    bits = np.zeros(max(slots // 8, 4096), np.uint8)
    for r in rows.groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        a = (r["slice"] - 1) * 4096
        bits[a : a + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return np.flatnonzero(np.unpackbits(bits, bitorder="little"))


def phrase_counts(chunks: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS,
                  buckets: int = BUCKETS) -> DataFrame:
    """(lang, phrase, k, n): every phrase of up to ``longest`` words with at least ``min_count``
    occurrences."""
    if not 0 < min_count <= NEVER:
        raise ValueError(f"min_count must be 1 to {NEVER}")
    spark = chunks.sparkSession
    with arrow_rows(spark, CHUNK_ROWS):
        reached, pairs, seen = np.full(slots, NEVER, np.uint8), np.full(buckets, NEVER, np.uint8), np.zeros(buckets, np.int64)
        high, so_far, step, last = [], None, 0, 0
        while step < max(shards, last + shards):
            if step >= NEVER - 1:
                raise RuntimeError("too many steps")
            table = spark.sparkContext.broadcast((reached.tobytes(), pairs.tobytes()))
            shard = chunks.where(F.col("shard") == step % shards)
            rows = shard.select("lang", "words", "hashes", "ids").mapInArrow(_step(table, step, shards, longest), COUNT_SCHEMA)
            rows = rows if so_far is None else rows.unionByName(so_far)
            counts = rows.groupBy("lang", "phrase").agg(F.max("hash").alias("hash"), F.max("k").alias("k"), F.max("since").alias("since"), F.sum("n").alias("n"))
            # what has seen every shard and stayed below the threshold is done with
            complete = F.col("since") + shards <= step + 1
            counts = shared_table(counts.where((F.col("n") >= min_count) | ~complete).withColumn("complete", complete), f"phrases-counts-{step}")
            if step < shards:
                seen = np.minimum(seen + _pair_buckets(shard.select("lang", "hashes", "ids"), buckets), NEVER)
            step += 1
            if step <= shards:
                pairs[(seen >= min_count) & (pairs == NEVER)] = step
            new = _slots(counts.where((F.col("n") >= min_count) & (F.col("k") < longest)), slots)
            new = new[reached[new] == NEVER]
            reached[new] = step
            # a pair waits for its bucket, too: those of the last step of the first cycle open a cycle
            last = step if len(new) or step <= shards else last
            high.append(shared_table(counts.where("complete").select("lang", "phrase", "k", "n"), f"phrases-high-{step}"))
            old, so_far = so_far, counts.where("NOT complete").drop("complete")
            so_far._shared_path = counts._shared_path
            if old is not None:
                drop_shared(old)
            table.unpersist()
        found = high[0]
        for h in high[1:]:
            found = found.unionByName(h)
        out = shared_table(found.where(F.col("n") >= min_count), "phrases-counts")
        drop_shared(so_far, *high)
        return out


# -------------------------------------------------------------------- scores


def _salted(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``."""
    own = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(own, ["lang", part, "salt"]).drop("salt")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    wide = lambda c, p: c.cast(f"decimal({p},0)")
    return F.call_function("div", wide(a * 1000, 19) * wide(n, 18), wide(left, 19) * wide(right, 18)).cast("long")


def collocations(total: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score; ``total`` has
    each language's number of words."""
    found = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    found = found.withColumn("w", F.split("phrase", " "))
    span = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    # phrases inside a longer one: spans of 2 to k-1 words, with the longer one's count
    inner = found.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    inner = inner.select("lang", span(F.col("first"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    # a longer phrase occurs at most as often as its part, so 100 * longer >= 100 * a is equality
    open_ = found.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = open_.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", span(F.lit(1), F.col("cut")).alias("left"), span(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    rows = _salted(_salted(cuts, counts, "left", "l"), counts, "right", "r").join(total.withColumnRenamed("total", "n"), "lang")
    rows = rows.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    low = F.min(F.struct("score", "cut", "l", "r")).alias("low")
    rows = rows.groupBy("lang", "phrase", "a", "n").agg(low)
    rows = rows.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, slots: int = SLOTS,
         buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    chunks = sharded(docs, shards, lang_col, text_col, chunk)
    total = shared_table(chunks.groupBy("lang").agg(F.sum("n").alias("total")), "phrases-total")
    counts = phrase_counts(chunks, min_count, longest, shards, slots, buckets)
    drop_shared(chunks)
    return collocations(total, counts, top)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
             string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, f AS a FROM g WHERE k >= 2 AND f >= 100),
x AS (SELECT lang, a, ws, k, s, unnest(generate_series(1, k - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS s FROM c WHERE k > 2)),
inner_ AS (SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM x GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
u AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM o),
v AS (SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS lp, array_to_string(ws[cut + 1 : k], ' ') AS rp FROM u),
s AS (SELECT v.lang, v.phrase, v.a, v.cut, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * v.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM v JOIN g l ON l.lang = v.lang AND l.phrase = v.lp JOIN g r ON r.lang = v.lang AND r.phrase = v.rp JOIN n ON n.lang = v.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000
"""

"""Source divergence audit by a frequent-pattern tree of term rows.

1. Every whole text gives its terms; counts per (lang, source, term) are combined per task and
   then summed.  A language keeps the terms that occur in at least ``MIN_DOCS`` of its documents.
2. A kept term is one row: its nonzero counts in the order of the language's sources.  Equal rows
   merge into one with a multiplicity, and rows are range-sorted, so the rows that share a
   prefix, which is a path of the tree, lie next to each other.
3. The tree is walked in that order.  A node is a shared prefix; its multiplicity is the number of
   terms below it.  For every node and every ancestor of it, the correction of that pair of
   sources is computed once and weighted with the multiplicity, however many terms share the
   path.  A partition holds no tree, only the rows of an Arrow batch; a node that a batch or
   a partition cuts is two nodes, whose weights add up to the same sums.

With c the counts of a term in two sources and z the value of a count of zero, the sum over all V
terms of f(p, q) is taken apart as

    V f(zp, zq)  +  sum over terms in p of f(p, zq) - f(zp, zq)  +  the same for q
                 +  sum over terms in both of f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)

The first three parts come from one histogram of counts a source; only the last needs the tree.
All arithmetic is exact: f is at most 10^18, and a sum of f over a language's terms is at most
(10^9 + V)^2, as the values of p add up to at most 10^9 + V; sums run in decimals.

Defined results: null text, lang and source are ''; every row is a document, whatever its id, so
repeated rows count again; a group without terms has no `term` rows but takes part in
`pair`; a language of one source has no `pair` rows; without kept terms every value is 0;
ties are ranked by the item's UTF-8 bytes; extra columns are not read; an empty table gives an
empty result.  The result has a row per pair of sources of a language, so a language's number of
sources is what bounds a term's row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import documents, shared_table
from clientlens.functions.runs import LOWER, numbered, runs, text_slices

#: Fixed values of the contract.
IN_TERM = np.ones(256, bool)  # bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F]
for _low, _high in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    IN_TERM[_low : _high + 1] = False
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200

#: (node, ancestor) combinations corrected at once in a worker.
PAIRS = 1 << 20

def _partial_counts(batches):
    """Arrow batches (lang, source, text) -> (lang, source, term, n, docs) of each slice of texts."""
    for batch in batches:
        pair = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        group = pc.rank(pc.binary_join_element_wise(pc.binary_length(batch.column(0)).cast(pa.string()), *pair.flatten(), ":"), tiebreaker="dense").to_numpy()
        for a, b, data, starts in text_slices(batch.column(2)):
            data = LOWER[data]
            first, end = runs(IN_TERM[data], starts[:-1])
            ids, terms = numbered(data, first, end)
            if not len(ids):
                continue
            width = np.int64(len(terms))
            doc = np.searchsorted(starts, first, "right") - 1
            own, n = np.unique(doc * width + ids, return_counts=True)  # a row per document and term
            doc, term = a + own // width, own % width
            key, example, which = np.unique(group[doc].astype(np.int64) * width + term, return_index=True, return_inverse=True)
            total = np.bincount(which, weights=n, minlength=len(key)).astype(np.int64)  # below 2^53
            docs, rows = np.bincount(which, minlength=len(key)).astype(np.int64), pa.array(doc[example])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), terms.take(pa.array(term[example])), pa.array(total), pa.array(docs)],
                                             names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms in at least ``min_docs`` documents of the language."""
    own = Window.partitionBy("lang", "term")  # at most a row per source
    rows = counts.withColumn("in_docs", F.sum("docs").over(own)).where(F.col("in_docs") >= min_docs)
    return rows.select("lang", "source", "term", "n")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), exact for any count."""
    return (F.lit(1) + F.call_function("div", (count.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(11,0)"), whole.cast("decimal(38,0)"))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so longs hold the square."""
    return _div((p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every (lang, source) that occurs: place (of the source in its language), terms (V of the
    language), whole (N + V), lang_whole and zero (the value of a count of 0)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    rows = seen.join(size, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "terms"])
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    rows = rows.withColumn("whole", F.col("n") + F.col("terms"))
    rows = rows.withColumn("lang_whole", F.sum("n").over(Window.partitionBy("lang")) + F.col("terms"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("whole"))).otherwise(F.lit(1).cast("long"))
    return rows.select("lang", "source", "place", "terms", "whole", "lang_whole", zero.alias("zero"))


# ------------------------------------------------------------------- the tree


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def nodes(size: np.ndarray, place: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of sorted rows, laid end to end in ``place`` and ``value`` (``size`` entries a row,
    ``weight`` terms a row): per node the entry that stands for it, its number of ancestors
    (the entries just before it) and the number of terms below it."""
    off = np.cumsum(size) - size
    total = np.concatenate([[0], np.cumsum(weight)])
    same = np.arange(1, len(size))           # rows that share the whole path so far with the row before
    fresh = np.ones(len(size), bool)         # rows at which the path so far starts anew
    entry, depth, terms = [], [], []
    for d in range(int(size.max(initial=0))):
        same = same[(size[same] > d) & (size[same - 1] > d)]
        a, b = off[same] + d, off[same - 1] + d
        same = same[(place[a] == place[b]) & (value[a] == value[b])]
        fresh[:] = True
        fresh[same] = False
        start = np.flatnonzero(fresh)
        below = total[np.append(start[1:], len(size))] - total[start]
        has = size[start] > d
        entry.append(off[start[has]] + d)
        depth.append(np.full(int(has.sum()), d))
        terms.append(below[has])
    if not entry:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    return np.concatenate(entry), np.concatenate(depth), np.concatenate(terms)


def corrections(place: np.ndarray, value: np.ndarray, zero: np.ndarray, entry: np.ndarray, depth: np.ndarray, terms: np.ndarray, pairs: int = PAIRS):
    """Per chunk of (node, ancestor) combinations: source places a, b and the sum of
    f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq) with p of a and q of b, each combination computed once
    and both directions taken from it."""
    def f(p, q):
        return (p - q) ** 2 // q

    done = np.cumsum(depth)
    at = 0
    while at < len(entry):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + pairs, "right")))
        n = depth[at:end]
        own, up = np.repeat(entry[at:end], n), _ragged(entry[at:end] - n, n)
        m = np.repeat(terms[at:end], n)
        a, b = np.concatenate([own, up]), np.concatenate([up, own])
        add = np.concatenate([m, m]) * (f(value[a], value[b]) - f(value[a], zero[b]) - f(zero[a], value[b]) + f(zero[a], zero[b]))
        key, where = np.unique(place[a] << 32 | place[b], return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, where, add)
        yield key >> 32, key & 0xFFFFFFFF, out
        at = end


def walk(batches):
    """Arrow batches of sorted (lang, path, terms) rows -> (lang, a, b, correction)."""
    for batch in batches:
        lang, path, weight = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        size = np.diff(path.offsets.to_numpy())
        entries = path.flatten()
        place, value, zero = (entries.field(i).to_numpy().astype(np.int64) for i in range(3))
        off = np.cumsum(size) - size
        names = lang.to_pylist()
        cuts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(cuts, cuts[1:]):  # rows of one language
            lo, hi = off[a] if a < b else 0, off[b - 1] + size[b - 1] if a < b else 0
            part = [x[lo:hi] for x in (place, value, zero)]
            for left, right, add in corrections(*part, *nodes(size[a:b], part[0], part[1], weight[a:b])):
                yield pa.RecordBatch.from_arrays([pa.array([names[a]] * len(add), pa.string()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(add, pa.int64())],
                                                 names=["lang", "a", "b", "add"])


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    spark = kept.sparkSession
    own = kept.join(groups.select("lang", "source", "place", "whole", "zero"), ["lang", "source"])
    own = own.select("lang", "term", F.struct("place", share(F.col("n"), F.col("whole")).alias("value"), "zero").alias("x"))
    rows = own.groupBy("lang", "term").agg(F.array_sort(F.collect_list("x")).alias("path"))  # an entry per source at most
    rows = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
    rows = shared_table(rows, "divergence-rows")  # range bounds are sampled: one copy serves both reads
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = rows.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path")
    both = tree.mapInArrow(walk, "lang string, a long, b long, add long")
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.col("add").cast("decimal(38,0)")).alias("value"))

    # what one source's counts add against every other source's zeros
    counts = rows.select("lang", F.explode("path").alias("x"), "terms").groupBy("lang", "x").agg(F.sum("terms").alias("m"))
    counts = counts.select("lang", F.col("x.place").alias("own"), F.col("x.value").alias("value"), F.col("x.zero").alias("z"), "m")
    other = groups.select("lang", F.col("place").alias("other"), F.col("zero").alias("y"))
    single = counts.join(other, "lang").where("own <> other")
    m = F.col("m").cast("decimal(20,0)")
    ahead = single.select("lang", F.col("own").alias("a"), F.col("other").alias("b"), (m * (gain(F.col("value"), F.col("y")) - gain(F.col("z"), F.col("y")))).alias("value"))
    behind = single.select("lang", F.col("other").alias("a"), F.col("own").alias("b"), (m * (gain(F.col("y"), F.col("value")) - gain(F.col("y"), F.col("z")))).alias("value"))
    single = ahead.unionByName(behind).groupBy("lang", "a", "b").agg(F.sum("value").cast("decimal(38,0)").alias("value"))

    left = groups.select("lang", "source", F.col("place").alias("a"), F.col("zero").alias("z"), "terms")
    right = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("y"))
    base = left.join(right, "lang").where("a <> b")  # the result's own rows
    base = base.select("lang", "source", "item", "a", "b", (F.col("terms").cast("decimal(20,0)") * gain(F.col("z"), F.col("y"))).cast("decimal(38,0)").alias("base"))
    more = both.unionByName(single).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    out = base.join(more, ["lang", "a", "b"], "left")
    return out.select("lang", "source", "item", (F.col("base") + F.coalesce("more", F.lit(0).cast("decimal(38,0)"))).cast("long").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the kept terms that a source has more often than its language."""
    whole = F.sum("n").over(Window.partitionBy("lang", "term"))
    rows = kept.withColumn("lang_n", whole).join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("whole")).alias("p"), share(F.col("lang_n"), F.col("lang_whole")).alias("q"))
    return rows.where("p > q").select("lang", "source", "item", gain(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    kept = shared_table(kept_terms(term_counts(docs, lang_col, source_col, text_col), min_docs), "divergence-terms")
    groups = shared_table(groups_of(docs, kept, lang_col, source_col), "divergence-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(kept, groups).withColumn("rank", F.row_number().over(order))
    # the limit by rank is applied per task before rows move
    terms = term_values(kept, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    cols = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return cols(pairs, "pair").unionByName(cols(terms, "term"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
nv AS (SELECT lang, count(*) AS vv FROM v GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON w.lang = v.lang AND w.term = v.term GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS nn FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
ln AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS nn FROM cl GROUP BY lang),
p AS (SELECT gn.lang, gn.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.nn + nv.vv) AS p
      FROM gn JOIN v ON gn.lang = v.lang JOIN nv ON gn.lang = nv.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = v.term),
pq AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pq.value, 0) AS BIGINT) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pq ON pq.lang = a.lang AND pq.source = a.source AND pq.item = b.source),
lq AS (SELECT cl.lang, cl.term, 1 + (1000000000::HUGEINT * (cl.n + 1)) // (ln.nn + nv.vv) AS q FROM cl JOIN ln ON cl.lang = ln.lang JOIN nv ON cl.lang = nv.lang),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p.p - lq.q) * (p.p - lq.q)) // lq.q AS BIGINT) AS value
       FROM p JOIN lq ON p.lang = lq.lang AND p.term = lq.term WHERE p.n > 0 AND p.p > lq.q),
u AS (SELECT * FROM pr UNION ALL SELECT * FROM tm),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 200
"""

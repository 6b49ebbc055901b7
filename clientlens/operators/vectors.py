"""Exact nearest vectors.

``nearest_texts`` scans corpus texts once, in place: a worker turns a slice of texts into vectors
and scores them against the questions, so a (question, text) pair is never a row.  Per question it
keeps the k best so far; what cannot enter them is left out in two steps, both exact:

* a block of texts is skipped for a question whose bound over the block (the question's weights
  times the largest weight of each bucket in the block) is below the question's k-th best score;
* the rest is scored in single precision, whose error is bounded; only pairs within that error of the
  k-th best are scored in double precision, which decides.

Only k rows per task and question are shuffled.  Questions are taken in blocks of
``QUESTION_BYTES``; each block is one scan.

``PivotIndex`` stores vectors in cells around pivots, each with its distance to its pivot.  By the
triangle inequality a cell, or a vector in it, that is farther from the query than the k-th best can
be is left out before its vector is read.  It pays where vectors form groups; on vectors without
structure no exact bound prunes, and the share of pairs left is reported by ``pruned_share``."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from clientlens.functions.runs import numbered, text_slices, token_runs
from clientlens.session import arrow_rows, materialize

DIM = 256
QUESTION_BYTES = 1 << 26  # a block of questions: 32,768 of 256 dimensions
BLOCK = 256               # corpus texts bounded together
ERROR = 2e-5              # of a dot product of two unit vectors of up to DIM entries in single precision
MAX_PIVOTS = 256
CELL_ROWS, QUERY_ROWS = 2048, 256  # vectors and queries compared at once: matrices of 4 MB
BLOCK_ROWS = 4  # rows of an Arrow batch that are blocks


# ------------------------------------------------------------- hashed vectors


def _buckets(words: pa.Array, dim: int) -> np.ndarray:
    """The first 32 bits of a token's MD5, modulo dim: the same in any engine."""
    return np.fromiter((int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:4], "big") % dim for w in words.to_pylist()), np.int64, len(words))


def hashed_vectors(data: np.ndarray, starts: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Hashed token counts of lower-cased texts, scaled to length 1 (all zero without a token)."""
    first, end = token_runs(data, starts, 1)
    ids, words = numbered(data, first, end)
    row = np.searchsorted(starts, first, "right") - 1
    counts = np.bincount(row * dim + _buckets(words, dim)[ids], minlength=(len(starts) - 1) * dim).reshape(-1, dim).astype(float)
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return np.divide(counts, norm, out=counts, where=norm > 0)


def hashed_embedding(df: DataFrame, text_col: str = "text", dim: int = DIM, out_col: str = "embedding") -> DataFrame:
    """``df`` with the vector of each row's text, computed in the row's own task."""
    names = [*df.columns, out_col]

    def run(batches):
        for batch in batches:
            lower, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            for a, b, data, starts in text_slices(lower):
                v = hashed_vectors(data, starts, dim).astype(np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in rest] + [vec], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.lower(F.col(text_col)).alias("__lower")).mapInArrow(run, schema)


# ------------------------------------------------------------ scan of all texts


class Scan:
    """The k nearest texts of each question among the slices seen so far, by squared distance
    (rounded to 12 digits), then key."""

    def __init__(self, questions: np.ndarray, k: int, block: int = BLOCK):
        self.q, self.q32, self.k, self.block = questions, questions.astype(np.float32), k, block
        self.norm = (questions != 0).any(1).astype(float)
        self.best: list[list] = [[] for _ in questions]  # per question a heap, worst first
        # what a text must reach: 2 dot - |text|^2, as distance = |question|^2 minus that
        self.bar = np.full(len(questions), -np.inf)
        self.pairs = self.skipped = self.exact = 0

    def _offer(self, j: int, distance: float, key, payload) -> None:
        heap, item = self.best[j], (_Last(distance, key), payload)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif heap[0][0] < item[0]:
            heapq.heapreplace(heap, item)
        else:
            return
        if len(heap) == self.k:
            self.bar[j] = self.norm[j] - heap[0][0].distance

    def add(self, vectors: np.ndarray, keys: list, payload) -> None:
        """Score a slice; ``payload(i)`` is what to keep of its row i."""
        full = np.flatnonzero((vectors != 0).any(1))
        blank = np.setdiff1d(np.arange(len(keys)), full)
        self.pairs += len(self.q) * len(keys)
        # rows that meet a question in no bucket are all as far; the first by key stand for them
        for rows, size in ((blank, 0.0), (full, 1.0)):
            for i in heapq.nsmallest(self.k, rows.tolist(), key=keys.__getitem__):
                apart = vectors[i] @ self.q.T == 0
                for j in np.flatnonzero(apart & (self.bar <= -size + ERROR)).tolist():
                    self._offer(j, self.norm[j] + size, keys[i], payload(i))
        for at in range(0, len(full), self.block):
            rows = full[at : at + self.block]
            own = vectors[rows]
            open_ = np.flatnonzero(2 * (self.q @ own.max(0)) - 1 >= self.bar - 2 * ERROR)
            self.skipped += (len(self.q) - len(open_)) * len(rows)
            if not len(open_):
                continue
            dot = own.astype(np.float32) @ self.q32[open_].T
            score = 2 * dot - 1
            bar = self.bar[open_]
            if len(rows) >= self.k:
                bar = np.maximum(bar, np.partition(score, len(rows) - self.k, axis=0)[len(rows) - self.k] - 2 * ERROR)
            near, who = np.nonzero((score >= bar - 2 * ERROR) & (dot > 0))
            self.exact += len(near)
            exact = (own[near] * self.q[open_[who]]).sum(1)
            for i, j, d in zip(rows[near].tolist(), open_[who].tolist(), exact.tolist()):
                distance = round(self.norm[j] + 1.0 - 2 * d, 12) + 0.0  # no negative zero
                if len(self.best[j]) < self.k or distance <= self.best[j][0][0].distance:
                    self._offer(j, distance, keys[i], payload(i))


class _Last:
    """Orders a heap by the farthest (distance, key) first."""

    __slots__ = ("distance", "key")

    def __init__(self, distance, key):
        self.distance, self.key = distance, key

    def __lt__(self, other):
        return (self.distance, self.key) > (other.distance, other.key)


def _question_blocks(questions: DataFrame, key: str, text_col: str, dim: int):
    """Blocks of (keys, vectors) of at most QUESTION_BYTES."""
    limit = max(1, QUESTION_BYTES // (8 * dim))
    keys, parts, size = [], [], 0
    for row in questions.select(key, F.lower(F.col(text_col)).alias("t")).toLocalIterator():
        keys.append(row[0])
        parts.append(row[1])
        if len(keys) == limit:
            yield keys, _vectors(parts, dim)
            keys, parts = [], []
    if keys:
        yield keys, _vectors(parts, dim)


def _vectors(texts: list, dim: int) -> np.ndarray:
    return np.concatenate([hashed_vectors(data, starts, dim) for _, _, data, starts in text_slices(pa.array(texts, pa.string()))])


def _scan(shared, key_type: pa.DataType, k: int, dim: int, counts: bool):
    def run(batches):
        keys, vectors = shared.value
        scan, types = Scan(vectors, k), None
        for batch in batches:
            names, types = batch.column(0).to_pylist(), [c.type for c in batch.columns[:-1]]
            rest = batch.columns[:-1]
            for a, b, data, starts in text_slices(batch.column(batch.num_columns - 1)):
                scan.add(hashed_vectors(data, starts, dim), names[a:b], lambda i, a=a: tuple(c[a + i].as_py() for c in rest))
        if counts:
            yield pa.RecordBatch.from_pydict({"pairs": [scan.pairs], "skipped": [scan.skipped], "exact": [scan.exact]})
        elif types:
            found = [(keys[j], o.distance, *p) for j, heap in enumerate(scan.best) for o, p in heap]
            columns = list(zip(*found)) if found else [[] for _ in range(2 + len(types))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, pa.float64(), *types])], names=[str(i) for i in range(len(columns))])
    return run


def nearest_texts(questions: DataFrame, question_key: str, corpus: DataFrame, key: str, k: int = 4, dim: int = DIM,
                  question_text: str = "text", corpus_text: str = "text", counts: bool = False) -> DataFrame:
    """Per question its k nearest corpus texts by squared distance of hashed vectors (ties: ``key``):
    question_key, distance, the corpus columns, rank.  ``counts``: instead the numbers of pairs
    seen, skipped by block and scored in double precision."""
    if k <= 0:
        raise ValueError("top_k must be > 0")
    spark = corpus.sparkSession
    cols = [key, *[c for c in corpus.columns if c != key]]
    rows = corpus.select(*cols, F.lower(F.col(corpus_text)).alias("__lower"))
    schema = T.StructType([T.StructField(question_key, questions.schema[question_key].dataType), T.StructField("distance", T.DoubleType()),
                           *[corpus.schema[c] for c in cols]])
    found = None
    for block in _question_blocks(questions, question_key, question_text, dim):
        run = _scan(spark.sparkContext.broadcast(block), to_arrow_type(questions.schema[question_key].dataType), k, dim, counts)
        part = rows.mapInArrow(run, "pairs long, skipped long, exact long" if counts else schema)
        found = part if found is None else found.unionByName(part)
    if counts:
        return found.agg(*[F.sum(c).alias(c) for c in ("pairs", "skipped", "exact")])
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy(question_key).orderBy(F.col("distance").asc(), F.col(key).asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -------------------------------------------------------------- pivot cells


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _nearest(dim: int, k: int, slack: float, names: list[str]):
    """Rows of a block of queries and a block of vectors -> (query, key, distance), the k nearest of each
    query by distance, then place in the block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, to_pivot, reach, qv, keys, radii, vecs = (c.slice(i, 1).flatten() for c in batch.columns)
                q_at, x = _matrix_of(qv, dim), _matrix_of(vecs, dim)
                distance = np.zeros((len(q_at), len(x)))
                for d in range(dim):  # in the order of the dimensions, as a fold over them does
                    distance += np.square(x[:, d][None] - q_at[:, d][:, None])
                ring = np.abs(to_pivot.to_numpy()[:, None] - radii.to_numpy()[None]) <= reach.to_numpy()[:, None] + slack
                distance[~ring] = np.inf
                last = np.partition(distance, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                who, what = [], []
                for j in range(len(q_at)):
                    near = np.flatnonzero((distance[j] <= last[j]) & ring[j])
                    near = near[np.argsort(distance[j, near], kind="stable")][:k]
                    who.append(np.full(len(near), j))
                    what.append(near)
                who, what = np.concatenate(who), np.concatenate(what)
                yield pa.RecordBatch.from_arrays([q.take(pa.array(who)), keys.take(pa.array(what)), pa.array(distance[who, what])], names=names)
    return run


def _matrix_of(values: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(values).astype(float).reshape(-1, dim)


class PivotIndex:
    """Vectors of one length in cells around pivots: a stored table (cell, radius, key, vector)."""

    #: Distances to pivots are computed by a difference of squares; bounds allow for its error.
    SLACK = 1e-5

    def __init__(self, cells: DataFrame, pivots: np.ndarray, key: str, vec: str):
        self.cells, self.pivots, self.key, self.vec = cells, pivots, key, vec

    @classmethod
    def build(cls, corpus: DataFrame, key: str, vec: str = "embedding", pivots: int = 64) -> "PivotIndex":
        """Pivots are the vectors of least hash of their key (at most MAX_PIVOTS, read by the driver); every
        vector goes to its nearest.  The cells are written once."""
        chosen = corpus.select(F.col(vec).alias("v")).orderBy(F.xxhash64(key), key).limit(min(pivots, MAX_PIVOTS)).collect()
        points = np.array([r.v for r in chosen], float).reshape(len(chosen), -1)
        dim = points.shape[1]

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = _distances(_matrix(batch.column(1), dim), points)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), *batch.columns], names=["cell", "radius", key, vec])

        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()), corpus.schema[key], corpus.schema[vec]])
        return cls(materialize(corpus.select(key, vec).mapInArrow(run, schema)), points, key, vec)

    def _bounded(self, queries: DataFrame, query_key: str, query_vec: str, k: int) -> DataFrame:
        """(query, cell) pairs that can hold one of the k nearest: query, vector, cell, its distance to
        the pivot and ``reach``, which the k nearest lie within."""
        points, dim = self.pivots, self.pivots.shape[1]

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = _distances(_matrix(batch.column(1), dim), points)
                n, p = d.shape
                rows = pa.array(np.repeat(np.arange(n), p))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(d.ravel())],
                                                 names=["q", "qv", "cell", "to_pivot"])

        schema = T.StructType([T.StructField("q", queries.schema[query_key].dataType), T.StructField("qv", queries.schema[query_vec].dataType),
                               T.StructField("cell", T.IntegerType()), T.StructField("to_pivot", T.DoubleType())])
        away = queries.select(query_key, query_vec).mapInArrow(run, schema)
        ring = self.cells.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count(F.lit(1)).alias("n"))
        away = away.join(F.broadcast(ring), "cell")  # at most MAX_PIVOTS rows
        # the k nearest lie within the radius at which whole cells hold k vectors
        w = Window.partitionBy("q").orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        away = away.withColumn("far", F.col("to_pivot") + F.col("high"))
        away = away.withColumn("held", F.sum("n").over(w))
        everything = Window.partitionBy("q")
        away = away.withColumn("reach", F.coalesce(F.min(F.when(F.col("held") >= k, F.col("far"))).over(everything), F.lit(float("inf"))) + self.SLACK)
        near = F.greatest(F.col("to_pivot") - F.col("high"), F.col("low") - F.col("to_pivot"))
        return away.where(near <= F.col("reach") + self.SLACK).withColumn("near", near)

    def _left(self, pairs: DataFrame) -> DataFrame:
        """Pairs of a query and the vectors of a cell that the ring around the pivot leaves over."""
        return pairs.join(self.cells, "cell").where(F.abs(F.col("to_pivot") - F.col("radius")) <= F.col("reach") + self.SLACK)

    def _packed(self) -> DataFrame:
        """The cells cut into blocks of at most CELL_ROWS vectors, a row each, in the order of the key."""
        at = F.row_number().over(Window.partitionBy("cell").orderBy(self.key))
        rows = self.cells.withColumn("block", F.floor((at - 1) / F.lit(CELL_ROWS)).cast("int"))
        rows = rows.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct(F.col(self.key).alias("key"), "radius", F.col(self.vec).alias("vec")))).alias("r"))
        return rows.select("cell", "block", F.col("r.key").alias("keys"), F.col("r.radius").alias("radii"), F.flatten("r.vec").alias("vecs"))

    def _scored(self, pairs: DataFrame, packed: DataFrame, k: int) -> DataFrame:
        """(q, key, distance): of every block of a cell the k nearest to each query among the vectors that the
        ring around the pivot leaves over.  Blocks of queries meet blocks of vectors, so a (query,
        vector) pair is never a row."""
        at = F.row_number().over(Window.partitionBy("cell").orderBy("q"))
        qs = pairs.withColumn("part", F.floor((at - 1) / F.lit(QUERY_ROWS)).cast("int")).groupBy("cell", "part").agg(
            F.collect_list(F.struct("q", "to_pivot", "reach", "qv")).alias("s"))
        qs = qs.select("cell", F.col("s.q").alias("q"), F.col("s.to_pivot").alias("to_pivot"), F.col("s.reach").alias("reach"), F.flatten("s.qv").alias("qv"))
        # the blocks of a cell are dealt over tasks
        qs = qs.join(packed.select("cell", "block"), "cell")
        schema = T.StructType([T.StructField("q", pairs.schema["q"].dataType), self.cells.schema[self.key], T.StructField("distance", T.DoubleType())])
        return qs.join(packed, ["cell", "block"]).select("q", "to_pivot", "reach", "qv", "keys", "radii", "vecs").mapInArrow(_nearest(self.pivots.shape[1], k, self.SLACK, schema.names), schema)

    def topk(self, queries: DataFrame, query_key: str, query_vec: str = "qvec", k: int = 4) -> DataFrame:
        """Exactly the k nearest by squared distance (ties: key): query_key, key, distance, rank.  The cell
        nearest to a query is scored first, which tightens its reach for all others."""
        if k <= 0:
            raise ValueError("top_k must be > 0")
        spark = queries.sparkSession
        pairs = self._bounded(queries, query_key, query_vec, k)
        order = Window.partitionBy("q").orderBy("distance", self.key)
        first = F.row_number().over(Window.partitionBy("q").orderBy("to_pivot", "cell")) == 1
        pairs = pairs.withColumn("first", first)
        pairs = materialize(pairs)  # MAX_PIVOTS rows a query at most
        packed = materialize(self._packed())
        one = self._scored(pairs.where("first"), packed, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        with arrow_rows(spark, BLOCK_ROWS):
            one = materialize(one)
        tight = one.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("distance")).alias("d")).where(F.col("n") >= k).select("q", F.col("d").alias("tight"))
        rest = pairs.where(~F.col("first")).join(tight, "q", "left")
        rest = rest.withColumn("reach", F.least("reach", F.coalesce(F.col("tight") + self.SLACK, F.col("reach")))).where(F.col("near") <= F.col("reach") + self.SLACK)
        with arrow_rows(spark, BLOCK_ROWS):
            every = materialize(one.unionByName(self._scored(rest, packed, k)))
        top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return top.withColumnRenamed("q", query_key)

    def pruned_share(self, queries: DataFrame, query_key: str, query_vec: str = "qvec", k: int = 4) -> float:
        """Share of (query, vector) pairs that are never scored, by the cells' first bound."""
        pairs = self._bounded(queries, query_key, query_vec, k)
        scored = self._left(pairs).count()
        return 1.0 - scored / max(1, queries.count() * self.cells.count())

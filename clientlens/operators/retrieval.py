"""Document chunking, token index, keyword retrieval and dense vector top-k (hashed text vectors
and the pivot index are in ``operators/vectors``).

Keyword retrieval is an inverted-index equi-join on token between distinct
(query, token) and (chunk, token, tf) rows, then a grouped score and a
per-query top-k planned with WindowGroupLimit (partial top-k before the
shuffle), so no query's candidates are ever gathered whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions.parsing import collapse_ws, strip
from clientlens.functions.runs import numbered, text_slices, token_runs
from clientlens.functions.text import fixed_windows, paragraphs, tokens

CHUNK_SIZE, CHUNK_OVERLAP, PARAGRAPH_MAX = 900, 150, 900


def chunk_fixed(docs: DataFrame, source_col: str, text_col: str = "text",
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, source, chunk, text) windows; id = '<source>::chunk_<k>'."""
    # strip once into a column; the window lambda then only slices it
    d = docs.select(F.col(source_col).alias("source"), strip(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    d = d.select("source", fixed_windows(F.col("_t"), size, overlap).alias("_w"))
    # outer generator: Spark infers no size(...) > 0 pre-filter for it, which
    # would otherwise re-run the strip/window expression on every document
    out = d.select("source", F.posexplode_outer("_w").alias("chunk", "text")).where(F.col("chunk").isNotNull())
    return out.select(
        F.concat(F.col("source").cast("string"), F.lit("::chunk_"), F.col("chunk").cast("string")).alias("id"),
        "source", "chunk", "text",
    )


def chunk_starts(size: np.ndarray, max_len: int) -> np.ndarray:
    """First paragraphs of the chunks that greedy packing makes of one text's paragraphs (their
    sizes): a chunk takes paragraphs while the next one and a blank line still fit, at least
    one.  Every paragraph's jump to the first one that does not fit is found at once by a binary
    search over prefix sums; the starts are what the jumps reach from the first paragraph."""
    n = len(size)
    # a paragraph and the blank line after it
    upto = np.concatenate([[0], np.cumsum(size + 2)])
    jump = np.searchsorted(upto, upto[:-1] + max_len + 2, "right") - 1  # the last has no blank line
    jump = np.maximum(jump, np.arange(1, n + 1))
    reached, step = np.zeros(n + 1, bool), np.append(jump, n)
    reached[0] = True
    # doubling: after round r, all starts within 2^r jumps are marked
    while True:
        new = step[np.flatnonzero(reached)]
        if reached[new].all():
            return np.flatnonzero(reached[:n])
        reached[new] = True
        step = step[step]


def _packed(max_len: int):
    """Arrow batches (source, paragraphs) -> (source, chunk, text)."""
    def run(batches):
        for batch in batches:
            rows = batch.column(1)
            paras, where = rows.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy())])
            size = pc.utf8_length(paras).to_numpy().astype(np.int64)
            for i in range(batch.num_rows):
                a, b = int(where[i]), int(where[i + 1])
                if a == b:
                    continue
                starts = chunk_starts(size[a:b], max_len)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, b - a).astype(np.int32)), paras.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(starts), i))), pa.array(np.arange(len(starts), dtype=np.int32)), pc.binary_join(lists, "\n\n")],
                                                 names=["source", "chunk", "text"])
    return run


def chunk_paragraphs(docs: DataFrame, source_col: str, text_col: str = "text",
                     max_len: int = PARAGRAPH_MAX) -> DataFrame:
    """R2: blank-line paragraphs greedily packed up to ``max_len`` chars; an oversize paragraph
    stays whole.  Linear in the text, whatever its number of paragraphs."""
    d = docs.select(F.col(source_col).alias("source"), paragraphs(F.col(text_col)).alias("_p"))
    schema = T.StructType([T.StructField("source", docs.schema[source_col].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())])
    return d.mapInArrow(_packed(max_len), schema)


def _row_tokens(min_len: int):
    """Arrow batches (keys..., lower-cased text) -> (keys..., token, tf), a row per row and token."""
    def run(batches):
        for batch in batches:
            keys = batch.columns[:-1]
            for a, _, data, starts in text_slices(batch.column(batch.num_columns - 1)):
                first, end = token_runs(data, starts, min_len)
                ids, words = numbered(data, first, end)
                if not len(ids):
                    continue
                row = np.searchsorted(starts, first, "right") - 1
                key, tf = np.unique(row * np.int64(len(words)) + ids, return_counts=True)
                rows = pa.array(a + key // len(words))
                yield pa.RecordBatch.from_arrays([*[k.take(rows) for k in keys], words.take(pa.array(key % len(words))), pa.array(tf.astype(np.int64))],
                                                 names=[*batch.schema.names[:-1], "token", "tf"])
    return run


def row_tokens(rows: DataFrame, key_cols: list[str], text_col: str = "text", min_len: int = 3) -> DataFrame:
    """(key..., token, tf): the distinct tokens of each row's text, counted in the row's own task."""
    schema = T.StructType([*[rows.schema[k] for k in key_cols], T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.select(*key_cols, F.lower(F.col(text_col)).alias("__lower")).mapInArrow(_row_tokens(min_len), schema)


def token_frequencies(chunks: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """(key..., token, tf): counted in the row, then summed over rows of one key."""
    return row_tokens(chunks, key_cols, text_col).groupBy(*key_cols, "token").agg(F.sum("tf").alias("tf"))


def keyword_retrieve(queries: DataFrame, query_key: str, chunks: DataFrame, chunk_keys: list[str],
                     k: int = 5, query_text: str = "text", chunk_text: str = "text") -> DataFrame:
    """score = sum over distinct query tokens found in the chunk of (1 + 0.05 * min(tf, 3));
    score > 0; top k per query, ties by chunk order (``chunk_keys``)."""
    qt = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("token")).distinct()
    # only tokens some query contains can score; a row's tokens are counted in its own task, and
    # its matches lie next to each other, so the aggregation is done before rows move
    ct = row_tokens(chunks, chunk_keys, chunk_text)
    # a chunk's scoring tokens are brought together, not its (query, chunk) pairs, which are many more:
    # pairs are made, summed and cut to the best k of a task where they arise
    ct = ct.join(qt.select("token").distinct(), "token", "left_semi").repartition(*chunk_keys)
    m = ct.join(qt, "token").groupBy(query_key, *chunk_keys).agg(
        F.count(F.lit(1)).alias("n_match"), F.sum(F.least(F.col("tf"), F.lit(3))).alias("bonus_units")
    )
    key = F.col("n_match") * 20 + F.col("bonus_units")  # 20 x score, exact integer
    w = Window.partitionBy(query_key).orderBy(key.desc(), *[F.col(c).asc() for c in chunk_keys])
    ranked = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(query_key, "rank", *chunk_keys,
                         F.round(F.col("n_match") + F.col("bonus_units") * 0.05, 6).alias("score"))


# ---------------------------------------------------------------- vectors
def embed_with(df: DataFrame, embed_batch, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """R6 plug point: ``embed_batch(list[str]) -> list[list[float]]`` applied per Arrow
    batch in a pandas UDF (the model is created once per Python worker by the callable)."""
    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        vecs = embed_batch(texts.fillna("").tolist())
        if len(vecs) != len(texts):
            raise ValueError(f"Embeddings count mismatch: embeddings={len(vecs)} texts={len(texts)}")
        return pd.Series([list(map(float, v)) for v in vecs])

    return df.withColumn(out_col, _embed(F.col(text_col)))


def sq_l2(a: Column, b: Column) -> Column:
    """Squared L2 distance of two equal-length arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def vector_topk(queries: DataFrame, query_key: str, corpus: DataFrame, corpus_key: str, k: int = 4,
                q_vec: str = "qvec", c_vec: str = "embedding") -> DataFrame:
    """Exact k nearest corpus vectors per query by squared L2 (ties: corpus key).

    Every query of the stated set is compared with every corpus vector; Spark broadcasts the
    queries where their bytes allow it and pairs blocks of both sides where not.
    Top-k per query uses WindowGroupLimit, so only k rows per task and query are shuffled."""
    if k <= 0:
        raise ValueError("top_k must be > 0")
    pairs = corpus.select(corpus_key, c_vec).crossJoin(queries.select(query_key, q_vec))
    pairs = pairs.select(query_key, corpus_key, sq_l2(F.col(q_vec), F.col(c_vec)).alias("distance"))
    w = Window.partitionBy(query_key).orderBy(F.col("distance").asc(), F.col(corpus_key).asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroids(emb: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Unit-norm mean vector per label (one query per label), in one aggregation of vectors."""
    mean = Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))
    c = emb.groupBy(label_col).agg(mean.alias("_v")).select(label_col, vector_to_array("_v").alias("_m"))
    norm = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x))
    return c.select(label_col, F.transform("_m", lambda x: x / norm).alias("qvec"))


def rag_hits(hits: DataFrame) -> DataFrame:
    """(source, chunk, distance, text) with missing distance -> 0."""
    return hits.select(*[c for c in hits.columns if c not in ("distance",)],
                       F.coalesce(F.col("distance").cast("double"), F.lit(0.0)).alias("distance"))


def context_block(hits: DataFrame, query_key: str, max_chars: int = 900, max_hits: int = 4) -> DataFrame:
    """Per query, a character-budgeted context block over ranked hits
    (query_key, rank, source, chunk, distance, text).  Empty hits are skipped but
    keep their number; the running budget is a windowed sum over <= max_hits rows."""
    h = hits.where(F.col("rank") <= max_hits).withColumn("_t", collapse_ws(strip(F.coalesce(F.col("text"), F.lit("")))))
    h = h.withColumn("_t", strip(F.col("_t")))
    ne = h.where(F.length("_t") > 0)
    w = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ne = ne.withColumn("_used", F.least(F.lit(max_chars), F.coalesce(F.sum(F.length("_t")).over(w), F.lit(0))))
    ne = ne.withColumn("_rem", F.lit(max_chars) - F.col("_used")).where(F.col("_rem") > 0)
    header = F.concat_ws(
        " | ",
        F.when(F.length(F.coalesce(F.col("source").cast("string"), F.lit(""))) > 0, F.col("source").cast("string")),
        F.when(F.col("chunk").isNotNull(), F.concat(F.lit("chunk="), F.col("chunk").cast("string"))),
        F.when(F.col("distance").isNotNull(), F.format_string("dist=%.4f", F.col("distance").cast("double"))),
    )
    header = F.when(F.length(header) > 0, header).otherwise(F.lit("source inconnue"))
    line = F.format_string("- (%d) %s: %s", F.col("rank"), header, F.col("_t").substr(F.lit(1), F.col("_rem")))
    per_q = ne.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return per_q.select(
        query_key,
        F.concat(F.lit("Contexte interne (extraits du corpus):\n"),
                 F.array_join(F.transform("_l", lambda s: s["line"]), "\n")).alias("context"),
    )


def signal_query_text(mode: Column, plan: Column, ville: Column, inactivity_high: Column, history_low: Column) -> Column:
    """Retrieval query from the client's signals (word lists are fixed values)."""
    # fixed values: the query vocabulary of the guided exploration
    base = ["contexte", "métriques", "rétention", "pmE saas"]
    inact = ["inactivité", "dernier", "paiement", "retard", "days_since_last_paid"]
    hist = ["historique", "paiement", "faible", "paid_count_before_T", "paid_sum_before_T"]
    free_w = ["acquisition", "conversion", "free"]
    paid_w = ["rétention", "payant", "basic", "pro"]

    def words(ws):
        return F.array(*[F.lit(w) for w in ws])

    empty = F.array().cast("array<string>")
    parts = F.concat(
        words(base),
        F.when(mode == "client", F.array(F.lit("client"), plan, ville)).otherwise(F.array(F.lit("segment"), F.lit("plan"), plan)),
        F.when(F.coalesce(inactivity_high, F.lit(False)), words(inact)).otherwise(empty),
        F.when(F.coalesce(history_low, F.lit(False)), words(hist)).otherwise(empty),
        F.when(plan == "free", words(free_w)).otherwise(words(paid_w)),
    )
    return F.array_join(F.filter(parts, lambda p: F.coalesce(F.length(p) > 0, F.lit(False))), " ")

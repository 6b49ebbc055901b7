"""Secret scans with corpus-wide ownership frequency.

1. *Candidates* per document, in its row: matches of the base kinds (assign, access, hex) and
   of wider token shapes, with the lengths of the pieces between them.  Matches become rows, and
   running sums of those lengths their places; no Python runs.
2. *Ownership*: candidate values are hashed; per hash the distinct repositories and owners
   that hold it are counted (distinct pairs first, combined per task, so a value copied into
   a third of all rows is a few rows).
3. *Verdict*: values that many owners or many repositories hold, whoever owns them, are
   widely copied examples; values of few of both that look random are live-looking.  Base
   spans always stay; wider shapes become spans only where they are live-looking.

``documents`` has neither owners nor repositories: by default ``source`` stands in for the
owner and ``doc_id`` for the repository.

Defined results: null text is empty (no spans); a null owner or repository counts as one
owner or repository; rows that share an id are scanned one by one; offsets are code points,
end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import documents, shared_table

#: Fixed values of the contract: kinds in order, their patterns, least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"      # AKIA[A-Z0-9]+ of 20 or more: a run starts at its first AKIA
HEX = r"[0-9a-f]{24,}"             # a maximal run
VALUE_MIN = 6
BASE_KINDS = ("assign", "access", "hex")

#: The method's wider shapes: long runs of token characters with a digit and a letter.
WIDE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{32,}"
KINDS = (*BASE_KINDS, "wide")

#: A value that more owners, or more repositories of any owners, hold than this is an example.
MAX_OWNERS = 2
MAX_REPOS = 10
#: Distinct characters that a live-looking value has at least.
MIN_ALPHABET = 8
SALTS = 16


def _pieces(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<rank, at, gap, size, match>>: the pattern's leftmost matches, each with the
    code points between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    each = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    each = F.transform(each, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["match"].alias("match")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<rank:int,at:int,gap:int,size:int,match:string>>"))


PATTERNS = (ASSIGN, ACCESS, HEX, WIDE)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str = "doc_id") -> DataFrame:
    """doc_id, row (a number of the row), owner, repo, and ``pieces``: all matches of the row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                    F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = F.concat(*[_pieces(F.col("t"), k, p) for k, p in zip(KINDS, PATTERNS)])
    return d.select("doc_id", F.monotonically_increasing_id().alias("row"), "owner", "repo", pieces.alias("pieces"))


def spans_of(found: DataFrame) -> DataFrame:
    """A row per span: row, owner, repo, start, rank, kind, end, value.  Places are running sums over a
    row's matches and overlaps one pass over its spans by place, so a text's work grows with its
    matches (and their sorting), not with their square."""
    x = found.select("row", "owner", "repo", F.explode("pieces").alias("x")).select("row", "owner", "repo", "x.*")
    so_far = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    value = F.when(F.col("rank") == KINDS.index("assign"), F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    x = x.select("row", "owner", "repo", (F.col("end") - F.col("size")).alias("start"), "rank", "end", value.alias("value"))
    x = x.where((F.col("rank") != KINDS.index("assign")) | (F.length("value") >= VALUE_MIN))
    # a wide span that meets a base span says nothing new: one that starts no later and ends after
    # its start, or one that starts after it and before its end
    base = F.col("rank") < len(BASE_KINDS)
    ahead = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("reach", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn("next", F.min(F.when(base, F.col("start"))).over(behind))
    meets = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    return x.where(base | ~meets).select("row", "owner", "repo", "start", "rank", kind.alias("kind"), "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, owner, repo) rows -> value_hash, n_owners, n_repos."""
    seen = spans.select("value_hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    owners = seen.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("r"))
    # a repository has one owner: its copies under several owners count once for each
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repos"))


def is_example(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners > MAX_OWNERS) | (n_repos > MAX_REPOS)


def scan(docs: DataFrame, **cols) -> tuple[DataFrame, DataFrame]:
    """(documents, values): per row doc_id and ``spans`` (start, kind, end, n_owners, n_repos,
    live); per value hash its owners, repositories and verdict."""
    found = shared_table(candidates(docs, **cols), "secret-candidates")
    spans = spans_of(found).withColumn("value_hash", F.sha2("value", 256))
    spans = shared_table(spans, "secret-spans")
    # one value may be a third of all spans: its rows are dealt over SALTS tasks
    freq = ownership(spans).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    random = F.size(F.array_distinct(F.split("value", ""))) >= MIN_ALPHABET
    judged = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(freq, ["value_hash", "salt"]).drop("salt").withColumn("live", ~is_example(F.col("n_owners"), F.col("n_repos")) & random)
    values = judged.groupBy("value_hash").agg(F.first("n_owners").alias("n_owners"), F.first("n_repos").alias("n_repos"),
                                              F.max("live").alias("live"), F.count(F.lit(1)).alias("n_spans"))
    kept = judged.where(F.col("kind").isin(*BASE_KINDS) | F.col("live"))
    one = F.struct("start", "rank", "kind", "end", "n_owners", "n_repos", "live")
    # the spans of one row come back together: as many as the row held
    by_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    return found.select("doc_id", "row").join(by_row, "row", "left").drop("row"), values


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = scan(documents(spark, sf_dir))
    spans = F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType))
    rows = rows.select("doc_id", spans.alias("s"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text("s").alias("spans"),
        F.size(F.filter("s", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("s", lambda x: is_example(x["n_owners"], x["n_repos"]))).cast("long").alias("n_example"),
    )

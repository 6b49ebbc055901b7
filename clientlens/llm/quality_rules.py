"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores its measurements
and one failure bit per rule.  Policies are versioned masks over those bits, so
a new policy or an ablation never reads the texts again: both are bitwise work
on the ledger.  All expressions run in the JVM and in the row of the document
(no shuffle of words or lines).

Defined results: a null or blank text has no words (all measurements 0) and
fails the base; repeated rows are judged one by one; a null id is kept as
null; other columns of the table are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import NOT_WS, words

#: Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: (rule, SQL condition of a failure over the measurements); the place is the bit.
RULES = (
    ("too_few_words", f"n_words < {MIN_WORDS}"),
    ("repeated_words", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("exclamations", "2 * n_exclaim > n_words"),
    ("capitals", "2 * n_upper > word_chars"),
    ("word_length", "word_chars > 30 * n_words OR word_chars < 2 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]

#: Versioned policies: a document is rejected if it fails any rule of the mask.
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["repeated_lines"], "v2": sum(BIT.values())}
POLICY = "v2"


def _count(text: Column, chars: str) -> Column:
    return F.size(F.split(text, chars, -1)) - 1


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the measurements (long)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_WS))
    d = d.select("doc_id", "t", words(F.col("t")).alias("w"), lines.alias("l"))
    n = F.size("w")
    window = lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, WINDOW))
    none = F.array().cast("array<string>")
    d = d.select(
        "doc_id", n.alias("n"), F.length(F.array_join("w", "")).alias("chars"),
        _count(F.col("t"), SYMBOLS).alias("symbols"), _count(F.col("t"), "!").alias("exclaim"),
        _count(F.col("t"), "[A-Z]").alias("upper"), F.size("l").alias("lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), window)).otherwise(none).alias("win"),
    )
    # only texts with a repeated window go on: equal windows become neighbours
    twice = F.size(F.array_distinct("win")) < F.size("win")
    placed = F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(twice, placed)).drop("win")
    pairs = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    d = d.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(pairs))))).drop("s")
    # each repeated window covers its words; neighbours may overlap
    covered = F.aggregate(
        "at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    out = {"n_words": "n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "dup_lines",
           "n_lines": "lines", "n_exclaim": "exclaim", "n_upper": "upper"}
    return d.select(
        "doc_id", *[F.col(v).cast("long").alias(k) for k, v in out.items()],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def fail_bits() -> Column:
    return F.expr(" | ".join(f"if({cond}, {BIT[name]}L, 0L)" for name, cond in RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements with ``fail_bits`` (long), one row per document."""
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits())


def verdict(bits: Column, policy: str = POLICY) -> Column:
    """True if the policy keeps a document with these failure bits."""
    return bits.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail only it, and documents kept
    without it.  The ledger is first reduced to a histogram of bit masks (at most
    2^rules rows, combined map-side); the rest is bitwise."""
    mask = POLICIES[policy]
    hist = led.groupBy((F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("long").alias("bit")) for k, b in BIT.items() if b & mask])
    x = hist.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("bits").bitwiseAND(F.lit(mask).cast("long").bitwiseXOR(F.col("bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return x.groupBy("rule", "bit").agg(
        total(hit)("failed"), total(F.col("bits") == F.col("bit"))("failed_alone"), total(without)("kept_without"))


def op4(docs: DataFrame) -> DataFrame:
    led = ledger(docs)
    base_failed = led["fail_bits"].bitwiseAND(F.lit(BASE).cast("long")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        base_failed.alias("base_failed"), (~base_failed & verdict(F.col("fail_bits"))).alias("kept"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = POLICY) -> DataFrame:
    """The rows that the policy keeps, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct()
    led = ledger(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")))
    # pushed into the measurements, the filter would evaluate them once per use: it can't pass this column
    led = led.withColumn("__fixed", F.monotonically_increasing_id())
    return led.where(verdict(F.col("fail_bits"), policy) & (F.col("__fixed") >= 0)).select("doc_id.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM m WHERE len(w) >= 5)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(0, 5)) AS o) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
        length(t) - length(replace(t, '!', '')) AS n_exclaim, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM m LEFT JOIN p ON p.doc_id = m.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN 2 * n_exclaim > n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)
        + (CASE WHEN word_chars > 30 * n_words OR word_chars < 2 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, fail_bits = 0 AS kept FROM b
"""

"""Language identification by cross-parsing entropy.

1. *Training text.*  Each language is learnt from a bounded sample: of its labelled training rows,
   the text of smallest hash in each of ``SAMPLE_DOCS`` slots of hashes, end to end, to ``SAMPLE_BYTES`` bytes of UTF-8.  Both bounds are parameters; the minima are combined per task before rows move,
   and copies of a text count once.
2. *Model.*  The suffix automaton of that text: every substring of it is a path from the root, so
   walking it reads the longest match with the training text, whatever its length.
   Texts are read in lower case with every run of ASCII characters that are no letters as one space:
   digits, symbols and line ends tell nothing about the language.
3. *Parsing.*  A text is cut greedily into phrases, each the longest match with the language's text
   (or one unknown byte).  A language that needs few phrases knows the text's long stretches:
   phrases x log2(training bytes) / bytes of the text estimates the cross entropy in bits a
   byte; the least wins.  Whole texts are read; they are parsed in blocks of ``BLOCK`` bytes, all
   blocks of a batch in step, so a long text is many lanes, not a long loop.

A worker holds a table of at most 2 x SAMPLE_BYTES states by the bytes that occur, per language, and
builds it once from the broadcast training texts (SAMPLE_BYTES a language).

Language, source and id are no inputs of a prediction.  Learnt are only rows whose crc32(id as text)
mod 3 is not 1.

Defined results: null texts and texts without a letter give `und` and score 0; a row without id has
held_out false and is not learnt from; ties go to the smallest language by code point; the score is
the runner-up's entropy by the sum of both (0.5 for a tie, towards 1 for a clear winner), 1 if only
one language is known; without any labelled training row all is `und`; rows that share an id are
predicted one by one; an empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import documents
from clientlens.functions.runs import text_slices

#: Fixed values of the contract.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"

SAMPLE_DOCS = 256
SAMPLE_BYTES = 1 << 15
BLOCK = 1 << 10


#: Byte -> byte: ASCII letters in lower case and all bytes from 0x80 on stay, others are a space.
PLAIN = np.array([b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_texts(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
                   sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Per language its training text: at most ``sample_bytes`` bytes."""
    rows = docs.where((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    # of each of sample_docs slots of hashes the least hash: narrow rows, combined per task, so that
    # neither copies nor long texts travel and no task sees a language's rows together
    keys = rows.groupBy("lang", F.pmod("hash", F.lit(sample_docs)).alias("place")).agg(F.min("hash").alias("hash"))
    # sample_docs rows a language; the texts are cut to what the sample can take at most
    text = rows.join(F.broadcast(keys), ["lang", "hash"]).groupBy("lang", "place").agg(F.min(F.substring("text", 1, sample_bytes)).alias("text"))
    out: dict[str, bytes] = {}
    for r in text.orderBy("lang", "place").toLocalIterator():
        have = out.setdefault(r.lang, b"")
        if len(have) < sample_bytes:
            own = np.frombuffer(r.text.lower().encode("utf-8") + b" ", np.uint8)
            out[r.lang] = (have + plain(own, np.zeros(1, np.int64))[0].tobytes())[:sample_bytes]
    return dict(sorted(out.items()))


def plain(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with runs of spaces (see PLAIN) reduced to one, and where they start."""
    data = PLAIN[data]
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


# ------------------------------------------------------------------ automaton


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all suffixes of ``text``; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:  # q also ends longer substrings: split it
                split = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return go


class Parser:
    """Phrase counts of texts against one training text."""

    def __init__(self, text: bytes):
        self.bits = math.log2(max(2, len(text)))
        seen = sorted(set(text))
        self.column = np.zeros(256, np.int64)  # column 0: bytes that the training text lacks
        self.column[seen] = np.arange(1, len(seen) + 1)
        go = suffix_automaton(text)
        self.width = len(seen) + 1
        # a step that fails, or starts at the root, begins a phrase: it is stored as the
        # complement of the state after it
        start = np.zeros(self.width, np.int32)
        for c, s in go[0].items():
            start[self.column[c]] = s
        table = np.tile(~start, (len(go), 1))
        for s in range(1, len(go)):
            for c, t in go[s].items():
                table[s, self.column[c]] = t
        self.table = table.ravel()

    def phrases(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of the blocks ``first``, ``size`` (longest block first) of ``data``."""
        symbols = self.column[data]
        state = np.zeros(len(first), np.int64)
        count = np.zeros(len(first), np.int64)
        lanes = len(first)
        for t in range(int(size[0]) if len(size) else 0):
            while lanes and size[lanes - 1] <= t:
                lanes -= 1
            to = self.table[state[:lanes] * self.width + symbols[first[:lanes] + t]]
            begun = to >> 31  # -1 where a phrase began
            count[:lanes] -= begun
            state[:lanes] = to ^ begun
        return count


_PARSERS: dict[bytes, Parser] = {}


def parser(text: bytes) -> Parser:
    """The worker's parser of a training text, built once."""
    if text not in _PARSERS:
        _PARSERS[text] = Parser(text)
    return _PARSERS[text]


def blocks(starts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts laid end to end: first byte, size and text of each, longest first."""
    n = np.diff(starts)
    per = -(-n // block)
    text = np.repeat(np.arange(len(n)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = starts[text] + nth * block
    size = np.minimum(block, starts[text + 1] - first)
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], text[order]


def entropies(data: np.ndarray, starts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Bits a byte of each text (rows) under each training text (columns); nan for empty texts."""
    first, size, text = blocks(starts)
    n = np.diff(starts)
    out = np.empty((len(n), len(texts)))
    for k, t in enumerate(texts):
        p = parser(t)
        count = np.bincount(text, weights=p.phrases(data, first, size), minlength=len(n))
        out[:, k] = np.divide(count * p.bits, n, out=np.full(len(n), np.nan), where=n > 0)
    return out


def _predict(shared):
    def run(batches):
        names, texts = shared.value
        known = pa.array([*names, UNKNOWN], pa.string())
        for batch in batches:
            column = batch.column(2)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for a, b, data, starts in text_slices(pc.utf8_lower(column)):
                data, starts = plain(data, starts)
                pick, score = np.full(b - a, len(names)), np.zeros(b - a)
                has = letters[a:b]
                if names and has.any():
                    bits = entropies(data, starts, texts)[has]
                    best = bits.argmin(1)  # the first of equal ones
                    pick[has] = best
                    if len(names) == 1:
                        score[has] = 1.0
                    else:
                        two = np.partition(bits, 1, axis=1)
                        score[has] = two[:, 1] / (two[:, 0] + two[:, 1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], known.take(pa.array(pick)), pa.array(score)],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, texts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((list(texts), list(texts.values())))  # SAMPLE_BYTES a language
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, training_texts(docs))

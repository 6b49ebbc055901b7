"""Token counts by section through token offsets.

Whole documents are encoded once; every token keeps the characters it covers.  A section is
a span of characters with a name; tokens and sections of a document are joined on their
intervals (both are ordered, so the join is a binary search in the row of the document).
A token that crosses a boundary is allocated by an explicit rule:

* ``most``: to the section that holds most of its bytes, the earlier one on ties;
* ``first``: to the section that holds its first byte.

Bytes of a token outside all sections count for no section; a token wholly outside is
reported under a null section.  A token of no bytes of a character's own (a character split
over tokens) covers the bytes it has.

Sections come from a column ``sections`` (array of struct<name, start, end>, code points,
end exclusive; overlapping ones are taken in order of start, each byte belonging to the
first) or are the lines of the text, each with its line end.

Defined results: null and empty texts have no tokens and, by lines, one empty section 0;
null sections or spans outside the text count nothing; repeated rows are counted one by
one; a null id stays null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.bpe import Encoder, _kept, default_ranks, token_ends, widths
from clientlens.llm.common import documents

RULE = "most"
_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                  ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])
_DDL = "doc_id long, section string, start long, end long, n_tokens long, n_crossing long"


def lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names (0, 1, ...), starts and ends of a text's lines."""
    parts = text.split("\n")
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), np.int64, len(parts)))
    ends[-1] = len(text)
    return [str(i) for i in range(len(parts))], np.r_[0, ends[:-1]], ends


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that end at these bytes, sections [start, stop) in bytes, ordered and disjoint ->
    (section of each token or -1, does the token cross a boundary)."""
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    if not len(start):
        return np.full(len(ends), -1), np.zeros(len(ends), bool)
    # the first section that ends after the token's first byte, and the one that holds its last
    low = np.searchsorted(stop, begin, "right")
    high = np.searchsorted(start, ends, "left") - 1
    touch = (low <= high) & (low < len(start))
    inside = touch & (low == high) & (start[np.minimum(low, len(start) - 1)] <= begin) & (ends <= stop[np.minimum(low, len(start) - 1)])
    out = np.where(touch, low, -1)
    for i in np.flatnonzero(touch & (low < high)):
        s = np.arange(low[i], high[i] + 1)
        if rule == "most":
            out[i] = s[np.argmax(np.minimum(stop[s], ends[i]) - np.maximum(start[s], begin[i]))]
    if rule == "first":
        at = np.minimum(low, len(start) - 1)
        out = np.where(touch & (start[at] <= begin), out, -1)
    return out, touch & ~inside


def _bytes_at(text: str, place: np.ndarray) -> np.ndarray:
    """Byte offsets of code point offsets."""
    if text.isascii():
        return place
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.r_[0, np.cumsum(wide)][np.clip(place, 0, len(points))]


def _disjoint(spans, length: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows, at = [], 0
    for x in sorted((x for x in spans or () if x and x["start"] is not None and x["end"] is not None), key=lambda x: (x["start"], x["end"])):
        a, b = max(at, x["start"], 0), min(x["end"], length)
        if a < b:
            rows.append((x["name"], a, b))
            at = b
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)


def token_counts(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
                 sections_col: str | None = None, rule: str = RULE) -> DataFrame:
    """One row per section of each row: doc_id, section, start, end, n_tokens, n_crossing (tokens
    of it that also touch other sections or the space between)."""
    if rule not in ("most", "first"):
        raise ValueError(f"no rule {rule!r}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = _kept("encoder", shared, Encoder)
        width = _kept("width", shared, widths)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            given = batch.column(2).to_pylist() if sections_col else None
            row, out = 0, {f.name: [] for f in _OUT}
            for ids, count in encoder.texts(texts):
                for ends in token_ends(ids, count, width):
                    text = texts[row]
                    names, start, stop = _disjoint(given[row], len(text)) if given else lines(text)
                    which, cross = attribute(ends, _bytes_at(text, start), _bytes_at(text, stop), rule)
                    total = np.bincount(which + 1, minlength=len(names) + 1)
                    across = np.bincount(which + 1, weights=cross, minlength=len(names) + 1).astype(np.int64)
                    if total[0]:
                        names, start, stop = [*names, None], np.r_[start, -1], np.r_[stop, -1]
                        total, across = np.r_[total, total[0]], np.r_[across, across[0]]
                    doc = batch.column(0)[row].as_py()
                    for k, v in zip(out, ([doc] * len(names), names, start.tolist(), stop.tolist(), total[1:].tolist(), across[1:].tolist())):
                        out[k] += v
                    row += 1
                if len(out["doc_id"]) > 8192:
                    yield pa.RecordBatch.from_pydict(out, schema=_OUT)
                    out = {f.name: [] for f in _OUT}
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).cast("array<struct<name:string,start:long,end:long>>").alias("sections"))
    return docs.select(*cols).mapInArrow(run, _DDL)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts(documents(spark, sf_dir), default_ranks(spark))

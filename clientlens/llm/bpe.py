"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

*Boundaries.* A text is an array of code points.  A lookup table gives each its class
(letter, number, white space, other); with one to three code points of look-ahead this
becomes one of nine symbols.  A small automaton over these symbols says where tokens of the
split pattern begin.  Its transition functions form a finite monoid, so a run over the
text is an associative scan: functions are composed block by block for all blocks at
once, block totals are scanned in turn, and the state before every code point falls out.
No regular expression runs.
*Merging.* The slices between boundaries go through a bounded cache to pair merging by rank
(lowest rank first, leftmost on ties); long slices use a heap.
*Decoding.* Ids are stored as little-endian unsigned 32-bit integers with, on request, the
byte offset at which each token ends (cumulated widths of the vocabulary's entries, as
little-endian 64-bit integers); decoding concatenates the vocabulary's bytes, of all tokens
or of a range of them, whose place in the text the offsets give.

The vocabulary (a rank file, broadcast: its size is that of the file, about 1 MB) is a parameter.  Special tokens are ordinary text.

Defined results: null text is the empty text (no ids, empty bytes); a null id of a row stays
null; repeated rows are encoded one by one; the text is encoded whole, whatever its length."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import documents

# ---------------------------------------------------------------- boundaries

LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_STOP = 0x110000  # stands between texts

# symbols: a space that joins the next token, another last white space, white space before
# white space or the end, letter, number, other, apostrophes of contractions that take one
# or two letters, end of text
JOIN, LAST, BLANK, LET, NUM, OTH, SHORT, LONG, STOP = range(9)
# states: fresh, after JOIN, in blanks, in letters, in numbers, in others, one / two letters to take
FRESH, JOINED, BLANKS, LETS, NUMS, OTHS, TAKE1, TAKE2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token begin here)."""
    if symbol == STOP:
        return FRESH, True
    if symbol == JOIN:
        return JOINED, True
    if symbol == LAST:
        return FRESH, True
    if symbol == BLANK:
        return BLANKS, state != BLANKS
    if symbol == LET:
        if state == TAKE2:
            return TAKE1, False
        if state == TAKE1:
            return FRESH, False
        return LETS, state not in (JOINED, LETS)
    if symbol == NUM:
        return NUMS, state not in (JOINED, NUMS)
    if symbol == OTH or state in (JOINED, OTHS):
        return OTHS, state not in (JOINED, OTHS)
    return (TAKE1 if symbol == SHORT else TAKE2), True


@cache
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(_STOP)), np.uint8, _STOP)
    out[list(WHITE_SPACE)] = SPACE
    return np.append(out, np.uint8(END))


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol -> function, (function, function) -> their composition, (function, state) -> state."""
    gens = [tuple(_step(q, a)[0] for q in range(8)) for a in range(9)]
    known: dict[tuple, int] = {tuple(range(8)): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[q] for q in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    funcs = list(known)
    compose = np.array([[known[tuple(g[q] for q in f)] for g in funcs] for f in funcs], np.uint8)
    return np.array([known[g] for g in gens], np.uint8), compose, np.array(funcs, np.uint8)


def _states(func: np.ndarray, block: int = 256) -> np.ndarray:
    """State before each place of a sequence of transition functions that starts FRESH."""
    _, compose, apply = _monoid()
    size, n = len(compose), len(func)
    flat = compose.ravel()
    if n <= block:
        out, q = np.empty(n, np.uint8), FRESH
        for i in range(n):
            out[i] = q
            q = apply[func[i], q]
        return out
    wide = -(-n // block)
    grid = np.zeros(wide * block, np.uint8)  # function 0 is the identity
    grid[:n] = func
    grid = np.ascontiguousarray(grid.reshape(wide, block).T)
    before = np.zeros_like(grid)
    acc = np.zeros(wide, np.uint8)
    for i in range(block):
        before[i] = acc
        acc = flat[acc.astype(np.intp) * size + grid[i]]
    start = _states(acc, block)
    return apply.ravel()[before.astype(np.intp) * 8 + start[None, :]].T.ravel()[:n]


@cache
def _begins() -> np.ndarray:
    return np.array([[_step(q, a)[1] for a in range(9)] for q in range(8)], bool)


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a token of the split pattern begins; ``points`` are code points of texts,
    each followed by _STOP (which counts as a token of its own)."""
    kind = _classes()[points]
    after = np.append(kind[1:], np.uint8(END))
    space = kind == SPACE
    last = space & (after != SPACE) & (after != END)
    symbol = np.array([LET, NUM, BLANK, OTH, STOP], np.uint8)[kind]
    symbol[last] = LAST
    symbol[last & (points == 0x20)] = JOIN
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        far = np.append(points, [_STOP, _STOP])
        one, two = far[quote + 1], far[quote + 2]
        symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        symbol[quote[pair]] = LONG
    gens, _, _ = _monoid()
    return _begins().ravel()[_states(gens[symbol]).astype(np.intp) * 9 + symbol]


# ------------------------------------------------------------------- merging


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: neighbours of the lowest rank are joined first, leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    cut = list(range(len(piece) + 1))
    get, none = ranks.get, len(ranks) + 256
    rank = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while rank:
        low = min(rank)
        if low == none:
            break
        i = rank.index(low)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(piece[cut[i] : cut[i + 2]], none)
        if i:
            rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # a part has grown since
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Ranks with a bounded cache of merged slices."""

    LIMIT = 3 << 17   # cached slices; the cache starts anew beyond it
    CHUNK = 1 << 19   # code points encoded at once, or one longer text

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tokens, self.first = array("I"), array("q", [0])

    def _add(self, piece: str) -> int:
        self.tokens.extend(merge(piece.encode("utf-8"), self.ranks))
        self.first.append(len(self.tokens))
        self.known[piece] = at = len(self.first) - 2
        return at

    def texts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts -> chunks of (ids of all their texts end to end, number of ids of each)."""
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > self.CHUNK:
                yield self._chunk(part)
                part, size = [], 0
            part.append(t)
            size += len(t) + 1
        if part:
            yield self._chunk(part)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.LIMIT:
            self.clear()
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        points[stops] = _STOP
        at = np.flatnonzero(boundaries(points))
        text_of = np.searchsorted(stops, at)
        real = at != stops[text_of]
        begin, end = at[real], np.append(at[1:], len(points))[real]
        known, add = self.known, self._add
        pieces = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        index = np.fromiter((known[p] if p in known else add(p) for p in pieces), np.int64, len(pieces))
        first = np.array(self.first, np.int64)
        count = first[index + 1] - first[index]
        total = np.cumsum(count)
        tokens = np.array(self.tokens, np.uint32)
        where = np.repeat(first[index] - (total - count), count) + np.arange(total[-1] if len(total) else 0)
        per_text = np.bincount(text_of[real], weights=count, minlength=len(texts)).astype(np.int64)
        return tokens[where], per_text


# ------------------------------------------------------------- Spark operator


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank file (base64 bytes and rank on each line) -> ranks.  Read through Spark, or from
    the driver's own disk where it is installed with the program."""
    lines = open(path, "rb").read().split(b"\n") if "://" not in path else [
        r.value.encode() for r in spark.read.text(path).collect()]  # a vocabulary, not data
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_WORKER: dict[str, tuple[int, object]] = {}


def _kept(kind: str, shared, make):
    """What a Python worker keeps between tasks for the vocabulary at hand."""
    if _WORKER.get(kind, (None,))[0] != id(shared.value):
        _WORKER[kind] = (id(shared.value), make(shared.value))
    return _WORKER[kind][1]


def vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        table[v] = k
    return table


def widths(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each id's vocabulary entry."""
    return np.array([len(x) for x in vocabulary(ranks)], np.int64)


def token_ends(ids: np.ndarray, count: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    """A chunk of ``Encoder.texts`` -> per text the byte offsets at which its tokens end."""
    at = 0
    for n in count.tolist():
        yield np.cumsum(width[ids[at : at + n]])
        at += n


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_ENDS = pa.schema([*_IDS, ("ends", pa.binary())])


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id long, ids binary: little-endian unsigned 32-bit integers), one row per row; with
    ``offsets`` also ``ends`` (binary: little-endian 64-bit integers), where tokens end."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder = _kept("encoder", shared, Encoder)
        width = _kept("width", shared, widths) if offsets else None
        for batch in batches:
            at = 0
            for rows, ends in _ids_rows(encoder, batch.column(1), width):
                cols = [batch.column(0).slice(at, len(rows)), pa.array(rows, pa.binary())]
                if offsets:
                    cols.append(pa.array(ends, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema=_ENDS if offsets else _IDS)
                at += len(rows)

    ddl = "doc_id long, ids binary" + ", ends binary" * offsets
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def _ids_rows(encoder: Encoder, texts, width: np.ndarray | None = None) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """A column of texts -> their stored ids and, given widths, token ends, some texts at a time."""
    for ids, count in encoder.texts(t.as_py() or "" for t in texts):
        raw, cuts = ids.tobytes(), (np.cumsum(count) * 4).tolist()
        ends = [] if width is None else [x.astype("<i8").tobytes() for x in token_ends(ids, count, width)]
        yield [raw[a:b] for a, b in zip([0, *cuts], cuts)], ends


def _text_of(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


_BOTH = pa.schema([*_IDS, ("bytes", pa.binary())])
_BOTH_DDL = "doc_id long, ids binary, bytes binary"


_PLACED = pa.schema([*_BOTH, ("start", pa.int64()), ("end", pa.int64())])


def decode(tokens: DataFrame, ranks: dict[bytes, int], first: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, bytes): the vocabulary's bytes, end to end, of the tokens
    ids[first:stop] (as Python slices).  If ``tokens`` has ``ends``, also ``start`` and ``end``: the
    bytes of the text that these tokens cover."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    placed = "ends" in tokens.columns

    def run(batches):
        table = _kept("vocabulary", shared, vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column(1)]
                cols = [part.column(0), part.column(1), pa.array([_text_of(x[first:stop], table) for x in ids], pa.binary())]
                if placed:
                    ends = [np.r_[0, np.frombuffer(x.as_buffer(), "<i8")] for x in part.column(2)]
                    spans = [slice(first, stop).indices(len(x))[:2] for x in ids]
                    cols += [pa.array([int(e[a]) for e, (a, _) in zip(ends, spans)], pa.int64()),
                             pa.array([int(e[max(a, b)]) for e, (a, b) in zip(ends, spans)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=_PLACED if placed else _BOTH)

    return tokens.select("doc_id", "ids", *["ends"] * placed).mapInArrow(run, _BOTH_DDL + ", start long, end long" * placed)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker a task instead of two."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encoder, table = _kept("encoder", shared, Encoder), _kept("vocabulary", shared, vocabulary)
        for batch in batches:
            at = 0
            for rows, _ in _ids_rows(encoder, batch.column(1)):
                texts = [_text_of(np.frombuffer(x, "<u4"), table) for x in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array(rows, pa.binary()), pa.array(texts, pa.binary())], schema=_BOTH)
                at += len(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _BOTH_DDL)


def ids_array(ids: Column) -> Column:
    """Stored ids as array<long>."""
    place = F.sequence(F.lit(1), F.length(ids) - 3, F.lit(4))
    byte = lambda i, k: F.conv(F.hex(F.substr(ids, i + k, F.lit(1))), 16, 10).cast("long") * (1 << 8 * k)
    one = lambda i: byte(i, 0) + byte(i, 1) + byte(i, 2) + byte(i, 3)
    return F.when(F.length(ids) > 0, F.transform(place, one)).otherwise(F.array().cast("array<long>"))


def digests(docs: DataFrame, ranks: dict[bytes, int], **cols) -> DataFrame:
    """Encoded and decoded: doc_id, n_tokens, and the SHA-256 of the ids and of the bytes."""
    both = round_trip(docs, ranks, **cols)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def default_ranks(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, int]:
    import public_tokenizers

    return read_ranks(spark, public_tokenizers.path(name))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), default_ranks(spark))

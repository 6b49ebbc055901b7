"""N-gram Jaccard join with PartEnum signatures.

Sets are the distinct 5-word shingles of a text; two documents link when
100 * |A & B| >= 80 * |A | B|.

*Bands.* Sizes are cut into bands [l, 1.25 l]; a partner b >= a of a set in band i lies in
band i or i+1, so a set signs in the spaces of its own band and of the band below.
*PartEnum.* In a space, linked sets differ in at most k = (a + b) / 9 shingles.  The shingle
domain is hashed into n1 groups of n2 partitions; as n1 * (k2 + 1) > k, some group has at
most k2 differing partitions, so some subset of n2 - k2 of its partitions is equal in both.
Each such subset is one signature (a hash of the projection).  Long texts use n2 = 1 (the
projection on one partition), short ones enumerate subsets, as their partitions hold less.
*Empty projections* would be shared by unrelated texts and are not signed.  A set whose
non-empty partitions still outnumber what k differences can spoil needs none of them; the
few sets for which they don't (``deficient``) go to the exact rest below.
*Buckets.* Rows (signature, document) are dealt by signature, sorted, and streamed: a bucket
of up to CAP rows yields all its pairs, a larger one the pairs with its first document.
Buckets already large within one input batch are reduced there to their first document, so
a signature that a third of all rows share sends a row per batch, not per document.
*The exact rest.* A signature in a large bucket whose documents are not all in one component by
then counts as lost.  A set that keeps more signatures than k differences can spoil still
shares one that is not lost with every linked set; the few sets that don't, and deficient
ones, are joined by prefix filter: of the shingles ordered by frequency, linked
sets share one among their first n - ceil(0.8 n) + 1, and enough must be left behind the
first one they share.  Pairs inside one component are skipped, all others are compared, so
no link between components is lost.
*Shared signatures.* A set that can lose s signatures and still share one shares at least s + 1 with
every linked set; those of them that lie in large buckets may be lost, all others are seen.  So a
pair met in fewer buckets than s + 1 less the signatures lost, for either set, has no link; that
drops pairs that share a passage only, before anything but their numbers moves.
*Check.* Every candidate pair that is left is decided on the whole shingle sets.  Before sets move, a
pair falls if parity sketches prove it apart: each set has one bit per bucket of a hash, the
parity of its shingles there; where two bits differ the sets differ, so more differing bits
than differences allowed rule a link out, and nothing else does.

Shingles are 64-bit hashes (a false match within two documents needs about 2^32 shingles).

Defined results: null or blank text: n_shingles 0, linked with nothing, own component; empty
tables give empty results.  In ``join`` rows that share a doc_id are one node, whose texts all
count; rows with a null doc_id take part in nothing and have a null component.  In ``keep``
every row is a node of its own, whatever its id: of a component the row with the smallest id
stays (a null id last), of repeated ids the first by locator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientlens.llm.common import anti_by_key, documents, is_scan, semi_by_key, shared_table, with_locator
from clientlens.llm.components import components
from clientlens.llm.shingles import mix, shingle_sets

NUM, DEN = 80, 100  # the similarity of a link
CAP = 32            # rows of a bucket that yields all its pairs
SALTS = 16          # tasks over which the rows of one bucket are dealt in joins
BATCH_BYTES = 1 << 23  # bytes of an Arrow batch of texts or sets
SHORT = 64          # sets under this size enumerate subsets of partitions
#: Characters of the texts signed at once, or one longer text (a bound on memory; results do
#: not depend on it), and rows sent on at once.
CHUNK, SEND = 1 << 20, 1 << 18

#: Kinds of rows (kind, x, a): signature rows carry the signature in x (LEAD: of a bucket
#: already large in its chunk), pairs the other document; SPARE has the document in x and in a
#: the signatures it can lose, -1 if it is deficient.
ROW, LEAD, HOT, STAR, PAIR, SPARE = range(6)
_KINDS = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("a", pa.int64())])
_KIND_DDL = "kind int, x long, a long"


def _bands(top: int = 1 << 40) -> list[tuple[int, int]]:
    out, low = [], 1
    while low < top:
        high = low * DEN // NUM
        out.append((low, high))
        low = high + 1
    return out


BANDS = _bands()
_LOW = np.array([x for x, _ in BANDS])


def differences(a: int, b: int) -> int:
    """Most shingles that linked sets of these sizes can differ in."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def layout(space: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of a band's space."""
    low, high = BANDS[space]
    k = differences(high, high * DEN // NUM)
    if low < SHORT:
        return k, -(-(k + 1) // 3) + 1 if k else 1, 4 if k else 1, min(2, k)
    return k, int((k + 1) * 1.25) + 1, 1, 0


def signatures(size: np.ndarray, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets laid end to end in ``elements``: (set index, signature) of every non-empty
    projection, and how many signatures a set can lose in any space it signs in and still
    share one with every linked set (-1: it is deficient)."""
    owner = np.repeat(np.arange(len(size)), size)
    band = np.searchsorted(_LOW, size, "right") - 1
    who, sigs, spare = [], [], np.full(len(size), 1 << 30)
    for space in np.unique(np.concatenate([band, band - 1])):
        if space < 0:
            continue
        inside = (size > 0) & ((band == space) | ((band == space + 1) & (size <= BANDS[space][1] * DEN // NUM)))
        if not inside.any():
            continue
        k, n1, n2, k2 = layout(int(space))
        place = np.cumsum(inside) - 1
        use = inside[owner]
        x, at = elements[use], place[owner[use]]
        seed = np.uint64((int(space) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = mix(x ^ seed)
        part = (h % np.uint64(n1 * n2)).astype(np.int64) + at * (n1 * n2)
        cells = int(inside.sum()) * n1 * n2
        total = np.zeros(cells, np.uint64)
        np.add.at(total, part, mix(h))
        filled = np.bincount(part, minlength=cells) > 0
        total, filled = total.reshape(-1, n1, n2), filled.reshape(-1, n1, n2)
        spoil = np.minimum(filled.sum(2), k2 + 1).sum(1)  # differences needed to spoil every group
        ids = np.flatnonzero(inside)
        # a lost signature costs its group, which k2 + 1 differences would spoil
        spare[ids] = np.minimum(spare[ids], np.where(spoil > k, (spoil - k - 1) // (k2 + 1), -1))
        group = np.arange(n1, dtype=np.uint64)
        for c, subset in enumerate(combinations(range(n2), n2 - k2)):
            s = np.zeros(total.shape[:2], np.uint64)
            some = np.zeros(total.shape[:2], bool)
            for p in subset:
                s = mix(s + total[:, :, p])
                some |= filled[:, :, p]
            s = mix(s ^ mix(seed + group * np.uint64(64) + np.uint64(c))[None, :])
            i, g = np.nonzero(some)
            who.append(ids[i])
            sigs.append(s[i, g])
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.uint64), spare
    return np.concatenate(who), np.concatenate(sigs), spare


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text) of about CHUNK characters."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids of a batch with an id, and their sets."""
    batch = batch.filter(batch.column(0).is_valid())
    return batch.column(0).to_numpy(), shingle_sets(batch.column(1).to_pylist())


def _batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)


def _rows(kind, x: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(a), kind, np.int32) if np.isscalar(kind) else kind
    return _batch(_KINDS, kind=kind, x=x, a=a)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> signature rows; buckets that are large within a chunk are reduced here."""
    for whole in batches:
        for part in _chunks(whole):
            ids, sets = _sets(part)
            full = np.array([len(s) > 0 for s in sets], bool)
            if not full.any():
                continue
            ids, sets = ids[full], [s for s in sets if len(s)]
            who, sig, spare = signatures(np.array([len(s) for s in sets]), np.concatenate(sets))
            yield _rows(SPARE, ids, spare)
            doc, sig = ids[who], sig.view(np.int64)
            order = np.lexsort((doc, sig))
            doc, sig = doc[order], sig[order]
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            count = np.diff(np.r_[start, len(sig)])
            lead = np.zeros(len(sig), bool)
            lead[start] = True
            large = np.repeat(count > CAP, count)
            go = ~large | lead
            kind, x, a = np.where(large[go], LEAD, ROW).astype(np.int32), sig[go], doc[go]
            for i in range(0, len(a), SEND):
                yield _rows(kind[i : i + SEND], x[i : i + SEND], a[i : i + SEND])
            if not go.all():
                hub = np.repeat(doc[start], count)[~go]
                yield _rows(HOT, sig[~go], doc[~go])
                yield _rows(STAR, doc[~go], hub)


def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (x, a) -> the pairs of small buckets, the pairs with its first document
    and the rows (HOT) of large ones; other kinds pass.  Of the bucket that crosses batches,
    CAP + 1 rows are held at most, or its first document."""
    bucket, held, large, hub = None, np.empty(0, np.int64), False, None

    def spill(rows):
        yield _rows(STAR, rows, np.full(len(rows), hub))
        yield _rows(HOT, np.full(len(rows), bucket), rows)

    def close():
        nonlocal hub
        if large and hub is None and len(held):
            hub = held[0]
            yield from spill(held)
        elif hub is None and len(held) > 1:
            yield from _pairs(held[None, :])

    for batch in batches:
        kind = batch.column(0).to_numpy()
        other = kind > LEAD
        if other.any():
            yield batch.filter(pa.array(other))
        kind, sig, a = kind[~other], batch.column(1).to_numpy()[~other], batch.column(2).to_numpy()[~other]
        if not len(sig):
            continue
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.r_[start, len(sig)])
        lead = np.maximum.reduceat(kind, start) == LEAD
        inner = np.ones(len(start), bool)
        inner[0] = inner[-1] = False
        small = inner & ~lead & (n <= CAP)
        for size in np.unique(n[small & (n > 1)]):  # small buckets that lie inside the batch
            yield from _pairs(a[start[small & (n == size)][:, None] + np.arange(size)])
        for i in np.flatnonzero(~small):
            if bucket is None or sig[start[i]] != bucket:
                yield from close()
                bucket, held, large, hub = sig[start[i]], np.empty(0, np.int64), False, None
            rows = a[start[i] : start[i] + n[i]]
            large = large or bool(lead[i])
            if hub is None:
                held = np.unique(np.concatenate([held, rows]))
                if len(held) > CAP:
                    hub = held[0]
                    yield from spill(held)
            else:
                yield from spill(rows)
    yield from close()


def _pairs(groups: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All pairs within each row of ``groups`` (ids ascending); those with the first are STAR."""
    i, j = np.triu_indices(groups.shape[1], 1)
    kind = np.where(i == 0, STAR, PAIR).astype(np.int32)
    step = max(1, 200_000 // len(i))
    for at in range(0, len(groups), step):
        g = groups[at : at + step]
        yield _rows(np.tile(kind, len(g)), g[:, j].ravel(), g[:, i].ravel())


_SIZED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])
_SIZED_DDL = "doc_id long, n_shingles long, digest binary, sketch binary"
SKETCH = 1024  # bits


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = (mix(np.concatenate(sets) if sets else np.empty(0, np.uint64)) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(owner * SKETCH + place, minlength=len(sets) * SKETCH) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(bool).reshape(len(sets), SKETCH), axis=1)]


def _apart(batches):
    """(a, n_a, sketch_a, b, n_b, sketch_b) -> the pairs that may be linked."""
    for batch in batches:
        if not len(batch):
            continue
        n = batch.column(1).to_numpy() + batch.column(4).to_numpy()
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(n), -1) for i in (2, 5))
        differ = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
        near = pa.array(differ <= n * (DEN - NUM) // (DEN + NUM))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(3).filter(near)], schema=_PAIR)


def _sized(batches):
    for batch in (part for whole in batches for part in _chunks(whole)):
        sets = shingle_sets(batch.column(1).to_pylist())
        digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield _batch(_SIZED, doc_id=batch.column(0), n_shingles=[len(s) for s in sets], digest=digest, sketch=sketches(sets))


_SET = pa.schema([("node", pa.int64()), ("items", pa.binary())])


def _with_sets(batches):
    for batch in (part for whole in batches for part in _chunks(whole)):
        ids, sets = _sets(batch)
        yield _batch(_SET, node=ids, items=[s.tobytes() for s in sets])


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(batches):
    """(a, items_a, b, items_b) -> the linked pairs."""
    for batch in batches:
        left, right, keep = batch.column(1), batch.column(3), []
        for i in range(len(left)):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and DEN * both >= NUM * (len(x) + len(y) - both):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take)], schema=_PAIR)


_ITEM = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("item", pa.int64())])


def _items(batches):
    """(node, items) -> a row per shingle."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        size = np.array([len(x) for x in sets], np.int64)
        if size.sum():
            yield _batch(_ITEM, node=np.repeat(batch.column(0).to_numpy(), size), n=np.repeat(size, size), item=np.concatenate(sets))


def _text_items(batches):
    """(doc_id, text) -> a row per shingle."""
    return _items(_with_sets(batches))


def salted(rows: DataFrame, groups: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``groups`` (a row per ``key``), the rows of a key dealt by ``by`` over SALTS tasks."""
    groups = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(groups, [key, "__salt"]).drop("__salt")


def _names(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return df.select(*[F.col(x).alias(y) for x, y in pairs])


class _Join:
    """The steps of one join, over the texts (doc_id, text) of one table."""

    def __init__(self, texts: DataFrame, sized: DataFrame, repeated: bool):
        self.texts, self.repeated = texts, repeated
        self.sized = sized.where("digest IS NOT NULL").select("doc_id", "n_shingles", "sketch")
        self.links: DataFrame | None = None
        self.comp: DataFrame | None = None

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, items) of ``nodes`` (doc_id): only their texts are shuffled."""
        out = semi_by_key(self.texts, nodes, "doc_id").mapInArrow(_with_sets, "node long, items binary")
        return out.distinct() if self.repeated else out

    def items(self, nodes: DataFrame) -> DataFrame:
        """(node, n, item): a row per shingle of ``nodes`` (doc_id).  A task turns texts into shingles in
        one Python worker; a second one after it in the stage would hold its memory beside the first."""
        ddl = "node long, n long, item long"
        if self.repeated:  # equal sets of an id count once; the shuffle between parts the workers
            return self.sets(nodes).mapInArrow(_items, ddl)
        return semi_by_key(self.texts, nodes, "doc_id").mapInArrow(_text_items, ddl)

    def add(self, links: DataFrame) -> None:
        links = links.select("a", "b")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.comp = shared_table(components(self.links), "jaccard-components")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (a, b), decided on whole sets."""
        for end in ("a", "b"):
            own = _names(self.sized, ("doc_id", end), ("n_shingles", f"n_{end}"), ("sketch", f"sketch_{end}"))
            pairs = pairs.join(own, end)
        pairs = pairs.select("a", "n_a", "sketch_a", "b", "n_b", "sketch_b").mapInArrow(_apart, "a long, b long")
        pairs = shared_table(pairs.distinct() if self.repeated else pairs, "jaccard-pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = shared_table(self.sets(shared_table(nodes, "jaccard-nodes")), "jaccard-sets")
        left = pairs.join(_names(sets, ("node", "a"), ("items", "items_a")), "a")
        both = left.join(_names(sets, ("node", "b"), ("items", "items_b")), "b")
        return shared_table(both.select("a", "items_a", "b", "items_b").mapInArrow(_linked, "a long, b long"), "jaccard-links")

    def labelled(self, df: DataFrame, node: str, label: str) -> DataFrame:
        """``df`` with the component of its ``node`` column so far."""
        c = _names(self.comp, ("node", node), ("component", "__c"))
        return df.join(c, node, "left").withColumn(label, F.coalesce("__c", node)).drop("__c")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component yet."""
        p = self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb")
        return p.where("ca <> cb").select("a", "b")

    def mixed(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows (key, node, component...) of the buckets that hold more than one component; a
        bucket's rows are dealt over SALTS tasks."""
        ends = rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return salted(rows, ends.where("low <> high").select(key), key, "node")

    def rest(self, nodes: DataFrame) -> None:
        """Links between components among ``nodes`` (doc_id), by prefix filter."""
        items = shared_table(self.items(nodes), "jaccard-items")
        often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        # rarest first, so that what many texts share comes last; a document ranks its own shingles.
        # Those that no other text has come before all others and meet nobody: they are only counted
        own = Window.partitionBy("node", "n")
        ranked = items.join(often, "item").withColumn("at", F.row_number().over(own.orderBy("df", "item")))
        ranked = ranked.withColumn("at", F.col("at") + F.col("n") - F.count(F.lit(1)).over(own))
        need = F.ceil(F.col("n") * NUM / DEN)
        prefix = shared_table(ranked.where(F.col("at") <= F.col("n") - need + 1).select("node", "n", "item", "at"), "jaccard-prefix")
        # first each bucket against its first document, then what still lies apart
        rows = shared_table(self.mixed(self.labelled(prefix, "node", "component"), "item"), "jaccard-mixed")
        hub = rows.groupBy("item").agg(F.min("node").alias("a"), F.min_by("component", "node").alias("ca"), F.min_by("n", "node").alias("na"), F.min_by("at", "node").alias("ata"))
        star = salted(rows, hub, "item", "node").where(f"component <> ca AND {_fits('n', 'at', 'na', 'ata')}")
        self.add(self.verify(_names(star, ("a", "a"), ("node", "b")).distinct()))
        rows = shared_table(self.mixed(self.labelled(rows.select("item", "node", "n", "at"), "node", "component"), "item"), "jaccard-mixed")
        # a bucket's largest component is no left side: its own pairs are not formed
        share = rows.groupBy("item", "component").agg(F.count(F.lit(1)).alias("c"))
        main = share.groupBy("item").agg(F.max_by("component", "c").alias("main"))
        left = salted(rows, main, "item", "node").where("component <> main")
        left = _names(left, ("item", "item"), ("node", "l"), ("n", "nl"), ("at", "atl"), ("component", "cl"))
        pairs = left.join(rows, "item").where(f"cl <> component AND {_fits('n', 'at', 'nl', 'atl')}")
        pairs = pairs.select(F.least("l", "node").alias("a"), F.greatest("l", "node").alias("b")).distinct()
        self.add(self.verify(pairs))


def _fits(n: str, at: str, m: str, bt: str) -> str:
    """SQL: can sets of n and m shingles link whose first common shingle is their at-th and
    bt-th?  Sizes must allow it, and so must the shingles that are left in both."""
    return (f"{DEN} * {n} >= {NUM} * {m} AND {DEN} * {m} >= {NUM} * {n} AND "
            f"{DEN + NUM} * (1 + least({n} - {at}, {m} - {bt})) >= {NUM} * ({n} + {m})")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    docs = docs if is_scan(docs) else shared_table(docs, "jaccard-input")
    with _rows_per_batch(docs.sparkSession):
        return _join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


@contextmanager
def _rows_per_batch(spark: SparkSession, rows: int = 1000, key: str = "spark.sql.execution.arrow.maxRecordsPerBatch"):
    """Arrow batches of texts and sets stay small in rows and bytes, whatever the session's setting."""
    wanted = {key: rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _join(texts: DataFrame) -> DataFrame:
    """The join over (doc_id, text), which every read finds the same."""
    sized = shared_table(texts.mapInArrow(_sized, _SIZED_DDL), "jaccard-sized")

    # equal sets are linked by digest; only the first document of each goes on
    some = sized.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = some.groupBy("digest").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = salted(some, first, "digest", "doc_id").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    ids = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ids = shared_table(ids, "jaccard-repeated-ids")
    repeated = not ids.isEmpty()
    copies = shared_table(copies.distinct() if repeated else copies, "jaccard-copies")
    dropped = copies.select(F.col("b").alias("doc_id"))
    dropped = dropped.join(ids, "doc_id", "left_anti") if repeated else dropped

    signed = anti_by_key(texts, dropped, ["doc_id"]).mapInArrow(sign, _KIND_DDL)
    # only rows of signatures meet by signature; the others are dealt evenly
    meet = F.when(F.col("kind").isin(ROW, LEAD), F.col("x")).otherwise(F.xxhash64("x", "a"))
    dealt = signed.repartition(meet).sortWithinPartitions("x", "a")
    found = shared_table(dealt.mapInArrow(pair_up, _KIND_DDL), "jaccard-found")
    pairs = found.where(F.col("kind").isin(STAR, PAIR)).where("a <> x")
    pairs = pairs.groupBy(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("met"))
    # per document the least number of buckets in which it meets a linked one
    lost = found.where(F.col("kind") == HOT).groupBy("a").agg(F.count(F.lit(1)).alias("lost"))
    spare = _names(found.where(F.col("kind") == SPARE), ("x", "node"), ("a", "spare")).groupBy("node").agg(F.min("spare").alias("spare"))
    least = spare.join(_names(lost, ("a", "node"), ("lost", "lost")), "node", "left").select("node", (F.col("spare") - F.coalesce("lost", F.lit(0)) + 1).alias("least"))
    least = shared_table(least.where("least > 1"), "jaccard-least")
    for end in ("a", "b"):
        pairs = pairs.join(_names(least, ("node", end), ("least", f"least_{end}")), end, "left")
    pairs = pairs.where("met >= greatest(coalesce(least_a, 1), coalesce(least_b, 1))").select("a", "b", "kind")
    pairs = shared_table(pairs, "jaccard-candidates")

    step = _Join(texts, sized, repeated)
    step.add(copies.unionByName(step.verify(pairs.where(F.col("kind") == STAR).select("a", "b"))))
    step.add(step.verify(step.across(pairs.where(F.col("kind") == PAIR).select("a", "b"))))
    hot = step.labelled(_names(found.where(F.col("kind") == HOT), ("x", "x"), ("a", "node")), "node", "component")
    lost = step.mixed(hot, "x").groupBy("node").agg(F.count(F.lit(1)).alias("lost"))
    spare = _names(found.where(F.col("kind") == SPARE), ("x", "node"), ("a", "spare"))
    late = spare.join(lost, "node", "left").where(F.coalesce("lost", F.lit(0)) > F.col("spare"))
    late = shared_table(late.select(F.col("node").alias("doc_id")).distinct(), "jaccard-late")
    if not late.isEmpty():
        step.rest(late)
    out = step.labelled(sized.select(F.col("doc_id").alias("node"), "n_shingles"), "node", "component_id")
    return out.select(F.col("node").alias("doc_id"), "n_shingles", "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


#: Bits of a row's number that say its place in its file; the others number the files.
ROW_BITS = 40


def _numbered(docs: DataFrame, cols: list[Column]) -> DataFrame:
    """``cols`` plus ``__node``, a number that each row of a file scan has in every read; its
    order is that of the locators.  Its files (which the driver lists anyway) are broadcast."""
    files = with_locator(docs, []).select("__path").distinct().collect()
    files = docs.sparkSession.createDataFrame(list(enumerate(sorted(x[0] for x in files))), "__file long, __path string")
    placed = with_locator(docs, cols).join(F.broadcast(files), "__path")
    return placed.withColumn("__node", F.shiftleft("__file", ROW_BITS) + F.col("__row")).drop("__path", "__row", "__file")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of rows (its smallest id, a null id last), with the columns they
    came with."""
    docs = docs if is_scan(docs) else shared_table(docs, "jaccard-input")
    with _rows_per_batch(docs.sparkSession):
        found = _join(_numbered(docs, [F.col(text_col).alias("text")]).select(F.col("__node").alias("doc_id"), "text"))
    copies = shared_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__node"), "component_id"), "jaccard-copies")
    roots = copies.select(F.col("component_id").alias("__node"), "component_id").distinct()
    # joins by the row's own number: a component that a third of all rows share is no hot key
    ids = _numbered(docs, [F.col(id_col).alias("id")])
    rows = shared_table(copies.unionByName(roots).join(ids, "__node"), "jaccard-members")
    # rows without an id come last
    stay = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__node")).alias("first"))
    dropped = rows.join(stay.select("first.__node"), "__node", "left_anti").select("__node")
    dropped = shared_table(dropped, "jaccard-dropped")
    placed = _numbered(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    return anti_by_key(placed, dropped, ["__node"]).select("row.*")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS x FROM w),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(x) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n_shingles + q.n_shingles - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n_shingles, m AS component_id FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) g ON g.a = n.doc_id
"""

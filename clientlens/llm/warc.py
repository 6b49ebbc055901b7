"""WARC archives with revisit resolution.

*Resolve.* Only headers (record id, payload digest) are shuffled by digest, combined per task, so
a payload that a third of all records share is one row per task.  The response with the
smallest id of a digest stays a response; others become revisits of it, and revisits that
come with an input archive are joined to the response of their digest.  Payloads move only
where their digest occurs twice and their row may be the first of it (fixed-size bitmaps of such
digests and rows are broadcast); a revisit moves as a header.
*Write.* Records get fresh headers and are written by Spark's own text sink with the record
separator of the format (two line ends), gzipped, one task attempt at a time committed, so a
lost executor leaves no half archive.  A file holds a bounded number of records.
*Read.* Files come compressed, are inflated piece by piece and cut by Content-Length, so payloads
may hold any bytes, separators included, and one record is held at a time.

Defined results: a null payload is empty; a null id is written as ``none`` and sorts last; of
rows that share id and payload the first by place in the input is the response; payloads
of fewer than ``least`` bytes are all responses; control characters in a URL are percent-
encoded, a null URL has no header; a revisit without any response of its digest keeps its
own reference."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm.common import documents, flag_by_bitmap, key_bitmap, semi_by_key, shared_path, shared_table, with_locator

VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: RFC 4648 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 4096
SALTS = 16                  # tasks over which the records of one digest are dealt
READ, SEND = 1 << 20, 1 << 23  # bytes of a file inflated, and of payloads sent on, at once


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, 4 letters each."""
    group = lambda d, i: F.conv(F.substr(d, F.lit(i * 5 + 1), F.lit(5)), 16, 10).cast("int")
    letter = lambda v, s: F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    four = lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])
    # a lambda's variable is computed once: the payload is hashed, and a group converted, once a record
    groups = lambda d: F.array(*[group(d, i) for i in range(8)])
    return F.array_join(F.flatten(F.transform(F.array(F.sha1(payload)), lambda d: F.transform(groups(d), four))), "")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A response record per row: id, uri, payload (binary), digest, place."""
    rows = with_locator(pages, [F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"),
                                F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")])
    return rows.select("id", "uri", "payload", F.lit("response").alias("type"), sha1_base32(F.col("payload")).alias("digest"),
                       F.lit(None).cast("long").alias("refers_to"), F.struct("__path", "__row").alias("place"))


def resolve(recs: DataFrame, least: int = 0) -> DataFrame:
    """Records with ``type`` and ``refers_to`` (id of the response) settled."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    size = F.length("payload")
    head = recs.where((F.col("type") == "revisit") | (size >= least)).select("digest", "type", order.alias("o"))
    first = F.min(F.when(F.col("type") == "response", F.col("o")))
    group = shared_table(head.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"), "warc-groups")
    hit = flag_by_bitmap(recs, F.col("digest"), key_bitmap(group, F.col("digest")), "__hit")
    hit = hit.withColumn("__hit", F.col("__hit") & ((F.col("type") == "revisit") | (size >= least)))
    alone = hit.where(~F.col("__hit")).drop("__hit")
    # of the rows that may share a digest only those that may be a first one move with their payload
    place = F.struct("digest", "place")
    firsts = group.select("digest", F.col("first.place").alias("place"))
    some = flag_by_bitmap(hit.where("__hit").drop("__hit"), place, key_bitmap(firsts, place), "__first")
    first_ones = _met(some.where("__first").drop("__first"), group, order)
    again = _met(some.where("NOT __first").drop("__first").withColumn("payload", F.lit(None).cast("binary")), group, order)
    again = shared_table(again.withColumn("stray", F.col("type") == "response"), "warc-again")
    # rows that the bitmap let through though their digest is alone: their payload is fetched
    stray = semi_by_key(recs.withColumn("__place", F.struct("place")), again.where("stray").select(F.struct("place").alias("__place")), "__place").drop("__place")
    cols = ["id", "uri", "payload", "type", "digest", "refers_to", "place"]
    return alone.select(cols).unionByName(first_ones).unionByName(again.where("NOT stray").select(cols)).unionByName(stray.select(cols))


def _met(rows: DataFrame, group: DataFrame, order: Column) -> DataFrame:
    """``rows`` settled against the first response of their digest; the rows of a digest are dealt over
    SALTS tasks."""
    firsts = group.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    met = rows.withColumn("__salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "__salt"], "left")
    own = F.col("first").isNull() | ((F.col("type") == "response") & (F.col("first") == order))
    return met.select(
        "id", "uri", F.when(own, F.col("payload")).alias("payload"), F.when(own, F.col("type")).otherwise("revisit").alias("type"),
        "digest", F.when(own, F.col("refers_to")).otherwise(F.col("first.id")).alias("refers_to"), "place")


def _urn(x: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write_archive(recs: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = RECORDS_PER_FILE) -> None:
    """Write records (id, uri, payload, type, digest, refers_to) as gzipped archives."""
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    # strings here are bytes: a binary cast to string is kept as it is
    record = F.concat(
        F.lit(VERSION + CRLF), _header("WARC-Type", F.col("type")), _header("WARC-Record-ID", _urn(F.col("id"))),
        _header("WARC-Date", F.lit(date)), _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _header("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        F.lit("Content-Type: text/html" + CRLF), _header("Content-Length", F.length(body).cast("string")), F.lit(CRLF), body.cast("string"),
    )
    (recs.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


_RECORD = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()), ("type", pa.string()),
                     ("digest", pa.string()), ("refers_to", pa.int64())])


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces."""
    member, at = zlib.decompressobj(31), 0
    while at < len(data):
        piece = data[at : at + READ]
        at += len(piece)
        while piece:
            yield member.decompress(piece)
            piece = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
    yield member.flush()


def parse(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of an archive that comes in pieces, cut by Content-Length; one is held at a time."""
    pieces, data, done = iter(pieces), bytearray(), 0

    def more() -> bool:
        for piece in pieces:
            if piece:
                data.extend(piece)
                return True
        return False

    while True:
        seen = 0
        while (stop := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(data)
            if not more():
                if data:
                    raise ValueError(f"record at byte {done} is cut off")
                return
        lines = data[:stop].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {done}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        end = stop + 4 + int(head["content-length"])
        while len(data) < end + 4:
            if not more():
                raise ValueError(f"record at byte {done} is cut off")
        body = bytes(data[stop + 4 : end])
        del data[: end + 4]
        done += end + 4

        def number(name):
            text = head.get(name, "").rpartition(":")[2].rstrip(">")
            return int(text) if text.lstrip("-").isdigit() else None

        yield {"id": number("warc-record-id"), "uri": head.get("warc-target-uri"), "payload": body, "type": head["warc-type"],
               "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": number("warc-refers-to")}


def _parse(batches):
    for batch in batches:
        for content in batch.column(0):
            wait, size = [], 0
            for record in parse(inflated(content.as_py())):
                wait.append(record)
                size += len(record["payload"])
                if size >= SEND or len(wait) == 1024:
                    yield pa.RecordBatch.from_pylist(wait, schema=_RECORD)
                    wait, size = [], 0
            if wait:
                yield pa.RecordBatch.from_pylist(wait, schema=_RECORD)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``; a revisit's payload is empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, "id long, uri string, payload binary, type string, digest string, refers_to long")


def full_sizes(recs: DataFrame) -> DataFrame:
    """Headers of records with ``payload_bytes`` of the full payload: a revisit's is that of the
    response it refers to (headers only are joined)."""
    heads = shared_table(recs.select("id", "type", "digest", "refers_to", F.length("payload").cast("long").alias("size")), "warc-heads")
    # equal digests mean equal payloads, so the digest alone finds the size, whatever the ids
    sizes = heads.where("type = 'response'").groupBy("digest").agg(F.max("size").alias("full"))
    sizes = sizes.select("digest", "full", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = heads.where("type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    again = again.join(sizes, ["digest", "salt"], "left").select("id", "type", "digest", "refers_to", F.col("full").alias("payload_bytes"))
    alone = heads.where("type <> 'revisit'").select("id", "type", "digest", "refers_to", F.col("size").alias("payload_bytes"))
    return alone.unionByName(again)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(resolve(records(documents(spark, sf_dir, "pages"))), path)
    back = full_sizes(read_archive(spark, path))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                       F.col("type").alias("record_type"), "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, b, sha1(b) AS h FROM p),
x AS (SELECT *, list_reduce(list_prepend('', list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    ((CAST(concat('0x', substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT)) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1))), lambda a, c: concat(a, c)) AS e FROM d),
g AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS f FROM x)
SELECT page_id, n AS payload_bytes, e AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM g
"""

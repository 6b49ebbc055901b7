"""WARC round trips with revisits, and tool-call linking."""

import base64
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from clientlens.llm import chat, warc
from clientlens.llm.common import shared_path

PAGES = [(1, "http://a/\r\nx", "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (2, None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
         (3, "z", None), (4, "z", ""), (5, "q", "é"), (None, "q", "é"), (2, None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (9, "big", "x" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def written(spark, recs, **how):
    path = shared_path(spark, "warc-test")
    warc.write_archive(recs, path, **how)
    return path


def heads(spark, path):
    return sorted(((r.id is None, r.id or 0, r.type, r.refers_to, r.payload_bytes, r.digest) for r in warc.full_sizes(warc.read_archive(spark, path)).collect()), key=str)


def want():
    out, first = [], {}
    for i, _, t in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i is None, i or 0, "revisit" if raw in first else "response", first.get(raw), len(raw), digest))
        first.setdefault(raw, i)
    return sorted(out, key=str)


def test_round_trip_and_revisits(spark, pages):
    path = written(spark, warc.resolve(warc.records(pages)))
    assert heads(spark, path) == want()
    payload = {r.id: bytes(r.payload) for r in warc.read_archive(spark, path).where("type = 'response'").collect()}
    assert payload[1] == PAGES[0][2].encode() and payload[5] == "é".encode()
    # an archive that already has revisits resolves to the same records
    again = warc.read_archive(spark, path).withColumn("place", F.struct(F.lit("").alias("__path"), F.monotonically_increasing_id().alias("__row")))
    assert heads(spark, written(spark, warc.resolve(again))) == want()


def test_small_payloads_stay_responses(spark, pages):
    got = heads(spark, written(spark, warc.resolve(warc.records(pages), least=3)))
    assert {x[2] for x in got if x[4] < 3} == {"response"} and sum(x[2] == "revisit" for x in got) == 2


def test_files_are_bounded_and_plain_warc(spark, pages):
    path = written(spark, warc.resolve(warc.records(pages.coalesce(1))), per_file=2)
    files = spark.read.format("binaryFile").load(path + "/*.gz").select("content").collect()
    assert len(files) >= 4
    texts = [gzip.decompress(bytes(f.content)) for f in files]
    assert sum(len(list(warc.parse([t]))) for t in texts) == len(PAGES)
    for f, t in zip(files, texts):  # in pieces of any size, of one member or several
        whole = list(warc.parse([t]))
        assert whole == list(warc.parse(t[i : i + 7] for i in range(0, len(t), 7))) == list(warc.parse(warc.inflated(bytes(f.content))))
        assert whole * 2 == list(warc.parse(warc.inflated(bytes(f.content) * 2)))
    assert all(t.startswith(b"WARC/1.1\r\nWARC-Type: ") and t.endswith(b"\r\n\r\n") for t in texts)
    assert b"WARC-Target-URI: http://a/%20%20x\r\n" in b"".join(texts)
    with pytest.raises(ValueError):
        list(warc.parse([texts[0][:-10]]))


def test_null_ids_and_bitmaps_that_let_all_rows_through(spark, monkeypatch):
    rows = [(None, "u", "same"), (None, "u", "same"), (None, "u", "alone"), (7, "u", "seven"), (8, "u", "seven"), (9, "u", "nine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    real = warc.key_bitmap
    for crowded in (False, True):
        if crowded:  # a bitmap whose every bit is set: all that it decides is decided by joins
            monkeypatch.setattr(warc, "key_bitmap", lambda keys, key: real(spark.range(64).select(F.col("id").alias("k")), F.col("k"), 64))
            monkeypatch.setattr(warc, "flag_by_bitmap", lambda df, key, bitmap, flag: df.withColumn(flag, F.lit(flag == "__hit")))
        got = sorted((r.id or 0, r.type, r.refers_to or 0, r.payload_bytes) for r in warc.full_sizes(warc.read_archive(spark, written(spark, warc.resolve(warc.records(pages))))).collect())
        assert sorted(x[3] for x in got) == [4, 4, 4, 5, 5, 5]
        assert sorted(x[1] for x in got) == ["response"] * 4 + ["revisit"] * 2 and (8, "revisit", 7, 5) in got


def test_no_pages(spark, pages):
    assert heads(spark, written(spark, warc.resolve(warc.records(pages.limit(0))))) == []


MESSAGES = "conv_id long, turn long, role string, content string, kind string, call_id string, tool string, arguments string, depends_on array<string>"


def linked(spark, rows):
    full = [(c, t, "r", "text", k, i, tool, args, deps) for c, t, k, i, tool, args, deps in rows]
    return {(r.conv_id, r.turn): r for r in chat.link(spark.createDataFrame(full, MESSAGES), {"f": {"x": ("integer", True), "s": ("string", False)}}).collect()}


def test_links_levels_and_schemas(spark):
    ok = '{"x": 1}'
    got = linked(spark, [
        (1, 0, "call", "a", "f", '{"s": "q", "x": 2}', []), (1, 1, "result", "a", None, None, []),
        (1, 2, "call", "b", "f", ok, ["a"]), (1, 3, "call", "c", "f", ok, ["a", "b", "b"]), (1, 4, "call", "c", "f", ok, []),
        (1, 5, "result", "zzz", None, None, []), (1, 6, "result", "a", None, None, []), (1, 7, "plain", None, None, None, []),
        (2, 0, "call", "a", "f", ok, ["b"]), (2, 1, "call", "b", "f", ok, ["a"]), (2, 2, "call", "d", "f", ok, ["b"]), (2, 3, "call", "e", "f", ok, ["none"]),
        (3, 0, "call", "p", "f", "not json", []), (3, 1, "call", "q", "f", "[1]", []), (3, 2, "call", "r", "g", ok, []),
        (3, 3, "call", "s", "f", '{"s": 5, "y": 1}', []), (3, 4, "call", "t", "f", None, []), (None, 0, "call", "a", "f", ok, []), (None, 1, "result", "a", None, None, []),
    ])
    status = {k: (r.status, r.level) for k, r in got.items()}
    assert status == {
        (1, 0): ("linked", 0), (1, 1): ("linked", 0), (1, 2): ("unanswered", 1), (1, 3): ("unanswered", 2), (1, 4): ("repeated", None),
        (1, 5): ("orphan", None), (1, 6): ("repeated", None), (1, 7): ("plain", None), (2, 0): ("unanswered", None), (2, 1): ("unanswered", None),
        (2, 2): ("unanswered", None), (2, 3): ("unanswered", 0), (3, 0): ("unanswered", 0), (3, 1): ("unanswered", 0), (3, 2): ("unanswered", 0),
        (3, 3): ("unanswered", 0), (3, 4): ("unanswered", 0), (None, 0): ("linked", 0), (None, 1): ("linked", 0)}
    errors = {k: r.errors for k, r in got.items() if r.errors}
    assert errors == {
        (2, 0): ["depends_on: cycle"], (2, 1): ["depends_on: cycle"], (2, 2): ["depends_on: cycle"], (2, 3): ["depends_on: unknown none"],
        (3, 0): ["arguments: not JSON"], (3, 1): ["arguments: not an object", "x: missing"], (3, 2): ["tool: unknown"],
        (3, 3): ["x: missing", "s: not string", "y: not in the schema"], (3, 4): ["arguments: not JSON"]}
    assert got[1, 0].json == '{"call":{"arguments":{"s":"q","x":2},"id":"a","name":"f"},"conversation":1,"role":"r","turn":0}'
    assert all(r.valid == (not r.errors) for r in got.values() if r.kind == "call")


def test_levels_of_long_chains_joins_and_cycles(spark):
    import random

    r, deps = random.Random(4), {}
    deps.update({f"c{i}": [f"c{i - 1}"] if i else [] for i in range(100)})           # a chain
    deps.update({f"d{i:02d}": r.sample([f"d{k:02d}" for k in range(i)], min(i, r.randrange(4))) for i in range(40)})
    deps.update({"x": ["y"], "y": ["z"], "z": ["x"], "w": ["x"], "v": ["w", "c5"], "u": ["v"], "self": ["self"], "k": ["c99", "d39", "c3"], "l": ["k"]})
    calls = spark.createDataFrame([("s", k, v) for k, v in deps.items()] + [("t", "c1", ["c0"])], "scope string, call_id string, depends_on array<string>")
    want, todo = {}, dict(deps)
    while ready := [k for k, v in todo.items() if all(x in want for x in v)]:
        want.update({k: max((want[x] + 1 for x in todo[k]), default=0) for k in ready})
        todo = {k: v for k, v in todo.items() if k not in ready}
    got = {(x.scope, x.call_id): x.level for x in chat.levels(calls).collect()}
    assert got == {**{("s", k): v for k, v in want.items()}, ("t", "c1"): 0}


def test_numbers_and_columns_with_clashing_names(spark):
    rows = [(1, i, "r", "t", "call", f"c{i}", "f", a, []) for i, a in enumerate(['{"x":3}', '{"x":1e10}', '{"x":2.5}', '{"x":"3"}', '{"x":true}'])]
    m = spark.createDataFrame(rows, MESSAGES)
    for c in ("level", "s", "lost", "row", "scope", "f", "need", "status", "errors", "call_row"):
        m = m.withColumn(c, F.lit("mine"))
    got = sorted((r.turn, r.valid) for r in chat.link(m, {"f": {"x": ("number", True)}}).collect())
    assert got == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_turns_are_canonical_json(spark):
    turns = spark.createDataFrame([(1, 0, "user", 'é "x"\n😀'), (1, 1, "assistant", None), (1, 2, "user", ""), (None, 0, "system", "s"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")],
                                  "conv_id long, turn long, role string, text string")
    rows = chat.link(chat.from_turns(turns)).collect()
    assert len(rows) == 6
    for r in rows:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert sorted(r.status for r in rows) == ["linked", "linked", "orphan", "plain", "repeated", "unanswered"]
    assert chat.link(chat.from_turns(turns.limit(0))).count() == 0


def test_a_payload_is_hashed_once_in_its_digest(spark, pages):
    own = pages.select(F.coalesce(F.col("html"), F.lit("")).alias("html"), warc.sha1_base32(F.coalesce(F.col("html").cast("binary"), F.lit(b""))).alias("d"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("sha1(") == 1
    assert all(r.d == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode() for r in own.collect())

"""Byte-level BPE against the tiktoken library, and token counts against brute force."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clientlens.llm import bpe, token_counts
from tests.llm.conftest import HARD


@pytest.fixture(scope="session")
def ranks(spark):
    return bpe.default_ranks(spark)


@pytest.fixture(scope="session")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def encoder(ranks):
    return bpe.Encoder(ranks)


def encoded(encoder, texts):
    out = []
    for ids, count in encoder.texts(texts):
        at = 0
        for n in count.tolist():
            out.append(ids[at : at + n].tolist())
            at += n
    return out


ALPHABET = st.sampled_from(list("ab'stremvldLN  \n\t\r12,.!é中\x1c\x85  　٣Ⅷ😀'’"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8))
def test_split_and_merge_equal_the_library(encoder, library, texts):
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text(encoder, library, text):
    # code points without a category in one Unicode version or the other are left out
    import unicodedata

    text = "".join(c for c in text if unicodedata.category(c) not in ("Cn", "Cs"))
    assert encoded(encoder, [text]) == [library.encode_ordinary(text)]


def test_long_runs(encoder, library):
    texts = ["a" * 4000, "'" * 999, " " * 700, "abc" * 900 + "'ll", "\n" * 300 + "x", "é" * 1500, "12" * 700, ""]
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_over_blocks_equals_a_loop():
    r = np.random.default_rng(0)
    gens, _, apply = bpe._monoid()
    func = gens[r.integers(0, 9, 5000)]
    state, want = bpe.FRESH, []
    for f in func:
        want.append(state)
        state = apply[f, state]
    for block in (4, 7, 256):
        assert bpe._states(func, block).tolist() == want


def test_cache_limit_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "LIMIT", 5)
    monkeypatch.setattr(bpe.Encoder, "CHUNK", 50)
    texts = [f"some words here {i} and 'll there" for i in range(30)]
    assert encoded(bpe.Encoder(ranks), texts) == [library.encode_ordinary(t) for t in texts]


def test_digests_of_hard_rows(hard, ranks, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(hard, ranks).collect())
    want = []
    for i, t, _ in HARD:
        ids = library.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((i is None, i or 0, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_ids_as_arrays_and_round_trip(hard, ranks, library):
    rows = bpe.decode(bpe.encode(hard.where("doc_id in (1, 4, 10)"), ranks), ranks).withColumn("a", bpe.ids_array(F.col("ids"))).collect()
    for r in rows:
        text = bytes(r.bytes).decode()
        assert list(r.a) == library.encode_ordinary(text)


def test_offsets_equal_the_library(docs_of, ranks, library):
    texts = ["", None, "one line", "é\n😀 z\n 'll 中文字 ٣Ⅷ", "a" * 500 + " 😀😀😀", "w v " * 2000, "\U0001f9ff\u0dc5\u1d1c"]
    tokens = bpe.encode(docs_of(list(enumerate(texts))), ranks, offsets=True).cache()
    for r in tokens.collect():
        raw, ends = (texts[r.doc_id] or "").encode(), np.frombuffer(r.ends, "<i8").tolist()
        ids = np.frombuffer(r.ids, "<u4").tolist()
        starts = [0, *ends][: len(ends)]
        chars = [len(raw[:b].decode(errors="ignore")) if raw[b] & 0xC0 != 0x80 else sum(c & 0xC0 != 0x80 for c in raw[:b]) - 1 for b in starts]
        assert chars == library.decode_with_offsets(ids)[1]
        assert ends[-1:] == ([len(raw)] if raw else [])
    for first, stop in ((0, None), (2, 5), (1, 1), (-3, None), (4, 2), (10**6, None)):
        for r in bpe.decode(tokens, ranks, first, stop).collect():
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert bytes(r.bytes) == library.decode_bytes(ids[first:stop]) == (texts[r.doc_id] or "").encode()[r.start : r.end]


def test_no_rows(empty, ranks):
    assert bpe.digests(empty, ranks).count() == 0 and token_counts.token_counts(empty, ranks).count() == 0


def brute_lines(library, text):
    sections, at = [], 0
    for i, line in enumerate(text.split("\n")):
        a, at = at, at + len(line) + 1
        sections.append([str(i), a, min(at, len(text)), 0, 0])
    owner = [k for k, s in enumerate(sections) for _ in text[s[1] : s[2]].encode()]
    b = 0
    for token in library.encode_ordinary(text):
        n = len(library.decode_single_token_bytes(token))
        o, b = owner[b : b + n], b + n
        best = max(sorted(set(o)), key=lambda k: (o.count(k), -k))
        sections[best][3] += 1
        sections[best][4] += len(set(o)) > 1
    return [tuple(s) for s in sections]


def test_line_counts_equal_brute_force(docs_of, ranks, library):
    texts = ["a\n\n\n\nb c é", "", "one line", "x \n y\n", "\n\n\n", "é\n😀 z\n 'll", "w " * 3000 + "\n" + "v " * 3000]
    got = token_counts.token_counts(docs_of(list(enumerate(texts))), ranks).collect()
    for i, t in enumerate(texts):
        own = [(r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in got if r.doc_id == i]
        assert own == brute_lines(library, t)
        assert sum(x[3] for x in own) == len(library.encode_ordinary(t))


def test_given_sections_and_rules(spark, ranks):
    d = spark.createDataFrame([
        (1, "hello world foo", [("f", 0, 5), ("g", 5, 8), ("h", 8, 40)]), (2, "hello world", [("f", 6, 8)]),
        (3, None, [("f", 0, 5)]), (4, "hello", None), (5, "hello world", [("b", None, 3), ("a", 4, 2), ("o", 0, 99), ("p", 3, 8)]),
    ], "doc_id long, text string, s array<struct<name:string,start:long,end:long>>")
    out = lambda rule: {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in token_counts.token_counts(d, ranks, sections_col="s", rule=rule).collect()}
    assert out("most") == {(1, "f"): (1, 0), (1, "g"): (1, 1), (1, "h"): (1, 0), (2, "f"): (1, 1), (2, None): (1, 0),
                           (4, None): (1, 0), (5, "o"): (2, 0)}
    assert out("first")[(2, "f")] == (0, 0) and out("first")[(2, None)] == (2, 1)
    with pytest.raises(ValueError):
        token_counts.token_counts(d, ranks, rule="half")


def test_vocabulary_from_a_rank_file(spark, ranks, tmp_path):
    small = {k: v for k, v in ranks.items() if v < 300}
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in small.items()))
    assert bpe.read_ranks(spark, str(path)) == small == bpe.read_ranks(spark, f"file://{path}")

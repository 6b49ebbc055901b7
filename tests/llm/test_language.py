"""Cross parsing: automaton and lanes against a plain longest-match parse; held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from clientlens.llm import language
from clientlens.llm.common import documents


def naive_phrases(text: bytes, known: bytes) -> int:
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in known and text[at : at + 1] in known:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_longest_match_parse(seed):
    rng = random.Random(seed)
    known = bytes(rng.choices(b"abcd", k=200)) + b"xyzzy"
    texts = [bytes(rng.choices(b"abcde!", k=rng.randrange(0, 80))) + known[rng.randrange(100) :][:30] for _ in range(40)] + [b"", b"!", known]
    starts = np.cumsum([0] + [len(t) for t in texts])
    first, size, text = language.blocks(starts)
    count = language.Parser(known).phrases(np.frombuffer(b"".join(texts), np.uint8), first, size)
    assert np.bincount(text, weights=count, minlength=len(texts)).tolist() == [naive_phrases(t, known) for t in texts]


def test_automaton_knows_exactly_the_substrings():
    text = b"abracadabra abra"
    go = language.suffix_automaton(text)

    def reads(x):
        s = 0
        for c in x:
            if (s := go[s].get(c)) is None:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(reads(x) for x in subs) and len(go) <= 2 * len(text)
    assert not any(reads(x + bytes([c])) for x in subs for c in b"abrcdz " if x + bytes([c]) not in subs)


def test_long_texts_are_blocks():
    first, size, text = language.blocks(np.array([0, 2500, 2500, 2600]), 1000)
    assert size.tolist() == [1000, 1000, 500, 100] and text.tolist() == [0, 0, 0, 2] and first.tolist() == [0, 1000, 2000, 2500]


def test_query_equals_plain_version(spark):
    """The registered query's rows, recomputed text by text."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    known = language.training_texts(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    got = language.op13(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    right = held = 0
    for r in got:
        raw = rows[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        held, right = held + r.held_out, right + (r.held_out and r.lang_pred == raw.lang)
        if len(raw.text) < 600:
            plain = b" ".join(language.PLAIN[np.frombuffer(raw.text.lower().encode(), np.uint8)].tobytes().split())
            plain = (b" " if not raw.text[0].isalpha() else b"") + plain + (b" " if not raw.text[-1].isalpha() else b"")
            bits = {k: sum(naive_phrases(plain[i : i + language.BLOCK], v) for i in range(0, len(plain), language.BLOCK)) * np.log2(len(v)) / len(plain) for k, v in known.items()}
            two = sorted(bits.values())[:2]
            assert r.lang_pred == min(bits, key=lambda k: (bits[k], k)) and r.score == pytest.approx(two[1] / sum(two))
    assert right / held > 0.95


def test_training_is_bounded_and_skips_held_out_rows(docs_of):
    rows = [(i, f"text {chr(97 + i % 26) * 5} number", "s") for i in range(300)] + [(i, "copied text", "s") for i in range(300, 700)]
    known = language.training_texts(docs_of(rows), sample_docs=20, sample_bytes=100)
    assert list(known) == ["en"] and len(known["en"]) == 100
    out = docs_of([(i, "hidden words", "s") for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1])
    assert language.training_texts(out) == {}


def test_hard_rows(hard, empty, docs_of):
    got = {(r.doc_id, r.lang_pred) for r in language.predict(hard, language.training_texts(hard)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (8, "en"), (9, "en")} <= got
    assert not any(r.held_out is None for r in language.predict(hard, {}).collect())
    assert {r.lang_pred for r in language.predict(hard, {}).collect()} == {"und"}
    assert language.predict(empty, {"en": b"a"}).collect() == [] and language.training_texts(empty) == {}
    tie = language.predict(docs_of([(1, "1 2 3"), (2, "ab ab")]), {"aa": b"ab ", "bb": b"ab "}).collect()
    assert [(r.lang_pred, r.score) for r in sorted(tie)] == [("und", 0.0), ("aa", 0.5)]

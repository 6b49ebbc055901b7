"""The pipeline against a brute-force version, and every query against its oracle."""

import hashlib
import os
from collections import defaultdict

import pytest
import tiktoken

import __spark_entry__ as E
import corpus_pipeline
from clientlens.llm import bpe, mixing, queries
from clientlens.llm.common import shared_table
from clientlens.plans.compare import compare, duck
from tests.llm.test_mixing import targets
from tests.llm.test_partenum import brute, words
from tests.llm.test_rules_dedup import groups, measures

TABLES = "/root/testdata/sf0.001"
SMALL = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables not available")


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(E.queries()) and set(queries.SQL) <= set(queries.QUERIES)
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k != "pipeline") == list(range(1, 14))


@SMALL
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_oracle(spark, name):
    ok, msg = compare(queries.QUERIES[name](spark, TABLES), duck(TABLES), queries.SQL[name])
    assert ok, msg


def test_pipeline_equals_brute_force(spark, docs_of, tmp_path):
    import public_tokenizers

    rows = []
    for i in range(30):
        text = " ".join(words(12 + i, i))
        rows.append((i, text, f"s{i % 4}"))
        if i % 3 == 0:
            rows.append((100 + i, text.replace(" ", "\n ", 1), f"s{i % 4}"))  # exact, other white space
        if i % 5 == 0:
            rows.append((200 + i, text.upper() if i % 2 else text + " tail", None))  # near
    rows += [(300, "few words only", "s1"), (301, "| # " * 40, "s1"), (302, None, "s2"), (303, "again and again we say " * 9, "s0")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    def clean(t):
        n, chars, symbols, dup, repeat = measures(t)
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        upper = sum("A" <= c <= "Z" for c in t or "")
        return not (n < 10 or 100 * repeat > 20 * n or 10 * symbols > n or 100 * dup > 30 * len(lines)
                    or 2 * (t or "").count("!") > n or 2 * upper > chars or chars > 30 * n or chars < 2 * n)

    left = [r for r in rows if clean(r[1])]
    first = {min(ids) for ids in groups(left).values()}
    left = [r for r in left if r[0] in first]
    root = brute([r[:2] for r in left])
    left = [r for r in left if root[r[0]] == r[0]]
    per, order = defaultdict(int), defaultdict(list)
    for i, t, s in left:
        per[s] += len(t.split())
        order[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, t))
    goal = targets(per)
    ranks = bpe.default_ranks(spark)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for s, own in order.items():
        for e in range(mixing.REPEATS):
            at = e * per[s]
            for _, i, t in sorted(own):
                n = len(t.split())
                taken = max(0, min(n, int(goal[s]) - at))
                at += n
                if taken and 2 * taken >= n:  # whole texts only
                    ids = library.encode_ordinary(t)
                    raw = b"".join(x.to_bytes(4, "little") for x in ids)
                    want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert {r[3] for r in got} <= {hashlib.sha256(t.encode()).hexdigest() for _, t, _ in rows if t}  # every encoded text is some document's


def test_stages_keep_columns_and_survive_hard_tables(spark, hard, empty):
    for docs in (hard, empty):
        cols = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = shared_table(stage(spark, docs, ""), "stage-test")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == cols

"""File sources and sinks, policy table, and the answer templates on a small corpus."""

import os

import pytest
from pyspark.sql import functions as F

from clientlens.operators import actions, policy, retrieval
from clientlens.sources import files

CORPUS = {
    "10_notes.md": "# Notes\n\nLes métriques clés : revenu, sessions.\n\nSuivre le churn chaque semaine.",
    "31_offre.md": "# Offre ponctuelle\n\n## Quand proposer\n- client actif\n- besoin clair\n\n## Offre\nAudit d'usage.",
    "20_regles.yaml": "version: 1\npolicy:\n  prioritization: []\n",
    "ignore.txt": "not part of the corpus",
}


@pytest.fixture(scope="module")
def corpus_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "sub").mkdir()
    for i, (name, text) in enumerate(CORPUS.items()):
        target = (d / "sub" / name) if i == 0 else (d / name)
        target.write_text(text, encoding="utf-8")
    return str(d)


def test_corpus_files(spark, corpus_dir):
    c = files.corpus_files(spark, corpus_dir)
    assert sorted(r.source for r in c.collect()) == ["10_notes.md", "20_regles.yaml", "31_offre.md"]
    o = files.ordered_files(c, ["31_offre.md", "missing.md", "10_notes.md"])
    assert sorted((r.file_ord, r.source) for r in o.collect()) == [(0, "31_offre.md"), (2, "10_notes.md")]


def test_empty_corpus_is_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.corpus_files(spark, str(tmp_path))


def test_answer_template_branches(spark, corpus_dir):
    c = files.corpus_files(spark, corpus_dir)
    chunks = retrieval.chunk_paragraphs(c, "source")
    qs = spark.createDataFrame([(1, "Quand proposer une offre ponctuelle ?"), (2, "métriques churn semaine")],
                               "qid int, text string")
    top = retrieval.keyword_retrieve(qs, "qid", chunks.withColumnRenamed("source", "src"), ["src", "chunk"], k=1)
    top = top.join(chunks.withColumnRenamed("source", "src"), ["src", "chunk"])
    ans = {r.qid: r.a for r in top.select("qid", actions.answer_markdown(F.col("text"), F.col("src"), F.lit("FORT")).alias("a")).collect()}
    assert ans[1].startswith("## 1) Résumé\nVous pouvez proposer une prestation one-shot")
    assert ans[1].endswith("## 5) Confiance\nfort\n\n_Source: 31_offre.md_")
    assert ans[2].startswith("## 1) Résumé\nJe retrouve des éléments internes")


def test_revenue_source_optional(spark, tmp_path):
    assert files.read_revenue_events(spark, str(tmp_path / "absent.csv")).count() == 0
    p = tmp_path / "rev.csv"
    p.write_text("client_id,event_type,amount,event_date\nC1,one_shot,x,2025-01-02\nC1,upsell,10,2025-01-05\n")
    rows = files.read_revenue_events(spark, str(p)).collect()
    assert [r.amount for r in rows] == [None, 10.0]
    bad = tmp_path / "bad.csv"
    bad.write_text("client_id,amount\nC1,1\n")
    with pytest.raises(KeyError):
        files.read_revenue_events(spark, str(bad))


def test_rules_table_and_invalid_rule(spark, tmp_path):
    pol = policy.load_policy()
    rt = policy.rules_table(spark, pol).collect()
    assert [r.priority for r in rt] == [1, 2, 3, 4]
    p = tmp_path / "p.yaml"
    p.write_text("policy:\n  prioritization:\n    - name: a\n      priority: x\n      action: y\n      if: 'true'\n")
    with pytest.raises(ValueError, match="rule 0"):
        policy.load_policy(str(p))


def test_write_report(spark, tmp_path):
    import datetime as dt
    df = spark.createDataFrame([("C1", dt.date(2025, 1, 2))], "client_id string, d date")
    files.write_report(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert back[0].d == "2025-01-02"
    with pytest.raises(ValueError):
        files.write_report(df.where("false"), str(tmp_path / "out2"))

"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables through ``Tables`` and runs over the
whole of them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.operators import actions as act
from clientlens.operators import churn, clean, report, revenue, views
from clientlens.operators import journal as jr
from clientlens.operators import models as ml
from clientlens.operators import policy as pol
from clientlens.operators import retrieval as rt
from clientlens.operators import sketches as sk
from clientlens.operators import vectors as vec
from clientlens.operators.chunk_index import ChunkIndex
from clientlens.schemas import PLANS
from clientlens.session import materialize, work_dir
from clientlens.sources.files import RAW_SCHEMAS, read_feed, write_report, write_table
from clientlens.sources.tables import Tables
from clientlens.streaming import jobs as streams

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def build_report(t: Tables, sort: bool = False) -> DataFrame:
    return report.client_report(t.clients(), t.subscriptions(), t.usage(), sort=sort)


@query("client_report")
def q_client_report(spark, sf_dir):
    return build_report(_t(spark, sf_dir), sort=True)


@query("paid_kpis")
def q_paid_kpis(spark, sf_dir):
    return report.paid_kpis(_t(spark, sf_dir).subscriptions())


@query("usage_kpis")
def q_usage_kpis(spark, sf_dir):
    return report.usage_kpis(_t(spark, sf_dir).usage())


def build_kpi(t: Tables) -> DataFrame:
    return report.kpi_by_client(t.clients(), t.subscriptions(), t.usage())


@query("kpi_by_client")
def q_kpi_by_client(spark, sf_dir):
    return build_kpi(_t(spark, sf_dir))


@query("ml_ready_v1")
def q_ml_ready_v1(spark, sf_dir):
    return report.ml_ready_v1(build_kpi(_t(spark, sf_dir)))


@query("top_clients")
def q_top_clients(spark, sf_dir):
    return report.top_clients(build_report(_t(spark, sf_dir)), 10)


@query("revenue_by_plan")
def q_revenue_by_plan(spark, sf_dir):
    return report.revenue_by_plan(build_report(_t(spark, sf_dir)))


# ------------------------------------------------------------------ churn


def build_churn_ready(t: Tables) -> DataFrame:
    return churn.require_coverage(churn.churn_ready(build_report(t), t.subscriptions()), t.subscriptions())


@query("pre_t_features")
def q_pre_t_features(spark, sf_dir):
    return churn.pre_t_features(_t(spark, sf_dir).subscriptions())


@query("churn_label")
def q_churn_label(spark, sf_dir):
    return churn.churn_label(_t(spark, sf_dir).subscriptions())


@query("label_population_diff")
def q_label_population_diff(spark, sf_dir):
    return churn.label_population_diff(_t(spark, sf_dir).subscriptions())


@query("coverage_guard")
def q_coverage_guard(spark, sf_dir):
    return churn.coverage_guard(_t(spark, sf_dir).subscriptions())


@query("churn_ready")
def q_churn_ready(spark, sf_dir):
    return build_churn_ready(_t(spark, sf_dir))


@query("reference_date")
def q_reference_date(spark, sf_dir):
    return churn.reference_date(build_report(_t(spark, sf_dir)))


@query("serving_features")
def q_serving_features(spark, sf_dir):
    return churn.serving_features(build_report(_t(spark, sf_dir)))


@query("temporal_split")
def q_temporal_split(spark, sf_dir):
    return churn.temporal_split(build_churn_ready(_t(spark, sf_dir))).withColumnRenamed("_pos", "position")


@query("ml_ready")
def q_ml_ready(spark, sf_dir):
    return report.ml_ready(build_report(_t(spark, sf_dir)))


@query("churn_rule_summary")
def q_churn_rule_summary(spark, sf_dir):
    return report.churn_rule_summary(build_report(_t(spark, sf_dir)))


@query("churn_rule_list")
def q_churn_rule_list(spark, sf_dir):
    return report.churn_rule_list(build_report(_t(spark, sf_dir)))


@query("churn_distribution")
def q_churn_distribution(spark, sf_dir):
    from pyspark.sql import functions as F
    return build_churn_ready(_t(spark, sf_dir)).groupBy("churn_7_30j").agg(F.count(F.lit(1)).alias("n_clients"))


# ------------------------------------------------------------------ views


def _cr(spark, sf_dir):
    return build_churn_ready(_t(spark, sf_dir))


for _name, _fn in {
    "watchlist": views.watchlist,
    "at_risk_inactive": views.at_risk_inactive,
    "at_risk_low_history": views.at_risk_low_history,
    "at_risk_union": views.at_risk_union,
    "health_overview": views.health_overview,
    "plan_distribution": views.plan_distribution,
    "segment_facts": views.segment_facts,
    "plan_medians": views.plan_medians,
    "percentile_in_plan": views.percentile_in_plan,
    "client_comparison": views.client_comparison,
    "client_signals": views.client_signals,
    "client_fact_sheet": views.client_fact_sheet,
    "guided_reading": views.guided_reading,
}.items():
    QUERIES[_name] = (lambda f: (lambda spark, sf_dir: f(_cr(spark, sf_dir))))(_fn)


@query("plan_choices")
def q_plan_choices(spark, sf_dir):
    """The plan filter's choices (distinct non-null plans)."""
    return views.plan_choices(_cr(spark, sf_dir))


@query("ca_quantile")
def q_ca_quantile(spark, sf_dir):
    return views.ca_quantile(build_report(_t(spark, sf_dir)))


@query("dedup_first")
def q_dedup_first(spark, sf_dir):
    """First payment per client (earliest date, payment id breaks ties)."""
    s = _t(spark, sf_dir).subscriptions()
    return views.dedup_first(
        s.withColumn("montant", s["montant"].cast("double")), "client_id", ["date_paiement", "payment_id"]
    )


# ------------------------------------------------- revenue, policy, decisions


def fixed_scores(report_df: DataFrame, *keep) -> DataFrame:
    """Deterministic stand-in for model output (one score per report client) so the
    decision logic gets an exact oracle; the model-driven run is ``agent_batch``."""
    cid = F.col("client_id")
    p = F.when(cid % 17 == 0, F.lit(None).cast("double")).otherwise(((cid * 37) % 100).cast("double") / 100)
    return report_df.select("client_id", *keep, p.alias("churn_probability")).withColumn(
        "churn", F.col("churn_probability") > 0.5
    )


def build_rule_features(t: Tables, scores: DataFrame | None = None, rep: DataFrame | None = None) -> DataFrame:
    rep = rep if rep is not None else build_report(t)
    ev = t.revenue_events()
    ref = ev.agg(F.max("event_date").alias("ref_date"))
    thr = views.ca_quantile(rep)
    sc = fixed_scores(rep) if scores is None else scores
    return pol.rule_features(rep, sc, revenue.revenue_summary(ev), thr, ref, pol.load_policy())


def build_decisions(t: Tables, scores: DataFrame | None = None, rep: DataFrame | None = None) -> DataFrame:
    feats = build_rule_features(t, scores, rep)
    return pol.decide_action(pol.apply_policy(feats, pol.load_policy()))


@query("revenue_summary")
def q_revenue_summary(spark, sf_dir):
    s = revenue.revenue_summary(_t(spark, sf_dir).revenue_events())
    return s.select("client_id", "total_amount", "events_count", revenue.types_text().alias("types"),
                    "most_recent_date")


@query("revenue_type_counts")
def q_revenue_type_counts(spark, sf_dir):
    return revenue.revenue_type_counts(_t(spark, sf_dir).revenue_events())


@query("risk_bucket")
def q_risk_bucket(spark, sf_dir):
    s = fixed_scores(build_report(_t(spark, sf_dir)))
    return s.select("client_id", "churn_probability", "churn",
                    pol.risk_bucket(F.col("churn_probability"), F.col("churn"), pol.load_policy()).alias("churn_risk"))


@query("rule_features")
def q_rule_features(spark, sf_dir):
    return build_rule_features(_t(spark, sf_dir)).select(
        "client_id", "churn_risk", "usage_level", "ca_total_high", "recent_one_shot")


@query("apply_policy")
def q_apply_policy(spark, sf_dir):
    f = pol.apply_policy(build_rule_features(_t(spark, sf_dir)), pol.load_policy())
    return f.select("client_id", F.col("rule.name").alias("rule_name"), F.col("rule.priority").alias("rule_priority"))


@query("decide_action")
def q_decide_action(spark, sf_dir):
    d = build_decisions(_t(spark, sf_dir))
    return d.select("client_id", "action", "priority", F.array_join("rationale", " | ").alias("rationale"),
                    "confidence", F.array_join("missing_data", " | ").alias("missing_data"))


@query("action_mix")
def q_action_mix(spark, sf_dir):
    return pol.action_mix(build_decisions(_t(spark, sf_dir)))


# ------------------------------------------------------------- retrieval


def build_para_chunks(t: Tables) -> DataFrame:
    return rt.chunk_paragraphs(t.documents.select("doc_id", "text"), "doc_id")


@query("chunk_fixed")
def q_chunk_fixed(spark, sf_dir):
    return rt.chunk_fixed(_t(spark, sf_dir).documents.select("doc_id", "text"), "doc_id")


@query("chunk_paragraphs")
def q_chunk_paragraphs(spark, sf_dir):
    return build_para_chunks(_t(spark, sf_dir))


@query("tokenize_docs")
def q_tokenize_docs(spark, sf_dir):
    return rt.token_frequencies(_t(spark, sf_dir).documents.select("doc_id", "text"), ["doc_id"])


def build_keyword_hits(t: Tables, k: int = 5) -> DataFrame:
    return rt.keyword_retrieve(t.benchmark.select("item_id", "text"), "item_id",
                               build_para_chunks(t).withColumnRenamed("source", "doc_id"), ["doc_id", "chunk"], k=k)


def with_chunk_texts(t: Tables, hits: DataFrame) -> DataFrame:
    """``hits`` (doc_id, chunk, ...; some per question) with the text of their chunks: only documents
    that hold a hit are chunked again, and the retrieval runs once."""
    hits = materialize(hits)
    docs = t.documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = rt.chunk_paragraphs(docs, "doc_id").withColumnRenamed("source", "doc_id")
    return hits.join(chunks, ["doc_id", "chunk"])


@query("keyword_retrieve")
def q_keyword_retrieve(spark, sf_dir):
    return build_keyword_hits(_t(spark, sf_dir))


@query("vector_topk")
def q_vector_topk(spark, sf_dir):
    emb = _t(spark, sf_dir).embeddings
    qs = rt.label_centroids(emb).withColumnRenamed("label", "query_label")
    top = rt.vector_topk(qs, "query_label", emb, "vec_id", k=4)
    return top.select("query_label", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("vector_neighbors")
def q_vector_neighbors(spark, sf_dir):
    """R7 as a search: every row whose id is divisible by 50 against all rows, through the pivot index."""
    emb = _t(spark, sf_dir).embeddings
    qs = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    top = vec.PivotIndex.build(emb, "vec_id").topk(qs, "query_id", k=4)
    return top.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("signal_queries")
def q_signal_queries(spark, sf_dir):
    sig = views.client_signals(_cr(spark, sf_dir))
    return sig.select("client_id", rt.signal_query_text(F.lit("client"), F.col("plan"), F.col("ville"),
                                                        F.col("inactivity_high"), F.col("history_low")).alias("query"))


@query("rag_context_block")
def q_rag_context_block(spark, sf_dir):
    """Context block over the top-4 keyword hits of every benchmark question."""
    t = _t(spark, sf_dir)
    hits = with_chunk_texts(t, build_keyword_hits(t, 4))
    hits = hits.select("item_id", "rank", F.col("doc_id").cast("string").alias("source"), "chunk",
                       F.lit(None).cast("double").alias("distance"), "text")
    return rt.context_block(hits, "item_id")


# --------------------------------------------------------------- cleaning
@query("clean_clients")
def q_clean_clients(spark, sf_dir):
    return clean.clean_clients(_t(spark, sf_dir).raw_clients())


@query("clean_subscriptions")
def q_clean_subscriptions(spark, sf_dir):
    c = clean.clean_subscriptions(_t(spark, sf_dir).raw_subscriptions())
    return c.withColumn("montant", F.col("montant").cast("double"))


@query("clean_usage")
def q_clean_usage(spark, sf_dir):
    return clean.clean_usage(_t(spark, sf_dir).raw_usage())


@query("clean_clients_dedup")
def q_clean_clients_dedup(spark, sf_dir):
    return clean.clean_clients_dedup(_t(spark, sf_dir).raw_clients())


@query("clean_rejects")
def q_clean_rejects(spark, sf_dir):
    t = _t(spark, sf_dir)
    return clean.clean_rejects(t.raw_clients(), t.raw_subscriptions(), t.raw_usage())


# ------------------------------------------------------------------ models

def _tag(sf_dir: str) -> str:
    """Names what belongs to these tables."""
    return hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:12]


def model_store(spark, sf_dir) -> ml.ModelStore:
    return ml.ModelStore(spark, f"{work_dir(spark)}/models-{_tag(sf_dir)}")


def _train(spark, sf_dir, kind):
    """The training job: fits on the tables as they are and saves the model as the current version."""
    t = _t(spark, sf_dir)
    data = build_churn_ready(t) if kind == "churn" else report.ml_ready(build_report(t))
    res = ml.train_churn(data) if kind == "churn" else ml.train_revenue(data, kind)
    model_store(spark, sf_dir).save(kind, res[0], data)
    return res


def _trained(spark, sf_dir, kind) -> ml.ModelStore:
    """The store with a current model: scoring doesn't train where one was saved; the queries here
    train one if there is none, so that none depends on which ran before it."""
    store = model_store(spark, sf_dir)
    if not store.has(kind):
        _train(spark, sf_dir, kind)
    return store


def _saved(spark, sf_dir, kind):
    """The current model, pinned: a version saved meanwhile doesn't change the job."""
    return _trained(spark, sf_dir, kind).load(kind)[0]


def fixed_revenue_predictions(t: Tables) -> DataFrame:
    m = report.ml_ready(build_report(t))
    return m.select("client_id", F.col("ca_total").alias("actual"),
                    (F.col("ca_total") + ((F.col("client_id") * 13) % 101).cast("double") - 50).alias("prediction"))


def fixed_churn_predictions(t: Tables) -> DataFrame:
    """Every client of the churn table with its label and the fixed score's hard class
    (a missing score predicts no churn)."""
    sc = fixed_scores(build_churn_ready(t), F.col("churn_7_30j").alias("actual"))
    return sc.select("client_id", "actual", F.coalesce(F.col("churn"), F.lit(False)).cast("int").alias("prediction"))


@query("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    return ml.regression_metrics(fixed_revenue_predictions(_t(spark, sf_dir)))


@query("residuals")
def q_residuals(spark, sf_dir):
    return ml.residuals(fixed_revenue_predictions(_t(spark, sf_dir)))


@query("churn_metrics")
def q_churn_metrics(spark, sf_dir):
    return ml.churn_metrics(fixed_churn_predictions(_t(spark, sf_dir)))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return ml.classification_report(fixed_churn_predictions(_t(spark, sf_dir)))


@query("train_revenue_linear")
def q_train_revenue_linear(spark, sf_dir):
    return _train(spark, sf_dir, "linear")[2]


@query("train_revenue_rf")
def q_train_revenue_rf(spark, sf_dir):
    return _train(spark, sf_dir, "rf")[2]


@query("train_churn")
def q_train_churn(spark, sf_dir):
    """Churn metrics snapshot of the trained model on its temporal test split."""
    model, test_pred, split = _train(spark, sf_dir, "churn")
    m = ml.churn_metrics(test_pred)
    counts = split.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.sum((F.col("split") == "train").cast("long")).alias("n_train"),
                       F.sum((F.col("split") == "test").cast("long")).alias("n_test"))
    rep = ml.classification_report(test_pred)
    rep = rep.agg(F.array_sort(F.collect_list(F.struct(*rep.columns))).alias("classification_report"))  # five rows
    snap = materialize(counts.crossJoin(m).crossJoin(rep).select(
        "n_rows", "n_train", "n_test", F.lit(ml.CHURN_TARGET).alias("target"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"), "precision", "recall",
        "classification_report"))
    ml.write_metrics_json(snap, f"{work_dir(spark)}/metrics/churn_metrics_v1")
    return snap


@query("score_revenue")
def q_score_revenue(spark, sf_dir):
    model, version = _trained(spark, sf_dir, "rf").load("rf")
    return ml.score_revenue(model, report.ml_ready(build_report(_t(spark, sf_dir)))).withColumn("model_version", F.lit(version))


@query("score_churn")
def q_score_churn(spark, sf_dir):
    model, version = _trained(spark, sf_dir, "churn").load("churn")
    return ml.score_churn(model, build_churn_ready(_t(spark, sf_dir))).withColumn("model_version", F.lit(version))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return ml.feature_importance(_trained(spark, sf_dir, "rf").weights("rf"))


@query("churn_coefficients")
def q_churn_coefficients(spark, sf_dir):
    return ml.churn_coefficients(_trained(spark, sf_dir, "churn").weights("churn"))


@query("feature_weights")
def q_feature_weights(spark, sf_dir):
    return ml.feature_weights(q_churn_coefficients(spark, sf_dir))


def metrics_runs(spark, sf_dir) -> DataFrame:
    """The history of this table set's regression metrics, this run's rows added once (a
    run is its tables, model and results)."""
    rows = _train(spark, sf_dir, "linear")[2].unionByName(_train(spark, sf_dir, "rf")[2])
    key = F.sha2(F.to_json(F.struct(F.lit(sf_dir), *[c for c in rows.columns if c != "run_ts"])), 256)
    return ml.append_runs(spark, rows.withColumn("run_id", key), f"{work_dir(spark)}/tables/metrics_history-{_tag(sf_dir)}")


@query("metrics_history")
def q_metrics_history(spark, sf_dir):
    return metrics_runs(spark, sf_dir)


@query("latest_run")
def q_latest_run(spark, sf_dir):
    return ml.latest_run(metrics_runs(spark, sf_dir))


# ----------------------------------------------- agent, actions, journal


@query("agent_features")
def q_agent_features(spark, sf_dir):
    t = _t(spark, sf_dir)
    rep = build_report(t)
    return act.agent_features(rep, revenue.revenue_summary(t.revenue_events()),
                              fixed_scores(rep).where(F.col("churn_probability").isNotNull()))


def _decided(spark, sf_dir):
    return build_decisions(_t(spark, sf_dir))


@query("prepare_email")
def q_prepare_email(spark, sf_dir):
    return _decided(spark, sf_dir).select("client_id", act.email_text().alias("email"))


@query("prepare_checklist")
def q_prepare_checklist(spark, sf_dir):
    return _decided(spark, sf_dir).select("client_id", F.array_join(act.checklist(), "\n").alias("checklist"))


@query("prepared_actions")
def q_prepared_actions(spark, sf_dir):
    kind, payload = act.prepared_action()
    return _decided(spark, sf_dir).select("client_id", "action", kind.alias("type"), payload.alias("payload"))


@query("answer_batch")
def q_answer_batch(spark, sf_dir):
    """Answer per benchmark question from its best keyword hit (no client: confidence 'moyen')."""
    t = _t(spark, sf_dir)
    top = with_chunk_texts(t, build_keyword_hits(t, 1))
    q = t.benchmark.select("item_id").join(top, "item_id", "left")
    return q.select("item_id", act.answer_markdown(F.col("text"), F.col("doc_id").cast("string"),
                                                  F.lit("moyen")).alias("answer_md"))


@query("client_lookup")
def q_client_lookup(spark, sf_dir):
    """Batch stats lookup: every customer key against the report; unmatched -> found=false."""
    t = _t(spark, sf_dir)
    ids = t.customer.select(F.trim(F.col("c_custkey").cast("string")).cast("long").alias("client_id"))
    rep = build_report(t).withColumn("_found", F.lit(True))
    j = ids.join(rep, "client_id", "left")
    return j.select(
        "client_id", F.coalesce("_found", F.lit(False)).alias("found"),
        F.nullif(F.trim("plan"), F.lit("")).alias("plan"), F.nullif(F.trim("ville"), F.lit("")).alias("ville"),
        F.coalesce("ca_total", F.lit(0.0)).alias("ca_total"),
        F.coalesce("nb_paiements", F.lit(0).cast("long")).alias("nb_paiements"),
        F.coalesce("actions_total", F.lit(0).cast("long")).alias("actions_total"),
        F.coalesce("sessions_total", F.lit(0).cast("long")).alias("sessions_total"),
        "last_activity_date", "last_payment_date",
    )


def validate_requests(req: DataFrame) -> DataFrame:
    """Request checks (counts, sums, days >= 0; plan enum; ville non-empty)."""
    reason = (
        F.when(F.col("paid_count_before_T").isNull() | (F.col("paid_count_before_T") < 0), F.lit("paid_count_before_T"))
        .when(F.col("paid_sum_before_T").isNull() | (F.col("paid_sum_before_T") < 0), F.lit("paid_sum_before_T"))
        .when(F.col("days_since_last_paid").isNull() | (F.col("days_since_last_paid") < 0), F.lit("days_since_last_paid"))
        .when(~F.coalesce(F.col("plan").isin(*PLANS), F.lit(False)), F.lit("plan"))
        .when(F.coalesce(F.length("ville"), F.lit(0)) < 1, F.lit("ville"))
    )
    return req.withColumn("reason", reason)


@query("score_requests_valid")
def q_score_requests_valid(spark, sf_dir):
    v = validate_requests(churn.serving_features(build_report(_t(spark, sf_dir))))
    return v.select("client_id", F.col("reason").isNull().alias("valid"), "reason")


@query("journal_validate")
def q_journal_validate(spark, sf_dir):
    return jr.journal_validate(_t(spark, sf_dir).decision_feed())


@query("journal_view")
def q_journal_view(spark, sf_dir):
    v = jr.journal_validate(_t(spark, sf_dir).decision_feed()).where(F.col("reason").isNull()).drop("reason")
    return jr.journal_view(v, scope_type="client")


@query("journal_append")
def q_journal_append(spark, sf_dir):
    path = f"{work_dir(spark)}/tables/decision_log-{_tag(sf_dir)}"
    jr.journal_append(_t(spark, sf_dir).decision_feed(), path)
    return jr.journal_view(jr.read_journal(spark, path))


@query("agent_batch")
def q_agent_batch(spark, sf_dir, question: str = "Comment sécuriser la relation client ?"):
    """End-to-end next best action for every client from the trained churn model,
    with the internal retrieval context of its prepared action."""
    t = _t(spark, sf_dir)
    rep = build_report(t)
    model = _saved(spark, sf_dir, "churn")
    valid = validate_requests(churn.serving_features(rep)).where("reason IS NULL").drop("reason")
    dec = build_decisions(t, ml.score_churn(model, valid), rep)
    kind, payload = act.prepared_action()
    out = dec.select("client_id", "plan", "churn_risk", "usage_level", "action", "priority", "confidence",
                     kind.alias("type"), payload.alias("payload"))
    tag = F.when(F.col("type") == "email", F.lit(CONTEXT_EMAIL)).when(F.col("type") == "call_plan", F.lit(CONTEXT_CALL))
    ctx = build_rag_contexts(t, question)  # one row per context tag: broadcast is size-bounded
    return out.withColumn("context_docs", tag).join(F.broadcast(ctx), "context_docs", "left").select(
        *out.columns, F.coalesce("internal_context", F.lit("")).alias("internal_context"))


def build_rag_hits(t: Tables, questions: DataFrame, k: int = 4) -> DataFrame:
    """Vector retrieval of (question_id, text) over fixed chunks of the documents:
    exact nearest hashed vectors, every chunk scored in its own task."""
    chunks = rt.chunk_fixed(t.documents.select("doc_id", "text"), "doc_id")
    top = vec.nearest_texts(questions, "question_id", chunks, "id", k=k)
    return rt.rag_hits(top.select("question_id", "rank", F.col("source").cast("string").alias("source"), "chunk", "distance", "text"))


# fixed values: the context tags prefixed to the retrieval question per prepared action
CONTEXT_EMAIL = "docs_corpus/retention"
CONTEXT_CALL = "docs_corpus/sales"


def build_rag_contexts(t: Tables, question: str) -> DataFrame:
    """(context_docs, internal_context) for the question under each context tag."""
    if not (question or "").strip():
        raise ValueError("question is empty")
    q = t.spark.createDataFrame(
        [(0, CONTEXT_EMAIL, f"[{CONTEXT_EMAIL}] {question}"), (1, CONTEXT_CALL, f"[{CONTEXT_CALL}] {question}")],
        "question_id int, context_docs string, text string")
    ctx = rt.context_block(build_rag_hits(t, q.select("question_id", "text")), "question_id")
    return q.join(ctx, "question_id", "left").select(
        "context_docs", F.coalesce("context", F.lit("")).alias("internal_context"))


@query("embed_chunks")
def q_embed_chunks(spark, sf_dir):
    return vec.hashed_embedding(rt.chunk_fixed(_t(spark, sf_dir).documents.select("doc_id", "text"), "doc_id"))


@query("chunk_index")
def q_chunk_index(spark, sf_dir):
    """Bring the chunk index of these tables up to date and read it back."""
    index = ChunkIndex(spark, f"{work_dir(spark)}/tables/chunk_index-{_tag(sf_dir)}")
    index.build(rt.chunk_fixed(_t(spark, sf_dir).documents.select("doc_id", "text"), "doc_id"))
    return index.read()


@query("rag_hits")
def q_rag_hits(spark, sf_dir):
    t = _t(spark, sf_dir)
    return build_rag_hits(t, t.benchmark.select(F.col("item_id").alias("question_id"), "text"))


# --------------------------------------------------------------- streams


def _run_dir(spark, name):
    return f"{work_dir(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"


@query("stream_score")
def q_stream_score(spark, sf_dir):
    """Serving requests land as parquet files; the stream validates, scores and appends them."""
    t = _t(spark, sf_dir)
    base = _run_dir(spark, "score")
    req = churn.serving_features(build_report(t)).select(
        "client_id", "paid_count_before_T", "paid_sum_before_T",
        F.col("days_since_last_paid").cast("int").alias("days_since_last_paid"), "plan", "ville")
    req.write.mode("append").parquet(f"{base}/landing")
    model = _saved(spark, sf_dir, "churn")
    q = streams.stream_score(spark, f"{base}/landing", f"{base}/out", f"{base}/chk", model, validate_requests,
                             pol.load_policy())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_journal")
def q_stream_journal(spark, sf_dir):
    t = _t(spark, sf_dir)
    base = _run_dir(spark, "journal")
    t.decision_feed().write.mode("append").parquet(f"{base}/landing")
    q = streams.stream_journal(spark, f"{base}/landing", f"{base}/journal", f"{base}/rejects", f"{base}/chk")
    q.awaitTermination()
    return jr.journal_view(jr.read_journal(spark, f"{base}/journal"))


@query("signal_retrieve")
def q_signal_retrieve(spark, sf_dir):
    """Guided-exploration context for every client: retrieval runs once per distinct
    signal query text (few: plans x villes x signals), then joins back to clients."""
    t = _t(spark, sf_dir)
    sq = q_signal_queries(spark, sf_dir)
    distinct_q = sq.select("query").distinct().withColumn("qid", F.xxhash64("query"))
    hits = rt.keyword_retrieve(distinct_q, "qid", build_para_chunks(t).withColumnRenamed("source", "doc_id"),
                               ["doc_id", "chunk"], k=5, query_text="query")
    return sq.join(distinct_q, "query").join(hits, "qid").select("client_id", "rank", "doc_id", "chunk", "score")


@query("revenue_source")
def q_revenue_source(spark, sf_dir):
    """Revenue events exported as a header CSV feed (derived from ``events``) and
    read back through the optional-source reader (missing file -> empty, missing columns -> error)."""
    from clientlens.sources.files import read_revenue_events

    path = f"{_run_dir(spark, 'revenue_events')}/revenue_events.csv"
    ev = _t(spark, sf_dir).revenue_events().select(
        F.col("client_id").cast("string").alias("client_id"), "event_type",
        F.col("amount").cast("string").alias("amount"), F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))
    ev.write.mode("overwrite").option("header", True).csv(path)
    return read_revenue_events(spark, path)


# --------------------------------------------------------------- exports


def _export_path(spark, sf_dir, name) -> str:
    return f"{work_dir(spark)}/exports-{_tag(sf_dir)}/{name}"


@query("export_report")
def q_export_report(spark, sf_dir):
    """S3: the report written and read back, dates as text."""
    path = _export_path(spark, sf_dir, "client_report")
    write_report(build_report(_t(spark, sf_dir)), path, fmt="parquet")
    return spark.read.parquet(path)


for _name, _build in {
    "export_kpi": build_kpi,
    "export_ml_ready_v1": lambda t: report.ml_ready_v1(build_kpi(t)),
    "export_ml_ready": lambda t: report.ml_ready(build_report(t)),
    "export_churn_ready": build_churn_ready,
}.items():
    QUERIES[_name] = (lambda n, b: lambda spark, sf_dir: write_table(b(_t(spark, sf_dir)), _export_path(spark, sf_dir, n), n))(_name, _build)


# -------------------------------------------------------- further variants


@query("clean_subscriptions_lenient")
def q_clean_subscriptions_lenient(spark, sf_dir):
    return clean.clean_subscriptions(_t(spark, sf_dir).raw_subscriptions(), strict=False)


@query("clean_usage_lenient")
def q_clean_usage_lenient(spark, sf_dir):
    return clean.clean_usage(_t(spark, sf_dir).raw_usage(), strict=False)


@query("segment_queries")
def q_segment_queries(spark, sf_dir):
    """R5 in segment mode: the retrieval query of every (plan, signals) segment and its clients."""
    sig = views.client_signals(_cr(spark, sf_dir)).groupBy("plan", "inactivity_high", "history_low").agg(
        F.count(F.lit(1)).alias("n_clients"))
    return sig.select("plan", "inactivity_high", "history_low", "n_clients", rt.signal_query_text(
        F.lit("segment"), F.col("plan"), F.lit(None).cast("string"), F.col("inactivity_high"), F.col("history_low")).alias("query"))


@query("answer_clients")
def q_answer_clients(spark, sf_dir):
    """D8 with a client: each client of the report asks one benchmark question (its id modulo
    their number); the answer rests on the best vector hit and is 'fort' when the client
    has a churn score.  Answers differ by question only, so they are made once a question."""
    t = _t(spark, sf_dir)
    best = build_rag_hits(t, t.benchmark.select(F.col("item_id").alias("question_id"), "text"), 1)
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))  # one row
    asked = fixed_scores(build_report(t)).crossJoin(F.broadcast(n)).select(
        "client_id", F.expr("client_id % n").alias("question_id"), F.col("churn_probability").isNotNull().alias("scored"))
    return asked.join(best, "question_id", "left").select(
        "client_id", "question_id",
        act.answer_markdown(F.col("text"), F.col("source"), F.when(F.col("scored"), "fort").otherwise("moyen")).alias("answer_md"))


# ------------------------------------------------------ dirty feeds, sketches


def dirty_lines(t: Tables, name: str) -> DataFrame:
    """The raw feed of the tables as CSV lines with defects seeded by id: ragged records, blank and invalid
    fields, and quoted line ends (which are no defect)."""
    def line(df, key, n, fields, *changes):
        cols = [F.col(c) for c in fields]
        out = F.concat_ws(",", *cols)
        for rest, change in changes:
            out = F.when(F.col(key) % n == rest, change(dict(zip(fields, cols)), lambda d: F.concat_ws(",", *d.values()))).otherwise(out)
        return df.select(out.alias("value"))

    put = lambda c, v: lambda d, join: join({**d, c: F.lit(v)})
    short = lambda d, join: join(dict(list(d.items())[:-1]))
    long = lambda d, join: join({**d, "more": F.lit("x")})
    if name == "clients":
        raw = t.raw_clients().withColumn("k", F.col("client_id").cast("long"))
        broken = lambda d, join: join({**d, "ville": F.concat(F.lit('"'), d["ville"], F.lit('\n"'))})
        return line(raw, "k", 50, ["client_id", "ville", "plan", "date_inscription"], (1, put("ville", "")), (2, put("plan", "gold")), (3, short),
                    (4, long), (5, put("date_inscription", "2025-13-40")), (6, broken), (7, put("client_id", "")))
    if name == "subscriptions":
        raw = t.subscriptions().select(F.col("client_id").cast("string"), F.col("montant").cast("string"), F.date_format("date_paiement", "yyyy-MM-dd").alias("date_paiement"), "statut", F.col("payment_id").alias("k"))
        return line(raw, "k", 60, ["client_id", "montant", "date_paiement", "statut"], (1, put("montant", "-5")), (2, put("statut", "gratis")), (3, short), (4, put("date_paiement", "n/a")))
    raw = t.usage().select(F.col("client_id").cast("string"), F.col("actions").cast("string"), F.col("sessions").cast("string"), F.date_format("activity_date", "yyyy-MM-dd").alias("timestamp"), F.col("event_id").alias("k"))
    return line(raw, "k", 70, ["client_id", "actions", "sessions", "timestamp"], (1, put("actions", "many")), (2, put("sessions", "-1")), (3, short))


def dirty_feed(spark, sf_dir, name: str) -> DataFrame:
    path = f"{_run_dir(spark, 'feed')}/{name}"
    dirty_lines(_t(spark, sf_dir), name).write.text(path)
    return read_feed(spark, path, RAW_SCHEMAS[name], header=False)


FEEDS = ("clients", "subscriptions", "usage")


@query("feed_rejects")
def q_feed_rejects(spark, sf_dir):
    """P9 over raw feeds: every record that is not valid, with its reason and, if it does not parse, its text."""
    parts = [clean.feed_rejects(n, dirty_feed(spark, sf_dir, n)) for n in FEEDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feed_reconciliation")
def q_feed_reconciliation(spark, sf_dir):
    """Every record of a raw feed is valid or rejected, and the counts say so."""
    parts = [clean.reconciliation(n, dirty_feed(spark, sf_dir, n)) for n in FEEDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feed_clients")
def q_feed_clients(spark, sf_dir):
    """P4 through the raw reader: the valid clients of a feed with defects."""
    return clean.clean_feed("clients", dirty_feed(spark, sf_dir, "clients"))


@query("payment_range_facts")
def q_payment_range_facts(spark, sf_dir, first: str = "1995-03-01", last: str = "1997-08-31"):
    """A6/A9/A10/A13, approximate: facts of a range of days from stored daily sketches, held against the
    payments."""
    t = _t(spark, sf_dir)
    pay = t.subscriptions().where("statut = 'paid'").join(t.clients().select("client_id", "plan"), "client_id")
    table = sk.sketch_table(spark, f"{work_dir(spark)}/tables/payment_sketches-{_tag(sf_dir)}")
    table.append(sk.daily_sketches(pay))
    return sk.within_bounds(sk.range_facts(table.read(), first, last), pay, first, last)

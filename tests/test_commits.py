"""Appends by several writers, versions, the incremental chunk index, the model store, the journal stream."""

import threading

import pytest
from pyspark.sql import functions as F

from clientlens.operators import journal as jr
from clientlens.operators import models as ml
from clientlens.operators.chunk_index import ChunkIndex
from clientlens.operators.vectors import hashed_embedding
from clientlens.plans import catalog as C
from clientlens.schemas import DECISION_LOG
from clientlens.sources.commits import AppendTable, Log, Versions
from clientlens.streaming import jobs
from tests.conftest import SF_SMALL


def decisions(spark, ids, day="2025-01-01"):
    return spark.createDataFrame([(f"{day}T00:00:{i % 60:02d}", "client", str(i), "Surveiller", f"because {i}", "me") for i in ids], DECISION_LOG)


def test_claim_is_taken_once(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    won = []
    go = threading.Barrier(6)

    def run(i):
        go.wait()
        if log.claim(1, {"by": i}):
            won.append(i)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and log.entries() == [(1, {"by": won[0]})] and log.claim(2, {}) and not log.claim(1, {})


def test_two_writers_append_one_batch_once(spark, tmp_path):
    path, go, errors = str(tmp_path / "j"), threading.Barrier(2), []

    def run(ids):
        try:
            go.wait()
            jr.journal_append(decisions(spark, ids), path)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(ids,)) for ids in (range(0, 30), range(10, 40))]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors
    rows = jr.read_journal(spark, path).collect()
    assert sorted(int(r.scope_value) for r in rows) == list(range(40))


def test_append_reads_only_the_days_of_the_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "j")
    jr.journal_append(decisions(spark, range(5), "2025-01-01"), path)
    jr.journal_append(decisions(spark, range(5, 9), "2025-01-02"), path)
    asked = []
    real = AppendTable._batches
    monkeypatch.setattr(AppendTable, "_batches", lambda self, entries, parts=None: asked.append(out := real(self, entries, parts)) or out)
    jr.journal_append(decisions(spark, range(7, 12), "2025-01-02"), path)
    assert asked[0].inputFiles() and all("2025-01-02" in f for f in asked[0].inputFiles())  # the other day is not read
    assert asked[0].count() == 4
    assert jr.read_journal(spark, path).count() == 12
    jr.journal_append(decisions(spark, range(20), "2025-01-03").where("false"), path)
    assert len(jr.journal_table(spark, path).log.numbers()) == 3  # nothing new, no entry


def test_unfinished_append_is_not_read(spark, tmp_path):
    path = str(tmp_path / "j")
    jr.journal_append(decisions(spark, range(3)), path)
    decisions(spark, range(50, 60)).withColumn("__part", F.lit("=x")).write.partitionBy("__part").parquet(f"{path}/batches/__batch=lost")
    assert jr.read_journal(spark, path).count() == 3


def test_decisions_without_time_are_kept_once(spark, tmp_path):
    rows = decisions(spark, range(4)).withColumn("timestamp_iso", F.when(F.col("scope_value") < "2", F.lit("")))
    for _ in range(2):
        jr.journal_append(rows, str(tmp_path / "j"))
    assert jr.read_journal(spark, str(tmp_path / "j")).count() == 4


def test_versions_keep_the_old_one_until_the_switch(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        v.current()
    first = v.folder()
    assert v.switch(first, note="a") == 1
    v.folder()  # a build that fails
    assert v.current() == (1, {"folder": first, "note": "a"}) and v.switch("x") == 2 and v.current()[0] == 2 and v.current(1)[1]["note"] == "a"
    with pytest.raises(FileNotFoundError):
        v.current(9)


def chunks(spark, rows):
    return spark.createDataFrame([(f"{s}::chunk_{k}", s, k, t) for s, k, t in rows], "id string, source long, chunk int, text string")


def test_chunk_index_embeds_only_changed_chunks(spark, tmp_path):
    rows = [(d, k, f"text {d} {k}") for d in range(6) for k in range(3)] + [(9, 0, "text 0 0")]
    index = ChunkIndex(spark, str(tmp_path / "i"))
    one = index.build(chunks(spark, rows))
    assert (one["version"], one["chunks"], one["embedded"]) == (1, 19, 18)
    assert index.build(chunks(spark, rows))["embedded"] == 0
    rows = rows[3:] + [(7, 0, "new text"), (7, 1, "text 0 1")]
    three = index.build(chunks(spark, rows))
    assert (three["version"], three["chunks"], three["embedded"]) == (3, 18, 1)
    want = {(r.id, tuple(r.embedding)) for r in hashed_embedding(chunks(spark, rows)).collect()}
    assert {(r.id, tuple(r.embedding)) for r in index.read().collect()} == want and index.read(1).count() == 19


def test_failed_build_leaves_the_old_version(spark, tmp_path):
    good = ChunkIndex(spark, str(tmp_path / "i"))
    good.build(chunks(spark, [(1, 0, "a"), (1, 1, "b")]))

    def broken(df):
        return df.withColumn("embedding", F.raise_error(F.lit("no model")).cast("array<float>"))

    with pytest.raises(Exception, match="no model"):
        ChunkIndex(spark, str(tmp_path / "i"), broken).build(chunks(spark, [(2, 0, "c")]))
    assert sorted(r.id for r in good.read().collect()) == ["1::chunk_0", "1::chunk_1"]


def test_model_store_versions(spark, tmp_path):
    data = C.report.ml_ready(C.build_report(C._t(spark, SF_SMALL)))
    model, pred, _ = ml.train_revenue(data, "linear")
    store = ml.ModelStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.load("linear")
    assert store.save("linear", model, data) == 1
    pinned, number = store.load("linear")
    assert store.save("linear", model, data, current=False) is None and store.load("linear")[1] == number == 1
    assert store.save("linear", model, data) == 2 and store.load("linear")[1] == 2 and store.load("linear", 1)[1] == 1
    # the pinned version still scores, and its weights give the same numbers
    w = {r.feature: r.weight for r in store.weights("linear", 1).collect()}
    assert "(intercept)" in w and len(w) == pinned.stages[-1].coefficients.size + 1
    assert {(r.client_id, round(r.pred_ca_total, 6)) for r in ml.score_revenue(pinned, data).collect()} == {
        (r.client_id, round(r.pred_ca_total, 6)) for r in ml.score_revenue(model, data).collect()}


def test_scoring_does_not_train_again(spark, monkeypatch):
    C.QUERIES["score_churn"](spark, SF_SMALL)
    monkeypatch.setattr(C, "_train", lambda *a: pytest.fail("trained"))
    for name in ("score_churn", "churn_coefficients", "feature_weights"):
        assert C.QUERIES[name](spark, SF_SMALL).count() > 0
    assert {r.model_version for r in C.QUERIES["score_churn"](spark, SF_SMALL).select("model_version").distinct().collect()} >= {1}


def test_weights_reproduce_the_scores(spark):
    """The saved weights, applied in SQL to the encoded columns, give the model's probabilities."""
    store = C._trained(spark, SF_SMALL, "churn")
    w = {r.feature: r.weight for r in store.weights("churn").collect()}
    rows = C.build_churn_ready(C._t(spark, SF_SMALL))
    z = F.lit(w["(intercept)"])
    for c in ml.CHURN_NUM:
        z = z + F.col(c) * F.lit(w[c])
    for c in ml.CHURN_CAT:
        for name, value in w.items():
            if name.startswith(f"{c}_"):
                z = z + F.when(F.col(c) == name[len(c) + 1 :], F.lit(value)).otherwise(0.0)
    by_hand = {r.client_id: r.p for r in rows.select("client_id", (1 / (1 + F.exp(-z))).alias("p")).collect()}
    got = {r.client_id: r.churn_probability for r in C.QUERIES["score_churn"](spark, SF_SMALL).collect()}
    assert got.keys() == by_hand.keys() and all(abs(got[k] - by_hand[k]) < 1e-9 for k in got)


def test_stream_journal_drops_repeats_over_runs(spark, tmp_path):
    """A decision that arrives again, in the same or a later file, lands once, as in journal_append."""
    base = str(tmp_path)
    run = lambda: jobs.stream_journal(spark, f"{base}/landing", f"{base}/journal", f"{base}/rejects", f"{base}/chk").awaitTermination()
    first = decisions(spark, [*range(10), 3, 4], "2025-03-01").unionByName(decisions(spark, [1], "2025-03-01").withColumn("scope_type", F.lit("bad")))
    first.write.mode("append").parquet(f"{base}/landing")
    run()
    # later arrivals: repeats, a new one, and one that is far older than all before
    decisions(spark, [2, 5, 11], "2025-03-01").unionByName(decisions(spark, [77], "1999-01-01")).write.mode("append").parquet(f"{base}/landing")
    run()
    stream = sorted(map(tuple, jr.read_journal(spark, f"{base}/journal").collect()))
    jr.journal_append(spark.read.schema(DECISION_LOG).parquet(f"{base}/landing"), f"{base}/batch")
    assert stream == sorted(map(tuple, jr.read_journal(spark, f"{base}/batch").collect())) and len(stream) == 12
    assert spark.read.parquet(f"{base}/rejects").count() == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """The passes that grow the forest don't walk it again; the forest is the same one."""
    data = C.report.ml_ready(C.build_report(C._t(spark, SF_SMALL)))
    model, pred, _ = ml.train_revenue(data, "rf", max_depth=4)
    forest = model.stages[-1]
    assert forest.getOrDefault("cacheNodeIds") and forest.getNumTrees == 100
    train = ml.materialize(ml.hash_split(data.withColumn("label", F.col(ml.REV_TARGET).cast("double")))).where("split = 'train'")
    features = model.stages[:-1]
    for stage in features:
        train = stage.transform(train)
    plain = ml.RandomForestRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=4, seed=42, cacheNodeIds=False).fit(train)
    assert plain.toDebugString.split("\n", 1)[1] == forest.toDebugString.split("\n", 1)[1]


def _forest_rows(spark, n=400, parts=1):
    """Encoded rows with repeats, ties, a constant and a rare category."""
    rows = spark.range(0, n, 1, parts).select(
        (F.col("id") * 7 % 13).cast("long").alias("nb_paiements"), (F.col("id") * 31 % 97).cast("long").alias("actions_total"),
        F.lit(3).cast("long").alias("sessions_total"), (F.col("id") * 17 % 40).cast("long").alias("anciennete_jours"),
        F.element_at(F.array(*map(F.lit, ("free", "basic", "pro"))), (F.col("id") % 3 + 1).cast("int")).alias("plan"),
        F.when(F.col("id") < 2, "rare").otherwise(F.concat(F.lit("v"), F.col("id") * 11 % 5)).alias("ville"),
        (F.col("id") * F.col("id") * 137 % 5003 / 100 + F.col("id") % 3).alias("label"), F.col("id").alias("client_id"))
    return ml.Pipeline(stages=ml.preprocess_stages(ml.REV_NUM, ml.REV_CAT, scale=True)).fit(rows).transform(rows)


def _saved_nodes(spark, model, path):
    model.write().save(path)
    return sorted(map(str, spark.read.parquet(f"{path}/data").collect()))


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_a_forest_grown_tree_by_tree_is_mllibs(spark, tmp_path, monkeypatch, depth):
    """Same nodes to the last bit (sums, gains, impurities, splits, pruned leaves), without MLlib's passes."""
    rows = _forest_rows(spark)
    make = lambda: ml.RandomForestRegressor(numTrees=7, featureSubsetStrategy="all", maxDepth=depth, seed=42, cacheNodeIds=True)
    plain = make().fit(rows)
    monkeypatch.setattr(ml.RandomForestRegressor, "fit", lambda *a: pytest.fail("MLlib's passes ran"))
    monkeypatch.setattr(ml.forest, "CELLS", 64)  # a few nodes at a time
    own = ml.forest.fit(make(), rows)
    assert _saved_nodes(spark, own, f"{tmp_path}/own") == _saved_nodes(spark, plain, f"{tmp_path}/plain")
    assert own.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1] and own.getNumTrees == 7
    assert own.getOrDefault("maxDepth") == depth and own.getOrDefault("cacheNodeIds") and own.numFeatures == plain.numFeatures


def test_a_forest_of_several_partitions_predicts_as_mllibs(spark):
    rows = _forest_rows(spark, 300, 5)
    est = ml.RandomForestRegressor(numTrees=5, featureSubsetStrategy="all", maxDepth=5, seed=7)
    score = lambda m: [round(r.prediction, 6) for r in m.transform(rows).orderBy("client_id").select("prediction").collect()]
    assert score(ml.forest.fit(est, rows)) == score(est.fit(rows))


def test_a_forest_scores_as_mllib_does(spark, tmp_path, monkeypatch):
    """Without sending MLlib's forest to the executors; also a category and values not seen in training, and no rows."""
    data = C.report.ml_ready(C.build_report(C._t(spark, SF_SMALL)))
    model, _, _ = ml.train_revenue(data, "rf")
    odd = data.union(data.limit(5).withColumn("plan", F.lit("other")).withColumn("actions_total", F.lit(-9).cast("long")).select(data.columns))
    expected = sorted((r.client_id, r.prediction) for r in model.transform(odd).collect())
    ml.ModelStore(spark, str(tmp_path)).save("rf", model, data)
    again = ml.ModelStore(spark, str(tmp_path)).load("rf")[0]
    monkeypatch.setattr(type(model.stages[-1]), "transform", lambda *a: pytest.fail("MLlib's forest was sent"))
    for m in (model, again):
        assert sorted((r.client_id, r.pred_ca_total) for r in ml.score_revenue(m, odd).collect()) == expected
        assert not ml.score_revenue(m, odd.where("client_id < 0")).collect()


def test_a_forest_that_no_task_could_grow_runs_mllibs_passes(spark, monkeypatch):
    rows = _forest_rows(spark, 60)
    est = ml.RandomForestRegressor(numTrees=3, featureSubsetStrategy="all", maxDepth=3, seed=7)
    monkeypatch.setattr(ml.forest, "ROWS", 59)
    model = ml.forest.fit(est, rows)
    assert not hasattr(model, "saved_at") and model.toDebugString.split("\n", 1)[1] == est.fit(rows).toDebugString.split("\n", 1)[1]


def test_a_forest_is_saved_from_its_nodes(spark, tmp_path, monkeypatch):
    """MLlib's writer lists all nodes in one task; the saved pipeline is the same one."""
    data = C.report.ml_ready(C.build_report(C._t(spark, SF_SMALL)))
    model, _, _ = ml.train_revenue(data, "rf", max_depth=6)
    monkeypatch.setattr(type(model.stages[-1]), "write", lambda *a: pytest.fail("the nodes were listed in one task"))
    store = ml.ModelStore(spark, str(tmp_path))
    assert store.save("rf", model, data) == 1
    again = store.load("rf")[0]
    assert again.stages[-1].toDebugString == model.stages[-1].toDebugString and [s.uid for s in again.stages] == [s.uid for s in model.stages]
    rows = lambda m: sorted(map(tuple, ml.score_revenue(m, data).collect()))
    assert rows(again) == rows(model) and abs(sum(r.weight for r in store.weights("rf").collect()) - 1) < 1e-9


def test_an_append_writes_about_a_file_a_day(spark, tmp_path):
    rows = spark.createDataFrame([(f"2025-01-{1 + i % 25:02d}T00:00:00", "client", str(i), "Surveiller", f"because {i}", "me") for i in range(1000)], DECISION_LOG)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        jr.journal_append(rows, str(tmp_path / "j"))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "j").rglob("*.parquet"))) <= 25 + 8
    assert jr.read_journal(spark, str(tmp_path / "j")).count() == 1000

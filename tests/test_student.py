import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pupilage.config import Gate, InputField, Label, ModelError, StudentSettings, TrainingError
from pupilage.functions import ngrams
from pupilage.operators import blocks, features, jointfit, metrics, stagefit, student
from pupilage.operators.stagefit import Grid
from pupilage.plans import score
from pupilage.plans import train as training
from pupilage.sources import models
from pupilage.sources.storage import fresh_path, materialize
from tests.fixtures import records_for, rows_of, task, truth_of, verb_rows


def points(spark, n=60, dims=5, classes=3):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(n, dims)), rng.integers(0, classes, n)
    x[np.arange(n), y] += 1.5
    data = [(f"r{i}", f"h{i}", None, int(y[i]), x[i].tolist(), 1.0 + i % 2) for i in range(n)]
    df = spark.createDataFrame(data, "id string, content_hash string, `group` string, label_index int, x array<double>, weight double")
    return x, y, np.array([d[-1] for d in data]), df.withColumn("features", array_to_vector("x")).repartition(4)


def objective(x, y, w, weights, bias, l2):
    z = x @ weights.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -(w * np.log(p[np.arange(len(y)), y])).sum() / w.sum() + 0.5 * l2 * (weights**2).sum()
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    g *= (w / w.sum())[:, None]
    return loss, g.T @ x + l2 * weights, g.sum(axis=0)


def test_loss_and_gradient_by_brute_force(spark):
    x, y, w, df = points(spark)
    rng = np.random.default_rng(4)
    model = student.LinearModel(rng.normal(size=(3, 5)), rng.normal(size=3))
    found = student.loss_and_gradient(df, model, 0.3)
    for a, b in zip(found, objective(x, y, w, model.weights, model.bias, 0.3)):
        assert a == pytest.approx(b)


def test_adam_mode_matches_plain_adam(spark):
    x, y, w, df = points(spark)
    weights, bias = np.zeros((3, 5)), np.zeros(3)
    theta, m, v = np.zeros(18), np.zeros(18), np.zeros(18)
    for step in range(1, 13):
        loss, gw, gb = objective(x, y, w, weights, bias, 0.01)
        g = np.concatenate([gw.ravel(), gb])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = theta[:15].reshape(3, 5), theta[15:]
    # Rows of weight 2 as two rows: the joint pass weighs classes, not rows.
    doubled = df.unionByName(df.filter("weight = 2")).withColumn("fold", F.lit(0))
    job = jointfit.Job(0.01, jointfit.NO_FOLD, (1.0, 1.0, 1.0), float(w.sum()))
    fitted = jointfit.fit_many(doubled, [job], 3, 5, 12, "adam", 0.05)[0]
    model = fitted.model
    assert fitted.loss == pytest.approx(loss)
    assert model.weights == pytest.approx(weights) and model.bias == pytest.approx(bias)


def test_all_fits_reach_the_same_minimum(spark):
    x, y, w, df = points(spark)
    one, rows = np.ones(len(y)), df.withColumn("fold", F.lit(0))
    jobs = [jointfit.Job(l2, jointfit.NO_FOLD, (1.0, 1.0, 1.0), float(len(y))) for l2 in (0.05, 0.5)]
    for job, fitted in zip(jobs, jointfit.fit_many(rows, jobs, 3, 5, 100)):
        loss, *gradient = objective(x, y, one, fitted.model.weights, fitted.model.bias, job.l2)
        assert fitted.converged and fitted.loss == pytest.approx(loss)
        assert max(np.abs(g).max() for g in gradient) < 1e-3
    assert not jointfit.fit_many(rows, jobs[:1], 3, 5, 2)[0].converged


def test_joint_fits_leave_their_fold_out(spark):
    x, y, _, df = points(spark)
    folded = df.withColumn("fold", (F.xxhash64("id") % 2 + 1).cast("int"))
    places = {r["id"]: r["fold"] for r in folded.select("id", "fold").collect()}
    where = np.array([places[f"r{i}"] for i in range(len(y))])
    job = jointfit.Job(0.1, int(where[0]), (2.0, 1.0, 1.0), 10.0)
    loss, gradient = jointfit.joint_sums(folded, [np.zeros(18)], [job], 3, 5)[0]
    inside = where != job.left_out
    w = np.where(y == 0, 2.0, 1.0)[inside]
    assert loss == pytest.approx(w.sum() * math.log(3))
    expected = objective(x[inside], y[inside], w, np.zeros((3, 5)), np.zeros(3), 0.0)
    assert gradient / w.sum() == pytest.approx(np.concatenate([expected[1].ravel(), expected[2]]))


def test_absent_class_gets_no_probability(spark):
    _, y, _, df = points(spark)
    spec = task(labels=tuple(Label(n, n) for n in ("allow", "deny", "ask", "later")))
    fitted = jointfit.fit_student(df.filter("label_index != 1"), spec, 5, 0.1)
    model = fitted.model
    assert fitted.converged and 0.5 < fitted.train_accuracy <= 1
    p = np.array([r["p"] for r in student.with_probabilities(df, model).select("p").collect()])
    assert p[:, [1, 3]].max() < 1e-3


def test_train_save_load_predict_evaluate(spark):
    spec = task(student=StudentSettings(hash_dimensions=1024, l2=0.001, l2_grid=(0.0005, 0.005)))
    rows = verb_rows(spark, spec)
    labels = records_for(spark, spec, rows)
    fitted, evaluation = training.train(rows, labels, spec)
    report = {r["position"]: r for r in evaluation.report.collect()}
    assert report[0]["accuracy"] > 0.8 and report[4]["accuracy"] > 0.8 and report[0]["accuracy"] > report[2]["accuracy"]
    assert report[5]["accuracy"] == 1.0 and 7 not in report
    assert fitted.training["selection"]["folds"] == 5 and len(fitted.training["selection"]["candidates"]) == 2
    assert evaluation.confusion.agg(F.sum("n")).first()[0] == sum(r["n"] for r in report.values())

    path = fresh_path(spark, "student")
    models.save_model(fitted, spark, path)
    loaded = models.load_model(spark, path)
    assert np.array_equal(loaded.model.weights, fitted.model.weights) and loaded.spec == spec
    served = {r["id"]: r for r in score.predict(rows, loaded).collect()}
    texts = {r["id"]: r["input"]["request"] for r in rows.collect()}
    assert np.mean([served[i]["argmax"] == truth_of(texts[i]) for i in texts]) > 0.9
    assert sum(served["r0"]["probabilities"].values()) == pytest.approx(1.0, abs=1e-3)

    again = training.evaluate(loaded, rows, labels)
    assert [r.asDict() for r in again.report.collect()] == fitted.evaluation
    with pytest.raises(TrainingError, match="0 rows of this dataset"):
        training.evaluate(models.Student(spec, loaded.features, loaded.model, loaded.training, rows.select("content_hash")), rows, labels)

    requests = spark.createDataFrame([(0, "x", '{"request": "read the logs"}'), (1, "y", '{"request": 5}')], "seq bigint, id string, input string")
    assert [r["id"] for r in score.predict_json(requests, loaded, "drop").collect()] == ["x"]


def test_tampered_students_are_refused(spark, tmp_path):
    spec = task()
    model = student.LinearModel(np.ones((3, 1024)), np.zeros(3))
    good = models.Student(spec, features.FeatureDescriptor("hashed", 1024), model, {})
    models.save_model(good, spark, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s" / "weights"))
    stored.withColumn("weight", F.col("weight") * 2).write.parquet(str(tmp_path / "t" / "weights"))
    spark.read.parquet(str(tmp_path / "s" / "metadata")).write.parquet(str(tmp_path / "t" / "metadata"))
    with pytest.raises(ModelError, match="integrity"):
        models.load_model(spark, str(tmp_path / "t"))
    stored.limit(100).write.parquet(str(tmp_path / "u" / "weights"))
    spark.read.parquet(str(tmp_path / "s" / "metadata")).write.parquet(str(tmp_path / "u" / "metadata"))
    with pytest.raises(ModelError):
        models.load_model(spark, str(tmp_path / "u"))


def test_coverage_refusals(spark):
    spec = task()
    rows = rows_of(spark, spec, [(f"p{i}", f"read thing {i}", None, None) for i in range(30)])
    with pytest.raises(TrainingError, match="a fit takes 2 labels"):
        training.train(rows, records_for(spark, spec, rows), spec)


def biased_cache(spark, rows, spec):
    """Logits that favour the first label, beside a pooled vector of noise."""
    data = []
    for r in rows.select("content_hash", "input").collect():
        truth = spec.label_names.index(truth_of(r["input"]["request"]))
        noise = int(r["content_hash"][:4], 16) / 65535 - 0.5
        logits = [(2.0 if i == truth else 0.0) + (3.0 if i == 0 else 0.0) + 0.8 * noise for i in range(3)]
        data.append((r["content_hash"], logits[::-1], spec.options[::-1], [noise, -noise, 0.0], "fake-1"))
    return spark.createDataFrame(data, features.REPRESENTATION)


@pytest.mark.parametrize("scheme,dims", [("logits", 3), ("embedding", 6), ("hybrid", 6 + 64)])
def test_dense_students_beat_zero_shot(spark, scheme, dims):
    spec = task(student=StudentSettings(hash_dimensions=64, l2=0.001, features=scheme))
    rows = verb_rows(spark, spec)
    representations = biased_cache(spark, rows, spec)
    cache = features.dense_features(representations, spec)
    fitted, evaluation = training.train(rows, records_for(spark, spec, rows), spec, cache, "fake-1", with_fingerprints=False)
    report = {r["position"]: r for r in evaluation.report.collect()}
    assert fitted.features.dimensions == dims and len(fitted.features.mean) == min(dims, 6)
    assert report[7]["accuracy"] < 0.5 and report[3]["accuracy"] >= 0.9 and evaluation.beats_zero_shot
    models.check_compatible(fitted, "fake-1", representations)
    with pytest.raises(ModelError):
        score.predict(rows, fitted, cache, "fake-2")
    assert score.predict(rows, fitted, cache, "fake-1").count() == rows.count()


def test_hashed_student_reports_zero_shot_with_a_cache(spark):
    spec = task()
    rows = verb_rows(spark, spec)
    cache = features.dense_features(biased_cache(spark, rows, spec), spec)
    _, evaluation = training.train(rows, records_for(spark, spec, rows), spec, cache, "fake-1", with_fingerprints=False)
    assert 7 in {r["position"] for r in evaluation.report.collect()}


def test_bad_representations_stop_the_job(spark):
    spec = task()
    data = [("h", [1.0, 2.0], spec.options[:2], [0.0], "fake-1")]
    with pytest.raises(Exception, match="does not fit the task"):
        features.dense_features(spark.createDataFrame(data, features.REPRESENTATION), spec).collect()


def test_metrics_average_supported_labels_only(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "reference int, predicted int")
    found = metrics.metrics(df, 4).first()
    assert found["examples"] == 4 and found["accuracy"] == 0.75
    assert found["macro_f1"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert metrics.confusion(df, 4).count() == 16


def test_majority_tie_goes_to_the_first_label(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,)], "label_index int")
    assert metrics.majority_label(df).first()["label_index"] == 1


def test_candidate_ties_go_to_the_stronger_regulariser(spark):
    df = spark.createDataFrame([(0.1, 0.9), (1.0, 0.9), (0.01, 0.8)], "l2 double, accuracy double")
    assert training.best_candidate(df).first()["l2"] == 1.0


def test_students_of_three_layouts_share_one_lookup(spark):
    """Together they answer as each does alone; the scoring plan has no join, as the representation was looked up before."""
    rows, trained, cache = None, [], None
    for scheme in ("hashed", "logits", "hybrid"):
        spec = task(name=scheme, student=StudentSettings(hash_dimensions=64, l2=0.001, epochs=10, features=scheme))
        if rows is None:
            rows = verb_rows(spark, spec)
            representations = biased_cache(spark, rows, spec)
        cache = features.dense_features(representations, spec)
        trained.append(training.train(rows, records_for(spark, spec, rows), spec, cache, "fake-1", with_fingerprints=False)[0])
    served = score.score_many(rows, score.registry(trained), representations=representations, fingerprint="fake-1")
    plan = served._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    together = {(r["classifier"], r["id"]): (r["label"], r["confidence"]) for r in served.collect()}
    for one in trained:
        alone = score.predict(rows, one, None if one.features.scheme == "hashed" else cache, "fake-1").collect()
        assert {(one.spec.name, r["id"]): (r["label"], r["confidence"]) for r in alone}.items() <= together.items()
    assert len(together) == 3 * rows.count()
    named = rows.withColumn("wanted", F.when(F.col("seq") % 2 == 0, "hybrid").otherwise("hashed"))
    for r in score.score_many(named, score.registry(trained), "wanted", representations=representations, fingerprint="fake-1").collect():
        assert together[r["classifier"], r["id"]] == (r["label"], r["confidence"])
    with pytest.raises(ModelError, match="need representations"):
        score.score_many(rows, score.registry(trained))
    with pytest.raises(ModelError):
        score.score_many(rows, score.registry(trained), representations=representations, fingerprint="fake-2")


def test_registry(spark):
    spec = task()
    model = student.LinearModel(np.ones((3, 1024)), np.zeros(3))
    one = models.Student(spec, features.FeatureDescriptor("hashed", 1024), model, {"teacher": "fake"})
    with pytest.raises(ModelError):
        score.registry([one, one])
    served = score.registry([one])
    assert score.student_list(served, spark).first()["features"] == "hashed"
    rows = rows_of(spark, spec, [("a", "read", None, None)]).withColumn("wanted", F.lit("other"))
    with pytest.raises(Exception, match="unknown classifier"):
        score.score_many(rows, served, "wanted")


def test_noul_answers_map_to_two_labels(spark):
    from pupilage.functions.probability import answer_to_probabilities

    spec = task(labels=(Label("safe", "s"), Label("unsafe", "u")), abstain=None, teacher=Gate("noul", 0.5, "drop"), fields=(InputField("request"),))
    df = spark.createDataFrame([(0.8,), (None,)], "noul double")
    found = [r[0] for r in df.select(answer_to_probabilities(spec, F.lit(None).cast("map<string,double>"), F.col("noul"))).collect()]
    assert found[0] == pytest.approx([0.2, 0.8]) and found[1] is None


def folded_points(spark):
    x, y, w, df = points(spark)
    return df.withColumn("fold", F.pmod(F.monotonically_increasing_id(), F.lit(3)).cast("int")).repartition(3)


@pytest.mark.parametrize("grid", [(1, 1), (1, 3), (2, 2), (4, 1)])
def test_fits_inside_a_stage_end_where_fits_by_passes_do(spark, grid):
    """One shard or several that exchange sums, one group of jobs or several; every model and its hits agree."""
    rows = materialize(folded_points(spark), "folded")
    counts = jointfit.extent(rows, 3, 3).counts
    jobs = [jointfit.job_for(l2, counts.sum(axis=0) - counts[k], "balanced", k) for l2 in (0.05, 0.5) for k in range(3)]
    jobs.append(jointfit.Job(0.1, jointfit.NO_FOLD, (1.0, 1.0, 1.0), float(counts.sum()), (2,)))
    for method in ("lbfgs", "adam"):
        want = jointfit._by_passes(rows, jobs, 3, 5, 40, method, 0.05)
        got = jointfit._in_stage(rows, jobs, 3, 5, 40, method, 0.05, Grid(*grid))
        for a, b in zip(want, got):
            assert b.loss == pytest.approx(a.loss, rel=1e-9) and (a.converged, a.hits, a.tested) == (b.converged, b.hits, b.tested)
            assert b.model.weights == pytest.approx(a.model.weights, abs=1e-6)


def test_shards_without_rows_take_part(spark):
    rows = folded_points(spark).limit(2).withColumn("fold", F.lit(0))
    job = jointfit.Job(0.1, jointfit.NO_FOLD, (1.0, 1.0, 1.0), 2.0)
    want = jointfit._by_passes(rows, [job], 3, 5, 30, "lbfgs", 0.05)[0]
    got = jointfit._in_stage(rows, [job], 3, 5, 30, "lbfgs", 0.05, Grid(4, 1))[0]
    assert got.loss == pytest.approx(want.loss) and got.tested == 2


def test_a_stage_whose_task_dies_starts_again(spark, tmp_path):
    """One of four exchanging tasks fails once; the stage is tried again and the fit is the same."""
    rows = materialize(folded_points(spark), "folded")
    job = jointfit.Job(0.1, jointfit.NO_FOLD, (1.0, 1.0, 1.0), float(rows.count()))
    folder = str(tmp_path)

    def started(task):
        with open(f"{folder}/task-{task}", "a") as log:
            log.write("x")
        if task == 2 and open(f"{folder}/task-{task}").read() == "x":
            raise RuntimeError("this executor is lost")

    got = jointfit._in_stage(rows, [job], 3, 5, 30, "lbfgs", 0.05, Grid(4, 1), started)[0]
    assert len((tmp_path / "task-2").read_text()) == 2
    want = jointfit._by_passes(rows, [job], 3, 5, 30, "lbfgs", 0.05)[0]
    assert got.loss == pytest.approx(want.loss) and got.converged == want.converged


def test_layout_stays_within_its_bounds():
    assert stagefit.layout(1000, 15, 3 * 4097, 3, 8).shards == 1
    many = stagefit.layout(20_000_000, 15, 3 * 4097, 3, 64)
    assert many.shards >= 3 and many.tasks <= 64
    assert stagefit.layout(20_000_000, 15, 3 * 4097, 3, 64, barrier=False) is None
    assert stagefit.layout(10**12, 15, 3 * 4097, 3, 1000) is None
    assert stagefit.layout(1000, 1, 32 * 262_145, 32, 8) is None


def test_selection_and_fit_take_few_jobs(spark):
    x, y, w, df = points(spark)
    spec = task(student=StudentSettings(hash_dimensions=1024, l2_grid=(0.0005, 0.005, 0.05)))
    rows = materialize(df.withColumn("content_hash", F.sha2("id", 256)), "few")
    tracker, group = spark.sparkContext.statusTracker(), "selection-and-fit"
    spark.sparkContext.setJobGroup(group, group)
    try:
        selection = training.select_l2(rows, spec, 5)
        fitted = jointfit.fit_student(rows, spec, 5, selection.l2, known=selection.known)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert selection.folds == 5 and fitted.converged
    assert 0 < len(tracker.getJobIdsForGroup(group)) <= 10


@pytest.mark.parametrize("filled", [1, 10**6])
def test_sums_over_blocks_by_brute_force(monkeypatch, filled):
    """Matrix blocks and cell blocks, cut in small parts, give the sums of the whole."""
    monkeypatch.setattr(blocks, "FILLED", filled)
    monkeypatch.setattr(blocks, "MATRIX_CELLS", 144)
    monkeypatch.setattr(blocks, "SPARSE_CELLS", 16)
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 9)) < 0.4, rng.normal(size=(40, 9)), 0.0)
    y, fold = rng.integers(0, 3, 40).astype(np.int32), rng.integers(0, 2, 40).astype(np.int32)
    row, index = np.nonzero(x)
    block = blocks.Block(y, fold, np.bincount(row, minlength=40).astype(np.int32), index.astype(np.int32), x[row, index])
    assert block.filled(9) == (filled > 1)
    at, weight = rng.normal(size=(2, 30)), np.array([1.0, 2.0, 0.5])
    sums = blocks.Sums(at, [(0, weight), (1, weight)], 9)
    sums.add(block)
    for k in range(2):
        inside = fold != k
        w = weight[y[inside]]
        loss, *gradient = objective(x[inside], y[inside], w, at[k, :27].reshape(3, 9), at[k, 27:], 0.0)
        assert sums.found[k, -1] == pytest.approx(loss * w.sum())
        assert sums.found[k, :-1] == pytest.approx(np.concatenate([g.ravel() for g in gradient]) * w.sum())


def test_a_pass_sends_few_rows_and_blocks_stay_small(spark, monkeypatch):
    """What a task of a pass sends is bounded by the parameters alone, and a table of blocks keeps every row."""
    _, y, _, df = points(spark)
    rows = materialize(df.withColumn("fold", F.lit(0)), "sums")
    monkeypatch.setattr(blocks, "PACKED_CELLS", 20)
    table = materialize(blocks.packed(rows), "blocks").toArrow()
    held = [b for batch in table.to_batches() for b in blocks.unpacked(batch)]
    assert sum(b.rows for b in held) == len(y)
    job = jointfit.Job(0.1, jointfit.NO_FOLD, (1.0, 1.0, 1.0), float(len(y)))
    want = jointfit.joint_sums(rows, [np.zeros(18)], [job], 3, 5)[0]
    monkeypatch.setattr(jointfit, "PART", 4)
    got = jointfit.joint_sums(rows, [np.zeros(18)], [job], 3, 5)[0]
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_words_are_hashed_in_slices(monkeypatch):
    """A batch is hashed a bounded number of words at a time, with the values of the whole."""
    words = pa.array([["a", "b", "a"], [], None, ["c"] * 9, ["a", "c"]], pa.list_(pa.string()))
    seen = []

    def build(column):
        seen.append(len(column.flatten()))
        row, bucket, count = ngrams._term_counts([column], ["f"], 64)
        return ngrams._vector_array(row, bucket, ngrams._normalized(row, count, len(column)), len(column), 64)

    whole = build(words)
    seen.clear()
    monkeypatch.setattr(ngrams, "SLICE_WORDS", 4)
    assert ngrams._in_slices(build, (words,), 1).to_pylist() == whole.to_pylist()
    assert seen == [3, 9, 2]
    assert ngrams._in_slices(build, (words.slice(0, 0),), 1).to_pylist() == []

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.constants import RFM_FEATURES, SEGMENT_LABELS
from tillwise.operators import clusters, naming, preprocess, sketches
from tillwise.operators.model import SegmentModel, fit_segment_model
from tillwise.plans.customer_features import LIVE_MODEL
from tillwise.plans.registry import QUERIES
from tillwise.sources import files
from tillwise.sources.retail import customers
from tillwise.session import new_shared_path
from tillwise.streaming import live


@pytest.fixture(scope="module")
def rfm(spark, sf_dir):
    return customers(spark, sf_dir)


@pytest.fixture(scope="module")
def fitted(rfm):
    return fit_segment_model(rfm, [3, 4], restarts=2)


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def test_search_keeps_the_best_train_silhouette(fitted):
    model, search = fitted
    frame = {r.k: r for r in search.metrics_frame().collect()}
    assert set(frame) == {3, 4}
    assert frame[search.best_k].train_silhouette == max(r.train_silhouette for r in frame.values())
    assert len(model.centres) == search.best_k and set(model.names) == set(model.centres)


def test_each_customer_gets_the_nearest_centre(fitted):
    model, search = fitted
    train, test = search.assign()
    assert not {r.CustomerID for r in train.select("CustomerID").collect()} & {r.CustomerID for r in test.select("CustomerID").collect()}
    for r in train.union(test).collect():
        point = [r[f] for f in RFM_FEATURES]
        nearest = min(model.centres, key=lambda i: distance(point, model.centres[i]))
        assert distance(point, model.centres[r.Segment]) == pytest.approx(distance(point, model.centres[nearest]))


def test_literal_centres_agree_with_the_model(fitted):
    model, search = fitted
    train, _ = search.assign()
    again = train.withColumn("mine", clusters.nearest_centre(RFM_FEATURES, model.centres))
    assert again.filter("mine <> Segment").count() == 0


def test_assign_before_fit(rfm):
    with pytest.raises(ValueError, match="fit"):
        clusters.ClusterSearch(rfm, rfm, RFM_FEATURES).assign()


@pytest.mark.parametrize("name", ["kmeans_segments", "k_selection", "predict_segments", "model_roundtrip"])
def test_registered_fits_try_all_k_and_restarts(spark, sf_dir, monkeypatch, name):
    class Stop(Exception):
        pass

    def fit(search):
        raise Stop(list(search.k_range), search.restarts)

    monkeypatch.setattr(clusters.ClusterSearch, "fit", fit)
    with pytest.raises(Stop) as stopped:
        QUERIES[name](spark, sf_dir)
    assert stopped.value.args == ([3, 4, 5, 6, 7, 8], 10)


def test_fits_do_not_hang_on_how_rows_came(spark):
    """Equal centres, bit for bit, from 1, 2, 8 and 64 partitions, however ordered."""
    points = [(i, (i * 37 % 101) / 3.0, (i * 17 % 89) / 7.0) for i in range(400)]
    rows = spark.createDataFrame(points, "id long, x double, y double")
    found = []
    for came in (rows.coalesce(1), rows.repartition(2), rows.repartition(8, "y"), rows.repartition(64).sortWithinPartitions(F.desc("x"))):
        search = clusters.ClusterSearch(came, came, ["x", "y"], [4, 5], restarts=2).fit()
        found.append((clusters.centres_of(search.best_model), [m[3] for m in search.metrics]))
    assert found[0] == found[1] == found[2] == found[3]


def test_fits_are_lloyds(spark):
    """Each centre is the mean of its points, the cost is their squared distances, and groups far apart are found."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (40, 0), (0, 40))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    search = clusters.ClusterSearch(df, df, ["x", "y"], [2, 3, 4], restarts=3).fit()
    assert search.best_k == 3
    label = np.argmin(clusters.distances(x, search.best_model.centres), axis=1)
    assert sorted(np.bincount(label)) == [60, 60, 60]
    for i, c in enumerate(search.best_model.centres):
        assert c == pytest.approx(x[label == i].mean(axis=0), abs=1e-8)
    assert search.best_model.cost == pytest.approx(clusters.distances(x, search.best_model.centres).min(axis=1).sum(), rel=1e-8)


def summed_plainly(x, values, centres):
    label = clusters.distances(x, centres).argmin(axis=1)
    return [values[label == i].sum(axis=0).tolist() for i in range(len(centres))]


@pytest.mark.parametrize("k", [1, 2, 5, 8])
@pytest.mark.parametrize("far", [0.0, 1e6])
def test_sums_by_nearest_centre_are_those_of_the_distances(k, far):
    """Also with rows halfway between centres, equal centres and features far from zero."""
    rng = np.random.default_rng(k)
    x = far + rng.integers(-4, 5, (700, 3)) / 2.0
    values = np.column_stack([np.ones(700), np.rint(rng.normal(0, 2.0**37, (700, 3)))])
    centres = far + rng.integers(-2, 3, (6, k, 3)) / 2.0
    centres[0] = centres[0, 0]
    centres[1] += rng.normal(0, 1e-9, (k, 3))
    got = clusters.block_sums(x, values, centres)
    assert [c.tolist() for c in got] == [summed_plainly(x, values, c) for c in centres]


def test_rows_meet_all_centres_in_one_product(monkeypatch):
    """Distances are taken one by one only for rows with two centres within rounding."""
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(500, 4)), rng.normal(size=(7, 5, 4))
    values = np.column_stack([np.ones(500), np.rint(x * 2.0**30)])
    x[9], centres[2, :2], centres[2, 2:] = 0.0, [[1, 0, 0, 0], [-1, 0, 0, 0]], 9.0
    want, asked, plain = [summed_plainly(x, values, c) for c in centres], [], clusters.distances
    monkeypatch.setattr(clusters, "distances", lambda rows, own: asked.append(len(rows)) or plain(rows, own))
    assert [c.tolist() for c in clusters.block_sums(x, values, centres)] == want
    assert asked == [1]


def test_rounds_add_sums_only_and_costs_come_once(spark, monkeypatch):
    rounds, asked, sums, costs = [], [], clusters.cluster_sums, clusters.costs
    monkeypatch.setattr(clusters, "cluster_sums", lambda *a: rounds.append(1) or sums(*a))
    monkeypatch.setattr(clusters, "costs", lambda *a: asked.append(len(a[2])) or costs(*a))
    x = np.random.default_rng(6).normal(size=(300, 2))
    points = spark.createDataFrame([(float(a), float(b), i * 0x9E3779B1) for i, (a, b) in enumerate(x)], "x double, y double, _draw long")
    fits = clusters.fit_all(points, ["x", "y"], [(2, 1), (3, 1), (3, 2)])
    assert asked == [3] and len(rounds) == max(f.rounds for f in fits) > 1
    for f in fits:
        assert f.done and f.cost == pytest.approx(clusters.distances(x, f.centres).min(axis=1).sum(), rel=1e-8)


def as_points(spark, x):
    draw = np.random.default_rng(len(x)).integers(-(2**63), 2**63 - 1, len(x)).tolist()
    return spark.createDataFrame([(float(a), float(b), d) for (a, b), d in zip(x, draw)], "x double, y double, _draw long"), np.array(draw)


def test_passes_read_blocks_of_points(spark):
    """Passes get a field for each block, not for each feature of each row, and no row is lost."""
    x = np.random.default_rng(2).normal(size=(12_000, 2))
    points, _ = as_points(spark, x)
    blocks = clusters.packed(points.coalesce(1), ["x", "y"]).cache()
    assert blocks.count() <= 4
    got = np.vstack([np.frombuffer(r["rows"], np.float64).reshape(-1, 2) for r in blocks.collect()])
    assert sorted(got.tolist()) == sorted(x.tolist()) and clusters.reach_of(blocks) == np.abs(x).max()
    blocks.unpersist()


def test_all_fits_are_judged_in_two_passes(spark, monkeypatch):
    """The silhouettes of Spark's evaluator, also with a cluster of one row, and none for a single cluster."""
    x = np.vstack([np.random.default_rng(5).normal(c, 1.0, (40, 2)) for c in ((0, 0), (9, 0))] + [[[50.0, 50.0]]])
    points, _ = as_points(spark, x)
    fits = [clusters.Fit(len(c), 1, np.array(c, float)) for c in ([[0, 0], [9, 0]], [[0, 0], [9, 0], [50, 50]], [[0, 0], [900, 900]], [[0, 0], [0, 0], [9, 1]])]
    want = [clusters.silhouette(clusters.assemble(points, ["x", "y"]).withColumn("Segment", clusters.nearest_centre(["x", "y"], clusters.centres_of(f)))) for f in fits]
    passes, plain = [], type(points).mapInArrow
    blocks = clusters.packed(points, ["x", "y"])
    monkeypatch.setattr(type(points), "mapInArrow", lambda *a: passes.append(1) or plain(*a))
    got = clusters.silhouettes(blocks, ["x", "y"], fits)
    assert len(passes) == 2 and got[2] is None and want[2] is None
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-9)


def test_first_centres_are_drawn_from_all_rows(spark):
    """The rows passed over are none that wins: the draw is the least wait of all rows."""
    x = np.random.default_rng(9).normal(size=(20_000, 2)) ** 3
    points, draw = as_points(spark, x)
    blocks = clusters.packed(points.coalesce(1), ["x", "y"]).cache()
    for step, centres in enumerate([np.zeros((0, 2)), x[:1], x[:2], x[:3]]):
        fits = [clusters.Fit(4, seed, centres) for seed in range(5)]
        got = clusters.next_centres(blocks, ["x", "y"], fits, step)
        for i, f in enumerate(fits):
            with np.errstate(divide="ignore"):
                wait = -np.log(clusters.chance(draw, f.seed, step)) / (clusters.distances(x, centres).min(axis=1) if step else 1.0)
            assert got[i] == x[wait.argmin()].tolist()
    blocks.unpersist()


def test_points_are_dealt_evenly(spark, monkeypatch):
    """Rows that lie in one part are spread over all cores before the passes read them."""
    rows = spark.range(4_000, numPartitions=1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    sizes, plain = [], clusters.fit_blocks
    monkeypatch.setattr(clusters, "fit_blocks", lambda blocks, *a: sizes.extend(len(r["rows"]) // 16 for r in blocks.collect()) or plain(blocks, *a))
    clusters.ClusterSearch(rows, rows.limit(10), ["x", "y"], [2], restarts=1).fit()
    assert sum(sizes) == 4_000 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 16


def test_a_test_part_with_missing_features_is_an_error(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3)) for i in range(50)], "id long, x double, y double")
    with pytest.raises(ValueError, match="missing"):
        clusters.ClusterSearch(rows, rows.withColumn("x", F.lit(float("nan"))), ["x", "y"], [2], restarts=1).fit()


def test_draws_go_by_squared_distance():
    """Waiting times of the seeding: the share of wins is the weight."""
    draw = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 40_000)
    wins = -np.log(clusters.chance(draw[::2], 1, 1)) / 1.0 < -np.log(clusters.chance(draw[1::2], 1, 1)) / 3.0
    assert wins.mean() == pytest.approx(0.25, abs=0.02)


def test_fits_of_few_points_and_of_none(spark):
    few = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(10)], "id long, x double, y double")
    search = clusters.ClusterSearch(few, few, ["x", "y"], [2, 3], restarts=1).fit()
    assert search.best_k == 2 and len(search.best_model.centres) == 2
    assert clusters.ClusterSearch(few.limit(0), few, ["x", "y"], [2], restarts=1).fit().best_model is None
    with pytest.raises(ValueError, match="missing"):
        clusters.ClusterSearch(few.withColumn("x", F.lit(None).cast("double")), few, ["x", "y"], [2], restarts=1).fit()


def test_a_stopped_save_leaves_the_old_model(spark, fitted, monkeypatch):
    model, _ = fitted
    path = new_shared_path(spark, "model-versions")
    first = model.save(spark, path)
    other = SegmentModel(model.features, model.scaler, {"Monetary": None}, {0: [0.0] * 6}, {0: "x"})

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr("tillwise.operators.model.replace_file", stop)
        with pytest.raises(RuntimeError):
            other.save(spark, path)
    assert SegmentModel.load(spark, path) == model
    second = other.save(spark, path)
    assert SegmentModel.load(spark, path) == other
    assert SegmentModel.load(spark, path, first) == model and first != second


def test_silhouette_against_all_pairs(spark):
    points = [((i * 37 % 11) / 3.0, (i * 17 % 7) / 2.0, i % 3) for i in range(40)] + [(50.0, 50.0, 3)]
    df = spark.createDataFrame(points, "x double, y double, Segment int")
    got = clusters.silhouette(clusters.assemble(df, ["x", "y"]))
    groups = {s: [p[:2] for p in points if p[2] == s] for s in range(4)}

    def one(p):
        own = groups[p[2]]
        if len(own) == 1:
            return 0.0
        a = sum(distance(p[:2], q) for q in own) / (len(own) - 1)
        b = min(sum(distance(p[:2], q) for q in g) / len(g) for s, g in groups.items() if s != p[2])
        return (b - a) / max(a, b)

    assert got == pytest.approx(sum(map(one, points)) / len(points), abs=1e-9)
    assert clusters.silhouette(clusters.assemble(df.filter("Segment = 1"), ["x", "y"])) is None


@pytest.mark.parametrize("k", [1, 3, 4, 6])
def test_names_by_falling_mean_money(spark, k):
    rows = [(s, 100.0 * (s + 1)) for s in range(k)]
    names = {r.Segment: r.Segment_Name for r in naming.segment_names(spark.createDataFrame(rows, "Segment int, Monetary double")).collect()}
    want = (SEGMENT_LABELS + ["Regular"] * 2)[:k]
    assert [names[s] for s in reversed(range(k))] == want


def test_saved_model_predicts_the_same(spark, rfm, fitted):
    model, _ = fitted
    path = new_shared_path(spark, "model-test")
    model.save(spark, path)
    loaded = SegmentModel.load(spark, path)
    assert loaded == model
    both = [sorted(map(tuple, m.predict(rfm).select("CustomerID", "Segment", "Segment_Name").collect())) for m in (model, loaded)]
    assert both[0] == both[1] and len(both[0]) == rfm.count()


def test_prediction_keeps_columns_and_needs_the_inputs(spark, four, fitted):
    model, _ = fitted
    got = model.predict(four.withColumn("note", F.lit("x")))
    assert got.columns == [*four.columns, "note", "Segment", "Segment_Name"] and got.count() == 4
    with pytest.raises(ValueError, match="Tenure"):
        model.predict(four.drop("Tenure"))
    with pytest.raises(ValueError):
        naming.predict_segments([1, 2], model.scaler, model.centres)


def test_single_customer_gets_the_stored_name(spark, four):
    one = live.score_customers(four.filter("CustomerID = 1003"), LIVE_MODEL).first()
    assert one.Segment_Name == LIVE_MODEL.names[one.Segment]
    assert (one.ChurnScore, one.ChurnRisk) == (0.775, "High Risk")
    assert one.Recency_component + one.Frequency_component + one.Monetary_component == pytest.approx(0.775)


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_stream_equals_batch_and_goes_on_after_a_stop(spark, rfm, file_format):
    source, sink, marks = (new_shared_path(spark, f"stream-{n}") for n in ("in", "out", "marks"))
    first, second = rfm.filter("CustomerID % 2 = 0"), rfm.filter("CustomerID % 2 = 1")
    for part in (first, second):
        writer = part.coalesce(1).write.mode("append")
        (writer.option("header", True).csv(source) if file_format == "csv" else writer.parquet(source))
        stream = live.read_customer_stream(spark, source, file_format=file_format)
        query = live.start_scoring(stream, LIVE_MODEL, sink, marks)
        assert query.awaitTermination(120)
    batch = live.score_customers(rfm, LIVE_MODEL)
    got = spark.read.parquet(sink).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_csv_missing_path_and_bad_value(spark, four):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_csv(spark, "/nowhere/at/all.csv").count()
    path = new_shared_path(spark, "bad-csv")
    four.withColumn("Recency", F.lit("many")).write.option("header", True).csv(path)
    with pytest.raises(Exception):
        files.read_csv(spark, path, four.schema).collect()


def test_csv_and_parquet_give_back_what_was_written(spark, four):
    for write, read in [
        (files.write_csv, lambda p: files.read_csv(spark, p, four.schema)),
        (files.write_parquet, lambda p: files.read_parquet(spark, p)),
    ]:
        path = new_shared_path(spark, "files")
        write(four, path)
        assert sorted(map(tuple, read(path).collect())) == sorted(map(tuple, four.collect()))


def test_csv_date_format(spark):
    path = new_shared_path(spark, "dates-csv")
    spark.createDataFrame([("1", "01/02/2011 08:30")], "InvoiceNo string, InvoiceDate string").write.option("header", True).csv(path)
    row = files.read_csv(spark, path, "InvoiceNo string, InvoiceDate timestamp", "dd/MM/yyyy HH:mm").first()
    assert row.InvoiceDate == dt.datetime(2011, 2, 1, 8, 30)


def test_rewriting_one_partition_leaves_the_others(spark):
    path = new_shared_path(spark, "months")
    rows = [(1, "2020-01"), (2, "2020-01"), (3, "2020-02")]
    files.write_parquet(spark.createDataFrame(rows, "x int, month string"), path, ["month"])
    files.write_parquet(spark.createDataFrame([(9, "2020-02"), (8, "2020-03")], "x int, month string"), path, ["month"])
    got = spark.read.parquet(path).selectExpr("x", "cast(month AS string) AS month").collect()
    assert sorted(map(tuple, got)) == [(1, "2020-01"), (2, "2020-01"), (8, "2020-03"), (9, "2020-02")]


def test_sketches_of_any_range_are_near(spark):
    """Ranges of merged days against exact counts and ranks, days without rows included."""
    df = spark.range(60_000).select(
        (F.col("id") * 7919 % 20_011).alias("CustomerID"),
        (F.col("id") % 30_000).cast("string").alias("InvoiceNo"),
        F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 40 as int))").alias("InvoiceDate"),
        F.col("id").cast("double").alias("TotalPrice"),
    )
    days = sketches.daily_sketches(df).cache()
    assert days.count() == 40
    for first, last in (("2020-01-01", "2020-02-09"), ("2020-01-05", "2020-01-06")):
        inside = df.filter(F.to_date("InvoiceDate").between(first, last))
        exact = inside.agg(F.count("*").alias("n"), F.count_distinct("CustomerID").alias("c"), F.count_distinct("InvoiceNo").alias("o")).first()
        got = sketches.answers(sketches.merged(days.filter(F.col("day").between(first, last))), 0.9).first()
        assert got.n_rows == exact.n
        assert got.customers == pytest.approx(exact.c, rel=sketches.COUNT_ERROR) and got.orders == pytest.approx(exact.o, rel=sketches.COUNT_ERROR)
        assert inside.filter(F.col("TotalPrice") <= got.amount).count() / exact.n == pytest.approx(0.9, abs=sketches.RANK_ERROR)
    days.unpersist()

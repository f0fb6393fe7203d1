"""Saved models, the champion of a run table, sketches by day, the catalogue by bucket."""

import datetime
import glob
import os
import random

import pytest
from pyspark.errors import AnalysisException

from ranktide.models import store
from ranktide.models.factors import FactorModel
from ranktide.operators import eda as E
from ranktide.operators import evaluate as N
from ranktide.operators import retrieval as R


def factors(spark, seed):
    rng = random.Random(seed)
    side = lambda n, key: spark.createDataFrame(
        [(x, [rng.gauss(0, 1) for _ in range(4)]) for x in range(n)], f"{key} int, features array<double>")
    return FactorModel(side(20, "u"), side(30, "i"), [0.7, 0.5, 0.4], [3.0, 2.0])


def test_a_loaded_model_recommends_as_the_saved_one(spark, tmp_path):
    root, first, second = str(tmp_path / "m"), factors(spark, 1), factors(spark, 2)
    history = spark.createDataFrame([(u, u % 7, 1.0) for u in range(20)], "u int, i int, value double")
    codes = spark.createDataFrame([("a", 0), ("b", 1)], "value string, code int")
    assert store.save_factors(root, "bpr", first, {"lr": 0.1}, {"user_id": codes}) == 1
    assert store.save_factors(root, "bpr", second) == 2 and store.save_factors(root, "svd", second) == 1
    for number, model in ((1, first), (2, second), (None, second)):
        got = store.load(spark, root, "bpr", number)
        want = sorted(map(tuple, model.recommend(history, 5).collect()))
        assert sorted(map(tuple, got.factors().recommend(history, 5).collect())) == want
        assert (got.losses, got.singular) == ([0.7, 0.5, 0.4], [3.0, 2.0])
    old = store.load(spark, root, "bpr", 1)
    assert old.params == {"lr": "0.1"} and sorted(map(tuple, old.encoders()["user_id"].collect())) == [("a", 0), ("b", 1)]


def test_a_crashed_save_is_invisible(spark, tmp_path):
    root = str(tmp_path / "m")
    with pytest.raises(KeyError):
        store.load(spark, root, "bpr")
    store.save_factors(root, "bpr", factors(spark, 1))
    broken = factors(spark, 2)
    broken.items = broken.items.selectExpr("i", "array(raise_error('lost')) AS features")
    with pytest.raises(Exception, match="lost"):
        store.save_factors(root, "bpr", broken)  # users are written by then
    listed = glob.glob(f"{root}/versions/part-*.parquet")
    attempt = f"{root}/versions/_temporary/0/_temporary"
    os.makedirs(attempt)
    with open(listed[0], "rb") as a, open(f"{attempt}/{os.path.basename(listed[0])}", "wb") as b:
        b.write(a.read())  # a list entry that was never moved into place
    assert store.versions(spark, root).count() == 1 and store.load(spark, root, "bpr").number == 1
    assert len(os.listdir(f"{root}/tables")) == 2


def test_champion_is_the_first_of_the_best(spark):
    log = spark.createDataFrame(
        [("a", "metric", "ndcg", 0.2, 1), ("a", "metric", "ndcg", 0.4, 2), ("b", "metric", "ndcg", 0.4, 3),
         ("a", "param", "alpha", 0.7, 2), ("b", "param", "alpha", 0.9, 3), ("c", "metric", "ndcg", float("nan"), 0),
         ("d", "metric", "ndcg", None, 0), ("e", "param", "ndcg", 9.0, 0)],
        "run string, kind string, key string, value double, step int")
    got = sorted((r.run, r.step, r.key, r.value) for r in N.champion(log).collect())
    assert got == [("a", 2, "champion_alpha", 0.7), ("a", 2, "champion_ndcg", 0.4)]
    assert N.champion(log, "mrr").count() == 0
    losses = N.loss_rows(spark, "bpr", [0.7, 0.5])
    assert [tuple(r) for r in log.unionByName(losses).where("key = 'loss'").orderBy("step").collect()] == [
        ("bpr", "metric", "loss", 0.7, 0), ("bpr", "metric", "loss", 0.5, 1)]


def test_merged_sketches_are_near_the_exact_numbers(spark):
    rng = random.Random(3)
    day = datetime.datetime(2000, 1, 1)
    rows = [(f"u{rng.randrange(30000) if rng.random() < 0.7 else 0}", rng.randrange(9), day + datetime.timedelta(hours=rng.randrange(24 * 300)))
            for _ in range(40000)] + [(None, 1, day), ("x", None, None)]
    df = spark.createDataFrame(rows, "user string, stars int, at timestamp").repartition(6)
    d = datetime.date
    spans = [(d(2000, 1, 1), d(2000, 12, 31)), (d(2000, 1, 1), d(2000, 1, 1)), (d(2000, 2, 1), d(2000, 5, 9)),
             (d(2000, 5, 9), d(2000, 2, 1)), (d(1990, 1, 1), d(1990, 2, 1))]
    ranges = spark.createDataFrame(spans, "lo date, hi date")
    got = {(r.lo, r.hi, r.column): r for r in E.distinct_in_ranges(E.distinct_sketches(df, ["user", "stars"], "at"), ranges).collect()}
    exact = {(r.lo, r.hi, r.column): r.n_unique for r in E.nunique_in_ranges(df, ["user", "stars"], "at", ranges).collect()}
    assert len(got) == 6 and got.keys() == exact.keys()  # a turned range and one without rows have no line
    for (lo, hi, c), n in exact.items():
        own = {r[0 if c == "user" else 1] for r in rows if r[2] and lo <= r[2].date() <= hi} - {None}
        assert n == len(own)
        assert abs(got[lo, hi, c].n_estimated - n) <= got[lo, hi, c].error * n
    assert max(exact.values()) > 5000


def stamps(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/bucket=*/*.parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    root, schema = str(tmp_path / "c"), "id string, version int, title string"
    rows = [(f"p{i}", 1, f"t{i}") for i in range(400)] + [("p3", 1, "t3")]
    R.upsert_buckets(root, spark.createDataFrame(rows, schema), buckets=16)
    before = stamps(root)
    news = [("p3", 2, "new"), ("p5", 0, "old"), ("q", 1, None)]
    touched = R.upsert_buckets(root, spark.createDataFrame(news, schema), buckets=16)
    after = stamps(root)
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) <= 3 and same and all(after.get(f) == before[f] for f in same)
    assert not {f for f in before if f not in same} & after.keys()
    want = {i: (i, v, t) for i, v, t in rows} | {"p3": ("p3", 2, "new"), "q": ("q", 1, None)}
    assert sorted(map(tuple, R.read_buckets(spark, root).collect())) == sorted(want.values())
    assert R.upsert_buckets(root, spark.createDataFrame([], schema), buckets=16) == [] and stamps(root) == after
    with pytest.raises(ValueError):
        R.upsert_buckets(root, spark.createDataFrame([("a", 1, 2)], "id string, version int, bucket int"))
    with pytest.raises(AnalysisException):
        R.read_buckets(spark, str(tmp_path / "nothing"))

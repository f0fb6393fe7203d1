"""Encoders, segments, splits, scaling, text cleaning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ranktide.functions import text as T
from ranktide.functions.relational import dense_index
from ranktide.operators import clean as C
from ranktide.operators import features as G


def test_label_codes_dense_sorted_bijection(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", None, "b"]], "x string")
    m = {r["value"]: r["code"] for r in G.fit_label_codes(df, "x").collect()}
    assert m == {"a": 0, "b": 1, "c": 2}


def test_unseen_label_fails(spark):
    fit = G.fit_label_codes(spark.createDataFrame([("a",)], "x string"), "x")
    with pytest.raises(Exception):
        G.apply_label_codes(spark.createDataFrame([("zz",)], "x string"), "x", fit).collect()


def test_dense_index_partition_invariant(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    for n in (1, 3, 11):
        got = dense_index(df.repartition(n), ["k"], "idx").orderBy("k").select("idx").collect()
        assert [r["idx"] for r in got] == list(range(5000))


def test_user_segment_bins(spark):
    rows = [("l", 1)] * 2 + [("m", 1)] * 3 + [("m2", 1)] * 10 + [("h", 1)] * 11 + [("z", None)]
    df = spark.createDataFrame(rows, "user_id string, rating int")
    seg = {r["user_id"]: r["user_segment"] for r in G.add_user_segment(df).collect()}
    assert seg == {"l": "Light", "m": "Medium", "m2": "Medium", "h": "Heavy", "z": None}


def test_time_split_partitions_non_null_rows(spark):
    ts = [dt.datetime(y, 6, 1) for y in (2019, 2020, 2021, 2022, 2023)] + [None]
    df = spark.createDataFrame([(t,) for t in ts], "timestamp timestamp")
    tr, va, te = G.time_based_split(df, "timestamp", 2021, 2022)
    assert (tr.count(), va.count(), te.count()) == (2, 1, 2)


def test_minmax_constant_column_is_zero_and_unclipped(spark):
    train = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    test = spark.createDataFrame([(5.0, 5.0)], "c double, x double")
    stats = G.fit_minmax(train, ["c", "x"])
    r = G.apply_minmax(test, stats, ["c", "x"]).first()
    assert r["c_norm"] == 0.0 and r["x_norm"] == 2.0


def test_store_tier(spark):
    rows = [("big", f"p{i}", 4.5) for i in range(50)] + [("mid", "q", 3.7)] + [("small", "r", 2.0), (None, "s", 5.0)]
    df = spark.createDataFrame(rows, "store string, parent_asin string, average_rating double")
    t = {r["parent_asin"]: r["store_tier"] for r in G.add_store_tier(df).collect()}
    assert t["p0"] == "Premium" and t["q"] == "Trusted" and t["r"] == "Small Seller" and t["s"] is None


def test_confidence_weight(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "verified_purchase boolean")
    w = [r["confidence_weight"] for r in G.apply_confidence_weight(df).collect()]
    assert w == [1.0, 0.7, None]


def test_text_filters(spark):
    df = spark.createDataFrame([("one two",), ("  a b c d e f  ",), (None,)], "text string")
    out = [r["text"] for r in C.filter_text(df, "text", 3, 4).collect()]
    assert out == [None, "a b c d", None]


def test_clean_fields(spark):
    df = spark.createDataFrame([("<b>Hi</b>\n  there ",), ("   ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.clean_text_field("t")).collect()] == ["Hi there", "", ""]
    m = spark.createDataFrame([("[Great]  ✔️ 【x】",), ("None",)], "t string")
    assert [r[0] for r in m.select(T.clean_metadata_text("t")).collect()] == ["Great x", ""]
    h = spark.createDataFrame([("a &lt;b&gt; <i>c</i> &amp;lt;",)], "t string")
    # unescape after tag removal: the escaped tag survives as text
    assert h.select(T.clean_retrieval_text("t")).first()[0] == "a <b> c &lt;"


def test_replace_none_strings_and_arrays(spark):
    df = spark.createDataFrame([("None", [], 1), ("ok", ["x"], 2)], "s string, a array<string>, n int")
    out = C.replace_none_strings(df, ["s", "a", "n", "missing"]).collect()
    assert out[0]["s"] is None and out[0]["a"] is None and out[1]["a"] == ["x"]


def test_remove_duplicates_rejects_arrays(spark):
    df = spark.createDataFrame([(["x"],)], "a array<string>")
    with pytest.raises(ValueError):
        C.remove_duplicates(df, ["a"])


def test_encoding_keeps_originals_and_sorts_no_rows(spark, monkeypatch):
    rows = [("u2", "b", 1), ("u1", "a", 2), (None, "c", 3), ("u2", None, 4), ("u2", "b", 1), ("u10", "a", 5)]
    df = spark.createDataFrame(rows, "u string, i string, x int")
    for bound in (G.HASHED_FROM, 0):
        monkeypatch.setattr(G, "HASHED_FROM", bound)
        out, encoders = G.encode_labels(df, ["u", "i"], keep_original={"i": "i_original"})
        assert out.columns == ["u", "i", "x", "i_original"]
        users, items = {"u1": 0, "u10": 1, "u2": 2}, {"a": 0, "b": 1, "c": 2}
        assert sorted(map(tuple, out.collect()), key=str) == sorted(((users.get(u), items.get(i), x, i) for u, i, x in rows), key=str)
        assert {r.value: r.code for r in encoders["u"].collect()} == users and encoders["i"].columns == ["value", "code"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    mixed = G.encode_labels(df, ["u", "x"])[0]  # columns of different types
    assert {(r.u, r.x) for r in mixed.collect()} == {(users.get(u), x - 1) for u, _, x in rows}

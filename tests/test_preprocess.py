import numpy as np
import pytest
from pyspark.errors import PySparkException

from ranktide.models.fm import negative_samples, unseen
from ranktide.operators import preprocess as P
from ranktide.plans.q_models import K_EVAL  # noqa: F401


def test_bind_text_takes_the_first_text_of_the_three_keys(spark):
    rows = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 1), ("u2", "a", 2)], "user_id string, parent_asin string, timestamp int")
    texts = spark.createDataFrame(
        [("u1", "a", 1, "t2", "x", 2), ("u1", "a", 1, "t1", "y", 1), ("u1", "a", 9, "no", "no", 0), ("u2", "a", 2, None, "z", 0)],
        "user_id string, parent_asin string, timestamp int, title string, text string, pos int")
    got = {(r.user_id, r.parent_asin): (r.title, r.text) for r in P.bind_text(rows, texts, order=["pos"]).collect()}
    assert got == {("u1", "a"): ("t1", "y"), ("u1", "b"): (None, None), ("u2", "a"): (None, "z")}


def test_bind_text_by_reference_takes_each_text_once(spark):
    rows = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 1), ("u2", "a", 2), ("u1", "a", 1)], "user_id string, parent_asin string, timestamp int")
    named = spark.createDataFrame([("u1", "a", 1, 2, 7), ("u1", "a", 1, 1, 8), ("u1", "a", 9, 0, 7), ("u2", "a", 2, 0, 9), ("u1", "b", 1, 0, None)],
                                  "user_id string, parent_asin string, timestamp int, pos int, ref int")
    library = spark.createDataFrame([(7, "t7", "x"), (8, "t8", "z"), (8, "t8", "y"), (None, "no", "no")], "ref int, title string, text string")
    got = sorted(map(tuple, P.bind_text(rows, named, order=["pos"], library=library, ref="ref").collect()))
    assert got == [("u1", "a", 1, "t8", "y")] * 2 + [("u1", "b", 1, None, None), ("u2", "a", 2, None, None)]
    texts = named.join(library, "ref", "left")  # as with the texts on every row
    assert sorted(map(tuple, P.bind_text(rows, texts, order=["pos"]).collect())) == got


def test_missing_metadata_fails_the_job(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "parent_asin string")
    meta = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "parent_asin string, x int")
    assert P.assert_aligned(rows, meta).count() == 2
    with pytest.raises(PySparkException):
        P.assert_aligned(rows, meta.where("parent_asin = 'a'")).collect()


def test_encoders_survive_saving(spark, tmp_path):
    from ranktide.operators import features as G

    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string")
    P.save_encoders({"c": G.fit_label_codes(df, "c")}, f"file://{tmp_path}")
    loaded = P.load_encoder(spark, f"file://{tmp_path}", "c")
    coded, _ = G.encode_labels(df, ["c"], {"c": loaded})
    assert sorted(r.c for r in P.decode_labels(coded, "c", loaded).collect() if r.c) == ["x", "x", "y"]


def test_negatives_are_whole_and_unseen(spark):
    import numpy as np

    seen = {0: [0, 1, 2, 3, 4, 5, 6, 7, 8], 1: [4], 2: list(range(10))}
    train = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s] + [(1, 4)], "u int, i int")
    rows = negative_samples(train, 10, 3).collect()
    for u, s in seen.items():
        negatives = [r.i for r in rows if r.u == u and r.label == 0]
        assert len(negatives) == (0 if u == 2 else 3 * len(s)) and not set(negatives) & set(s)
        assert sorted(r.i for r in rows if r.u == u and r.label == 1) == s
    draws = unseen(np.array([1, 5]), 6, 10_000, 7)
    assert set(draws.tolist()) == {0, 2, 3, 4} and np.bincount(draws)[[0, 2, 3, 4]].min() > 4000


def test_users_of_a_batch_are_drawn_for_together():
    import pyarrow as pa

    from ranktide.models import fm

    seen = [[u % 7, 7 + u % 5] for u in range(500)] + [[]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(501), pa.int32()), pa.array(seen, pa.list_(pa.int32()))], names=["u", "seen"])
    out = list(fm._tables(20, 3, 42)([batch]))
    assert len(out) == 1
    want = [row for u, s in enumerate(seen) for row in
            [(u, i, 1.0) for i in s] + [(u, i, 0.0) for i in unseen(np.array(s, int), 20, 3, 42 * 0x9E3779B1 + u).tolist()]]
    assert list(zip(*(c.to_pylist() for c in out[0].columns))) == want


def test_texts_of_dropped_rows_are_not_written(spark, monkeypatch):
    from ranktide.plans import q_prep
    from tests.conftest import SF

    written, cut = [], P.cut_lineage

    def spy(df):
        written.append(cut(df))
        return written[-1]

    monkeypatch.setattr(P, "cut_lineage", spy)
    want = {}
    for bound in (P.KEY_BROADCAST, 0):
        monkeypatch.setattr(P, "KEY_BROADCAST", bound)
        written.clear()
        q_prep.prepared(spark, SF)
        with_text = [df for df in written if "text" in df.columns]
        assert "text" not in written[0].columns and with_text
        assert all(df.count() <= written[0].count() for df in with_text)
        want[bound] = sorted(map(str, with_text[0].select("user_id", "parent_asin", "timestamp", "title", "text").collect()))
    assert len({str(x) for x in want.values()}) == 1

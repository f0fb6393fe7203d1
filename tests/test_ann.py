"""Approximate vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranktide.models import ann


def made(spark, vectors, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, embedding array<double>")


def brute(vectors, queries, k, skip=False):
    out = {}
    for i, q in enumerate(queries):
        d = ((vectors - q) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(d)), d.round(9))) if not (skip and j == i)]
        out[i] = [(int(j), float(d[j])) for j in order[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.distance))
    return out


def test_small_catalogues_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((40, 8))
    vectors[30:] = vectors[0]  # ten equal ones, more than k
    got = answers(ann.vector_ann(made(spark, vectors, "qid"), made(spark, vectors), exclude_self=True, trees=2))
    want = brute(vectors, vectors, 5, skip=True)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    assert ann.vector_ann(none, made(spark, vectors), trees=2).collect() == []
    odd = spark.createDataFrame([(1, None), (None, [0.0] * 8)], "qid long, embedding array<double>")
    assert ann.vector_ann(odd, made(spark, vectors), trees=2).collect() == []


def test_recall_with_a_crowded_bucket(spark, monkeypatch):
    """A third of all vectors lie within a hundredth of one place and a third of the rest are equal: both are split or
    merged, no bucket stays crowded, and recall holds inside the cluster as outside."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((1500, 16))
    vectors[:500] = vectors[0] + rng.standard_normal((500, 16)) * 1e-2
    vectors[500:800] = vectors[500]
    monkeypatch.setattr(ann, "SAMPLE", 256)  # several stages
    sizes, packed = [], ann._thresholds

    def spy(rows, leaf, seed):
        out = packed(rows, leaf, seed)
        sizes.append(rows.groupBy("tree", "bucket").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ann, "_thresholds", spy)
    queries = made(spark, vectors, "qid").where("qid % 10 = 3")
    got = answers(ann.vector_ann(queries, made(spark, vectors), trees=8, probes=4, leaf=100))
    want = brute(vectors, vectors, 5)
    assert len(sizes) > 2 and sizes[-1] <= 100
    assert all(len(v) == 5 for v in got.values())
    shares = {q: len({i for i, _ in v} & {i for i, _ in want[q]}) / 5 for q, v in got.items()}
    assert np.mean(list(shares.values())) >= 0.9
    assert np.mean([s for q, s in shares.items() if q < 500]) >= 0.9
    for q, v in got.items():
        for i, d in v:
            assert d == pytest.approx(((vectors[q] - vectors[i]) ** 2).sum(), rel=1e-9, abs=1e-18)


def test_vectors_are_packed_as_short_as_they_can_be():
    short, wide = np.array([0.5, -3.25, 1e-40]).astype(np.float32), np.array([0.1, 1e300, 2.0])
    assert len(ann._packed(short.tolist())) == 1 + 12 and len(ann._packed(wide.tolist())) == 1 + 24
    assert ann._vector(ann._packed(short.tolist())).tolist() == short.astype(float).tolist()
    assert ann._vector(ann._packed(wide.tolist())).tolist() == wide.tolist()

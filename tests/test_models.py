"""Recommenders on a planted-structure fixture: users and items in matching
clusters, so a working model must beat random ranking."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ranktide.models import hybrid as H
from ranktide.models import knn as K
from ranktide.models.blocks import fit_svd
from ranktide.models.factors import fit_als
from ranktide.models.strata import fit_bpr
from ranktide.models.topk import blocked_topk
from ranktide.operators import evaluate as N

N_USERS, N_ITEMS, N_CLUSTERS = 120, 60, 4


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    train, truth = [], []
    per = N_ITEMS // N_CLUSTERS
    for u in range(N_USERS):
        c = u % N_CLUSTERS
        items = rng.permutation(np.arange(c * per, (c + 1) * per))
        train += [(u, int(i), 1.0) for i in items[:8]]
        truth += [(u, int(i)) for i in items[8:11]]
    tr = spark.createDataFrame(train, "u int, i int, value double")
    tv = spark.createDataFrame(truth, "u int, i int")
    return tr, tv, tv.select("u").distinct()


def _ndcg(recs, truth, users):
    return N.evaluate_at_k(recs, truth, users, 10).first()


def _no_seen(recs, train):
    return recs.join(train, ["u", "i"]).count() == 0


RANDOM_NDCG = 0.2   # three relevant of 60 items: random ranking scores far below


def test_knn_beats_random(spark, planted):
    tr, tv, us = planted
    recs = K.ItemKNN(5, 5).fit(tr).recommend(10)
    m = _ndcg(recs, tv, us)
    assert m["ndcg"] > RANDOM_NDCG and _no_seen(recs, tr)
    assert 0 <= m["precision"] <= m["hit_rate"] <= 1


def test_knn_chunking_is_exact(spark, planted):
    tr, _, _ = planted
    a = {(r["i"], r["j"]): r["dot"] for r in K.cooccurrence(tr, chunk=512).collect()}
    b = {(r["i"], r["j"]): r["dot"] for r in K.cooccurrence(tr, chunk=3).collect()}
    assert a == b


def test_als_beats_random(spark, planted):
    tr, tv, us = planted
    m = fit_als(tr, rank=8, reg=0.05, iterations=10)
    recs = m.recommend(tr, 10, only_users=us)
    assert _ndcg(recs, tv, us)["ndcg"] > RANDOM_NDCG and _no_seen(recs, tr)


def test_svd_matches_numpy(spark, planted):
    tr, tv, us = planted
    m = fit_svd(tr, k=4, oversample=6, power_iters=6)
    a = np.zeros((N_USERS, N_ITEMS))
    for r in tr.collect():
        a[r["u"], r["i"]] = r["value"]
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    recon = (u[:, :4] * s[:4]) @ vt[:4]
    uf = {r["u"]: np.asarray(r["features"]) for r in m.users.collect()}
    itf = np.stack([np.asarray(r["features"]) for r in m.items.orderBy("i").collect()])
    mine = np.stack([uf[i] for i in range(N_USERS)]) @ itf.T
    assert np.allclose(mine, recon, atol=1e-5)
    # rank-k error equals the optimum (Eckart-Young)
    assert np.linalg.norm(a - mine) == pytest.approx(np.linalg.norm(a - recon), rel=1e-9)
    assert _ndcg(m.recommend(tr, 10, only_users=us), tv, us)["ndcg"] > RANDOM_NDCG


def test_bpr_beats_random(spark, planted):
    tr, tv, us = planted
    m = fit_bpr(tr, factors=8, lr=0.05, reg=0.01, epochs=15)
    recs = m.recommend(tr, 10, only_users=us)
    assert _ndcg(recs, tv, us)["ndcg"] > RANDOM_NDCG and _no_seen(recs, tr)


def test_blocked_topk_blocks_agree(spark, planted):
    tr, _, _ = planted
    m = fit_svd(tr, k=4, oversample=4, power_iters=1)
    one = m.recommend(tr, 5)
    users = m.users.join(tr.groupBy("u").agg(F.collect_set("i").alias("seen")), "u")
    many = blocked_topk(users, m.items, 5, metric="dot", exclude_col="seen", block_bytes=200)
    key = lambda d: sorted((r["u"], r["i"], r["rank"]) for r in d.collect())
    assert key(one) == key(many)


def test_hybrid_alpha_one_is_side_a(spark, planted):
    tr, _, _ = planted
    a = K.ItemKNN(5, 5).fit(tr).recommend(50).select("u", "i", "score")
    b = a.select("u", "i", (-F.col("score")).alias("score"))
    fused = H.fuse(a, b, 1.0, 10)
    ranked = K.top_k_per_user(a, 10)
    key = lambda d: sorted((r["u"], r["i"]) for r in d.collect())
    assert key(fused) == key(ranked)


def test_metrics_hand_computed(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "u int, i int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "u int, i int")
    users = spark.createDataFrame([(1,), (2,)], "u int")
    m = N.evaluate_at_k(recs, truth, users, 3).first()
    assert m["hit_rate"] == 0.5                     # over all requested users
    assert m["precision"] == pytest.approx(round((1 / 3 + 0) / 2, 4))
    assert m["recall"] == pytest.approx(0.25) and m["mrr"] == pytest.approx(0.25)
    idcg = 1 + 1 / np.log2(3)
    assert m["ndcg"] == pytest.approx(round((1 / np.log2(3)) / idcg / 2, 4))


def _brute_sparse(rows_q, rows_c, k, exclude_self, normalize):
    """Reference top-k by plain Python dictionaries (positive scores, ties by id)."""
    cat = {}
    for c, t, v in rows_c:
        cat.setdefault(c, {})[t] = v
    out = set()
    for q, idx, val in rows_q:
        qv = dict(zip(idx, val))
        nq = np.sqrt(sum(x * x for x in val)) if normalize else 1.0
        sc = []
        for c, cv in cat.items():
            if exclude_self and c == q:
                continue
            s = sum(w * cv.get(t, 0.0) for t, w in qv.items()) / nq
            if s > 0:
                sc.append((-round(s, 9), c))
        for r, (_, c) in enumerate(sorted(sc)[:k], 1):
            out.add((q, c, r))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 28, 64])
def test_sparse_topk_matches_brute_force(spark, block_bytes):
    from ranktide.models.topk import sparse_topk

    rng = np.random.default_rng(3)
    rows_c = []
    for c in range(40):
        # term 0 is shared by every item, as a frequent word is
        terms = [0] + sorted(rng.choice(np.arange(1, 30), size=int(rng.integers(0, 6)), replace=False).tolist())
        rows_c += [(f"c{c:03d}", int(t), float(rng.integers(1, 4))) for t in terms]
    vecs = {}
    for c, t, v in rows_c:
        vecs.setdefault(c, ([], []))
        vecs[c][0].append(t)
        vecs[c][1].append(v)
    rows_q = [(c, i, v) for c, (i, v) in vecs.items()]
    cat = spark.createDataFrame(rows_c, "cid string, idx int, val double")
    q = spark.createDataFrame(rows_q, "qid string, idx array<int>, val array<double>")
    got = sparse_topk(q, cat, 4, qid="qid", cid="cid", exclude_self=True, normalize_query=True,
                      block_bytes=block_bytes)
    assert {(r["qid"], r["cid"], r["rank"]) for r in got.collect()} == _brute_sparse(rows_q, rows_c, 4, True, True)
    every = sparse_topk(q, cat, None, qid="qid", cid="cid", block_bytes=block_bytes)
    assert {(r["qid"], r["cid"], r["rank"]) for r in every.collect()} == _brute_sparse(rows_q, rows_c, 99, False, False)


@pytest.mark.parametrize("block_bytes", [1 << 28, 200])
def test_fused_content_side_matches_materialised_fusion(spark, block_bytes):
    """Fusion inside the scorer equals fusing the fully materialised content table."""
    from ranktide.models import tfidf as TF

    rng = np.random.default_rng(5)
    vocab = ["red", "blue", "green", "lamp", "desk", "chair", "soft", "wood", "metal", "glass"]
    docs = [(f"i{j:02d}", " ".join(rng.choice(vocab, size=int(rng.integers(2, 7))))) for j in range(30)]
    w = TF.tfidf(spark.createDataFrame(docs, "item string, text string"), max_features=40)
    hist = spark.createDataFrame(
        [(f"u{u}", f"i{int(j):02d}") for u in range(12) for j in rng.choice(34, size=3, replace=False)],
        "u string, i string")
    side_a = spark.createDataFrame(
        [(f"u{u}", f"i{int(j):02d}", float(rng.integers(1, 5))) for u in range(0, 14, 2)
         for j in rng.choice(34, size=4, replace=False)],
        "u string, i string, score double").join(hist, ["u", "i"], "left_anti")
    alphas = [0.0, 0.7, 1.0]
    b = TF.user_scores(hist, w, None).select("u", "i", "score")
    want = {(r["alpha"], r["u"], r["i"], r["rank"]) for r in H.fuse_grid(side_a, b, alphas, 5).collect()}
    got = H.fuse_with_content(side_a, hist, w, alphas, 5, block_bytes=block_bytes)
    assert {(r["alpha"], r["u"], r["i"], r["rank"]) for r in got.collect()} == want


def test_profile_in_task_matches_spark_profiles(spark):
    """Summing a user's item rows inside the scorer equals the (user, term) aggregate."""
    from ranktide.models import tfidf as TF

    rng = np.random.default_rng(9)
    vocab = ["oak", "pine", "birch", "lamp", "shade", "bulb", "rug", "wool", "silk", "jute"]
    docs = [(f"i{j:02d}", " ".join(rng.choice(vocab, size=int(rng.integers(1, 6))))) for j in range(25)]
    w = TF.tfidf(spark.createDataFrame(docs, "item string, text string"), max_features=30)
    hist = spark.createDataFrame(
        [(f"u{u}", f"i{int(j):02d}") for u in range(10) for j in rng.choice(28, size=4, replace=False)],
        "u string, i string")
    key = lambda d: {(r["u"], r["i"], r["rank"], round(r["score"], 9)) for r in d.collect()}
    assert TF.profile_queries(hist, w)[1] and not TF.profile_queries(hist, w, block_bytes=64)[1]
    assert key(TF.user_scores(hist, w, 4)) == key(TF.user_scores(hist, w, 4, block_bytes=64))


def test_sparse_sides_never_pass_the_driver(spark, monkeypatch):
    """Neither the catalogue nor its blocks are collected or broadcast, and blocks fuse as one table does."""
    from ranktide.models import hybrid as H
    from ranktide.models import tfidf as TF

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(f"i{n:02d}", " ".join(rng.choice(list(TERMS), 6))) for n in range(30)] + [("i98", "w1 w2"), ("i99", "w1 w2")],
                                 "item string, text string")
    w = TF.tfidf(docs, max_features=200)
    hist = spark.createDataFrame([(f"u{n}", f"i{rng.integers(0, 30):02d}") for n in range(9) for _ in range(3)], "u string, i string")
    side = spark.createDataFrame([(f"u{n}", f"i{m:02d}", float(rng.random())) for n in range(9) for m in (2, 5, 99)] + [("u0", "none", 0.5)],
                                 "u string, i string, score double")

    def refuse(*_, **__):
        raise AssertionError("the catalogue went through the driver")

    monkeypatch.setattr(type(w), "toArrow", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    want = sorted(H.fuse_grid(side, TF.user_scores(hist, w), (0.0, 0.7, 1.0), 6).select("alpha", "u", "i", "rank").collect())
    for block_bytes in (1 << 23, 512):
        got = H.fuse_with_content(side, hist, w, (0.0, 0.7, 1.0), 6, block_bytes=block_bytes)
        assert sorted(got.select("alpha", "u", "i", "rank").collect()) == want


TERMS = tuple(f"w{n}" for n in range(12))


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_blocked_topk_in_slices_copies_little(spark, monkeypatch, metric):
    """A block scored in slices gives what one product gives, ties by id, and a block is not copied per shuffle partition."""
    from ranktide.models import topk

    rng = np.random.default_rng(5)
    c = rng.integers(-2, 3, (60, 3)).astype(float)  # many ties
    cat = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(c)], "i int, features array<double>")
    q = spark.createDataFrame([(n, c[n].tolist()) for n in range(20)], "u int, features array<double>")
    monkeypatch.setattr(topk, "DENSE_SLICE_BYTES", 7 * 8 * 3, raising=False)
    scored = topk._score_blocks(4, metric, (pa.int32(), pa.int32()), True, False)
    ids = [pa.array([list(range(n))], pa.list_(pa.int32())) for n in (20, 60)]
    met = pa.RecordBatch.from_arrays([ids[0], pa.array([c[:20].tobytes()]), ids[1], pa.array([c.tobytes()])], names=["_q", "_qv", "_c", "_cv"])
    got = [(a, b, r) for x in scored([met]) for a, b, r in zip(*(x.column(n).to_pylist() for n in ("_qid", "_cid", "rank")))]
    key = -(c[:20] @ c.T) if metric == "dot" else ((c[:20, None] - c[None]) ** 2).sum(axis=2)
    want = [(u, i, r + 1) for u in range(20) for r, i in enumerate(sorted((i for i in range(60) if i != u), key=lambda i: (key[u, i], i))[:4])]
    assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    plan = topk.blocked_topk(q, cat, 4, metric=metric)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "299" not in plan


def test_knn_sums_in_parts_and_keeps_the_nearest(spark, monkeypatch):
    """A user and an item with a third of all rows, chunks and parts: the nearest neighbours are those of the whole
    matrix, and only they leave the tasks that sum."""
    rng = np.random.default_rng(11)
    a = (rng.random((60, 40)) < 0.15) * rng.integers(1, 4, (60, 40)).astype(float)
    a[0], a[:, 7] = 1.0, 2.0
    rows = [(f"u{u:02d}", f"i{i:02d}", float(a[u, i])) for u, i in zip(*np.nonzero(a))]
    m = spark.createDataFrame(rows + [(None, "i01", 1.0), ("u01", None, 1.0)], "u string, i string, value double")
    unit = a / np.sqrt((a ** 2).sum(axis=0) + (np.arange(40) == 1))   # the row without a user counts in the norm
    sim, met = unit.T @ unit, (a.T @ a) > 0
    want = {}
    for i in range(40):
        js = sorted((j for j in range(40) if j != i and met[i, j]), key=lambda j: (-round(sim[i, j], 9), j))
        want |= {(f"i{i:02d}", f"i{j:02d}"): (r + 1, sim[i, j]) for r, j in enumerate(js[:3])}
    for split, chunk in ((K.SPLIT, 512), (20, 5)):
        monkeypatch.setattr(K, "SPLIT", split)
        near = K.item_similarity(m, chunk=chunk, nearest=3)
        assert split == 20 or near.count() == len(want)
        got = {(r["item"], r["neighbor"]): (r["rank"], r["sim"]) for r in K.similar_items(near, 3).collect()}
        assert got.keys() == want.keys()
        assert all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-12 for p in want)
        whole = K.item_similarity(m, chunk=chunk).collect()
        assert len(whole) == met.sum() - 40
        pairs = {(r["i"], r["j"]): r["dot"] for r in K.cooccurrence(m, chunk=chunk).collect()}
        assert pairs == {(f"i{i:02d}", f"i{j:02d}"): (a.T @ a)[i, j] for i in range(40) for j in range(i + 1, 40) if met[i, j]}


def test_floats_are_scored_as_doubles_and_packed_as_floats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(50)]
    short = spark.createDataFrame(rows, "i int, v array<float>")
    wide = short.select("i", F.col("v").cast("array<double>").alias("v"))
    blocks, got = [], []
    for df in (short, wide):
        out = blocked_topk(df.withColumnRenamed("i", "u"), df, 4, vec="v", exclude_self=True, block_bytes=50 * 6 * 4)
        blocks.append("RANGE" in out._jdf.queryExecution().toString() or "Window" in out._jdf.queryExecution().toString())
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] and blocks == [False, True]   # one block of floats, two of doubles


def test_bpr_keeps_no_more_files_for_more_rounds(spark):
    import os
    from urllib.parse import urlparse

    from ranktide.models.strata import fit_bpr
    from ranktide.session import FREED, checkpoint_dir

    folder = urlparse(checkpoint_dir(spark)).path
    train = spark.createDataFrame([(u, i) for u in range(24) for i in range(30) if (u + i) % 3 == 0], "u int, i int")

    def files(epochs):
        before = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
        model = fit_bpr(train, factors=2, epochs=epochs, passes=1, blocks=2)
        assert len(model.losses) == epochs and model.users.count() == 24 and model.items.count() == 30
        return len({os.path.join(d, f) for d, _, names in os.walk(folder) for f in names} - before)

    assert files(5) <= files(1) + 4
    assert spark.conf.get(FREED, "false") == "false"


def test_tfidf_tasks_grow_with_the_texts(spark, monkeypatch):
    from ranktide.models import tfidf as TF

    docs = [(f"i{n % 45}", " ".join(f"word{(n * 7 + j) % 30}" for j in range(20))) for n in range(50)] + [("none", None), (None, "word1 word2")]
    docs = spark.createDataFrame(docs, "item string, text string")
    written, cut = [], TF.cut_lineage
    monkeypatch.setattr(TF, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    rows = lambda: sorted(((r.item, r.term, r.idx, round(r.weight, 9)) for r in TF.tfidf(docs, max_features=40).collect()), key=str)
    want = rows()
    monkeypatch.setattr(TF, "CHARS_PER_TASK", 100)
    written.clear()
    assert rows() == want
    counts = next(df for df in written if "tf" in df.columns)
    assert counts.rdd.getNumPartitions() > 50
    places = counts.selectExpr("item", "spark_partition_id() as p").distinct().groupBy("item").count()
    assert places.where("count > 1").isEmpty() and counts.groupBy("item", "term").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("kind, scale", [(np.float32, 1.0), (np.float64, 1.0), (np.float64, 1e-9), (np.float64, 1e18), (np.float64, 1e200)])
def test_products_screened_in_short_floats_are_exact(kind, scale, monkeypatch):
    """Scores that differ by less than the shorter floats tell, ties by id, vectors too long for them, masked entries."""
    from ranktide.models import topk

    rng = np.random.default_rng(8)
    c = rng.standard_normal((300, 16))
    c[100:] = c[:200] * (1 + rng.integers(-2, 3, (200, 1)) * 1e-8)   # many that floats hold for the same
    c, q = (c * scale).astype(kind), rng.standard_normal((9, 16)).astype(kind)
    monkeypatch.setattr(topk, "DENSE_SLICE_BYTES", 37 * 8 * 16)
    ids = [pa.array([list(range(n))], pa.list_(pa.int32())) for n in (9, 300)]
    none = [pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary())]
    seen = [[n, 299 - n] for n in range(9)]
    lists = pa.list_(pa.list_(pa.int32()))
    names = ["_q", "_qv", "_c", "_cv", "_seen"]
    block = pa.RecordBatch.from_arrays([*none, ids[1], pa.array([c.tobytes()]), pa.nulls(1, lists)], names=names)
    chunk = pa.RecordBatch.from_arrays([ids[0], pa.array([q.tobytes()]), *none, pa.array([seen], lists)], names=names)
    scored = topk._score_blocks(7, "dot", (pa.int32(), pa.int32()), False, True, (kind, kind))
    exact = q.astype(np.float64) @ c.astype(np.float64).T
    for x in scored([block, chunk, chunk]):   # the block comes once
        got = list(zip(*(x.column(n).to_pylist() for n in ("_qid", "_cid", "rank"))))
        want = [(u, i, r + 1) for u in range(9) for r, i in enumerate(sorted(
            (i for i in range(300) if i not in seen[u]), key=lambda i: (round(-exact[u, i], 9), i))[:7])]
        if scale < 1e10:
            assert got == want
        else:   # sums of this size differ in their last places by the order of their terms
            np.testing.assert_allclose(x.column("score").to_pylist(), [exact[u, i] for u, i, _ in want], rtol=1e-12)
    assert sum(1 for _ in scored([block, chunk, chunk])) == 2


def test_recommendations_start_from_written_neighbours(spark):
    """What met for the similarities is not shuffled in the job that shuffles the users' candidates."""
    m = spark.createDataFrame([(f"u{n % 5}", f"i{n * n % 7}", 1.0) for n in range(30)], "u string, i string, value double").distinct()
    recs = K.ItemKNN(3, 3).fit(m).recommend(2)
    assert "MapInArrow" not in recs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(recs.collect()) == sorted(K.recommend_for_users(m, K.ItemKNN(3, 3).fit(m).similar(3), 2).collect())

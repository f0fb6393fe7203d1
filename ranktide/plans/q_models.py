"""Queries for recommenders and ranking metrics (M*, N*)."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.functions.relational import r6
from ranktide.models import knn as K
from ranktide.operators import clean as C
from ranktide.operators import evaluate as N
from ranktide.operators import interactions as I
from ranktide.plans.q_filters import DEDUP_SQL
from ranktide.plans.registry import register
from ranktide.session import cut_lineage
from ranktide.sources import fixtures as fx

# Fixture stand-ins: train < 2000, validation = 2000, date floor 1996 (FIXTURES.md).
VAL_YEAR, FLOOR = 2000, "1996-01-01"
K_EVAL = 10
KNN_NEIGHBORS = 5


@dataclass
class ModelFrames:
    train: DataFrame   # (u, i, value) with u = user_id, i = parent_asin
    truth: DataFrame   # (u, i) validation pairs
    users: DataFrame   # (u) validation users = requested users


def _dedup_narrow(spark, sf_dir):
    """De-duplicated (user, item, time): projected before the de-dup so the
    aggregate carries only the columns the models use."""
    r = fx.reviews(spark, sf_dir).select("user_id", "parent_asin", "timestamp", *fx.REVIEW_TIEBREAK)
    return I.dedup_user_item(r, order=["timestamp", *fx.REVIEW_TIEBREAK])


def model_frames(spark, sf_dir, val_year: int = VAL_YEAR) -> ModelFrames:
    r = _dedup_narrow(spark, sf_dir)
    r = C.date_floor(r, "timestamp", FLOOR).select(
        F.col("user_id").alias("u"), F.col("parent_asin").alias("i"), F.year("timestamp").alias("_y")
    )
    # the interaction table feeds degrees, chunks, norms, seen lists and truth:
    # write it once to the checkpoint folder instead of recomputing it per use
    r = cut_lineage(r)
    train = r.where(F.col("_y") < val_year).groupBy("u", "i").agg(F.count(F.lit(1)).cast("double").alias("value"))
    truth = r.where(F.col("_y") == val_year).select("u", "i").distinct()
    return ModelFrames(cut_lineage(train), truth, truth.select("u").distinct())


FRAMES_SQL = f"""
WITH dd AS ({DEDUP_SQL}),
f AS (SELECT user_id AS u, parent_asin AS i, year(timestamp) AS y FROM dd WHERE timestamp >= TIMESTAMP '{FLOOR}'),
tr AS (SELECT u, i, CAST(COUNT(*) AS DOUBLE) AS value FROM f WHERE y < {VAL_YEAR} GROUP BY u, i),
va AS (SELECT DISTINCT u, i FROM f WHERE y = {VAL_YEAR}),
eu AS (SELECT DISTINCT u FROM va),
seen AS (SELECT DISTINCT u, i FROM tr),
"""

KNN_SQL = FRAMES_SQL + f"""
nrm AS (SELECT i, SQRT(SUM(value * value)) AS norm FROM tr GROUP BY i),
co AS (SELECT a.i AS i, b.i AS j, SUM(a.value * b.value) AS dot FROM tr a JOIN tr b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2),
s1 AS (SELECT co.i, co.j, dot / (n1.norm * n2.norm) AS sim FROM co JOIN nrm n1 ON n1.i = co.i JOIN nrm n2 ON n2.i = co.j),
sim AS (SELECT i AS item, j AS neighbor, sim FROM s1 UNION ALL SELECT j AS item, i AS neighbor, sim FROM s1),
nb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY ROUND(sim, 9) DESC, neighbor) AS rank FROM sim),
nbk AS (SELECT * FROM nb WHERE rank <= {KNN_NEIGHBORS}),
cand AS (SELECT s.u, nbk.neighbor AS i, nbk.sim FROM seen s JOIN nbk ON nbk.item = s.i),
sc AS (SELECT u, i, SUM(sim) AS score FROM cand
       WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.u = cand.u AND x.i = cand.i) GROUP BY u, i),
recs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY u ORDER BY ROUND(score, 9) DESC, i) AS rank FROM sc)
         WHERE rank <= {K_EVAL}),
"""


def metrics_sql(recs_cte: str = "recs", k: int = K_EVAL) -> str:
    return f"""
ts AS (SELECT u, COUNT(*) AS n_truth FROM va GROUP BY u),
h AS (SELECT r.u, COUNT(*) AS hits, MIN(r.rank) AS fh, SUM(1.0 / log2(r.rank + 1)) AS dcg
      FROM {recs_cte} r JOIN va ON va.u = r.u AND va.i = r.i WHERE r.rank <= {k} GROUP BY r.u),
per AS (SELECT ts.u, n_truth, COALESCE(hits, 0) AS hits, fh, COALESCE(dcg, 0.0) AS dcg, LEAST({k}, n_truth) AS p
        FROM ts JOIN eu ON eu.u = ts.u LEFT JOIN h ON h.u = ts.u),
pm AS (SELECT *, hits / {float(k)} AS prec, CASE WHEN p > 0 THEN hits / p ELSE 0.0 END AS adj,
              hits / n_truth AS rec, COALESCE(1.0 / fh, 0.0) AS mrr,
              dcg / list_sum(list_transform(range(1, p + 1), lambda r: 1.0 / log2(r + 1))) AS ndcg FROM per)
SELECT ROUND(COUNT(*) FILTER (WHERE hits > 0) / (SELECT COUNT(*) FROM eu), 4) AS hit_rate,
       ROUND(AVG(prec), 4) AS precision, ROUND(AVG(adj), 4) AS adj_precision, ROUND(AVG(rec), 4) AS recall,
       ROUND(AVG(mrr), 4) AS mrr, ROUND(AVG(ndcg), 4) AS ndcg, COUNT(*) AS n_scored,
       (SELECT COUNT(*) FROM eu) AS n_users
FROM pm"""


def _knn(spark, sf_dir):
    mf = model_frames(spark, sf_dir)
    return mf, K.ItemKNN(n_neighbors=KNN_NEIGHBORS, user_neighbors=KNN_NEIGHBORS).fit(mf.train)


@register(
    "knn_similar_items",
    KNN_SQL.rstrip().rstrip(",")
    + "\nSELECT item, neighbor, ROUND(sim, 6) AS sim, rank, ROUND(1 - sim, 6) AS distance FROM nbk",
    raw_sql=True,
)
def q_knn_similar_items(spark, sf_dir):
    _, model = _knn(spark, sf_dir)
    out = model.similar(KNN_NEIGHBORS)
    return out.select("item", "neighbor", r6("sim").alias("sim"), "rank", r6("distance").alias("distance"))


@register(
    "knn_user_recs",
    KNN_SQL.rstrip().rstrip(",") + "\nSELECT u, i, ROUND(score, 6) AS score, rank FROM recs",
    raw_sql=True,
)
def q_knn_user_recs(spark, sf_dir):
    _, model = _knn(spark, sf_dir)
    return model.recommend(K_EVAL).select("u", "i", r6("score").alias("score"), "rank")


@register("ranking_metrics", KNN_SQL + metrics_sql(), raw_sql=True)
def q_ranking_metrics(spark, sf_dir):
    mf, model = _knn(spark, sf_dir)
    return N.evaluate_at_k(model.recommend(K_EVAL), mf.truth, mf.users, K_EVAL)


_METRICS = ("hit_rate", "precision", "adj_precision", "recall", "mrr", "ndcg")


@register("metrics_melt", KNN_SQL + "m AS (WITH " + metrics_sql().lstrip()
          + f") SELECT 'ItemKNN' AS model, metric, value::DOUBLE AS value FROM (UNPIVOT m ON {', '.join(_METRICS)} "
            "INTO NAME metric VALUE value)")
def q_metrics_melt(spark, sf_dir):
    """The metrics of a run in long form."""
    mf, model = _knn(spark, sf_dir)
    m = N.evaluate_at_k(model.recommend(K_EVAL), mf.truth, mf.users, K_EVAL).select(F.lit("ItemKNN").alias("model"), "*")
    return N.metrics_long(m, metrics=_METRICS)


def _log_sql(step: int) -> str:
    return (f"SELECT 'ItemKNN' AS run, 'metric' AS kind, metric AS key, value::DOUBLE AS value, {step} AS step FROM "
            f"(UNPIVOT m{step} ON {', '.join(_METRICS)} INTO NAME metric VALUE value) UNION ALL "
            f"SELECT 'ItemKNN', 'param', 'neighbors', {KNN_NEIGHBORS}, {step} UNION ALL SELECT 'ItemKNN', 'param', 'k', {step}, {step}")


@register("run_log", KNN_SQL + f"m5 AS (WITH {metrics_sql(k=5).lstrip()}), m10 AS (WITH {metrics_sql(k=10).lstrip()}) "
          + _log_sql(5) + " UNION ALL " + _log_sql(10))
def q_run_log(spark, sf_dir):
    """Two evaluations appended to a run table, read back."""
    from ranktide.sources import io as IO

    mf, model = _knn(spark, sf_dir)
    recs = cut_lineage(model.recommend(K_EVAL))
    path = IO.scratch_path(spark, "run-log")
    for k in (5, K_EVAL):
        m = N.evaluate_at_k(recs, mf.truth, mf.users, k).select(F.lit("ItemKNN").alias("model"), "*")
        N.append_run_log(N.run_log_rows(m, {"neighbors": KNN_NEIGHBORS, "k": k}, k, metrics=_METRICS), path)
    return spark.read.parquet(path)


_LOGS_SQL = (KNN_SQL + f"m5 AS (WITH {metrics_sql(k=5).lstrip()}), m10 AS (WITH {metrics_sql(k=10).lstrip()}), "
             f"log AS ({_log_sql(5)} UNION ALL {_log_sql(10)})")


@register("run_champion", _LOGS_SQL + """, best AS (
    SELECT run, step FROM log WHERE kind = 'metric' AND key = 'ndcg' ORDER BY value DESC, step, run LIMIT 1)
    SELECT run, step, kind, 'champion_' || key AS key, value FROM log JOIN best USING (run, step)""")
def q_run_champion(spark, sf_dir):
    """Of two logged evaluations the one of the best NDCG."""
    return N.champion(q_run_log(spark, sf_dir))


@register("saved_knn_recs", KNN_SQL.rstrip().rstrip(",") + "\nSELECT u, i, ROUND(score, 6) AS score, rank FROM recs")
def q_saved_knn_recs(spark, sf_dir):
    """Neighbours and history saved as a version, loaded, recommended from."""
    from ranktide.models import store
    from ranktide.sources import io as IO

    mf, model = _knn(spark, sf_dir)
    root = IO.scratch_path(spark, "models")
    number = store.save(root, "ItemKNN", {"neighbors": model.similar(KNN_NEIGHBORS), "train": mf.train},
                        {"neighbors": KNN_NEIGHBORS})
    kept = store.load(spark, root, "ItemKNN", number).tables
    return K.recommend_for_users(kept["train"], kept["neighbors"], K_EVAL).select("u", "i", r6("score").alias("score"), "rank")


# ------------------------------------------------------------------ coded frames for factor models
@dataclass
class CodedFrames:
    train: DataFrame   # (u, i, value) int codes
    truth: DataFrame   # (u, i)
    users: DataFrame   # (u)
    n_users: int
    n_items: int


def _once(build):
    """One build per application and input: its frames are tables in the checkpoint folder, which queries share."""
    kept = {}

    @functools.wraps(build)
    def get(spark, sf_dir):
        key = spark.sparkContext.applicationId, sf_dir
        if key not in kept:
            kept[key] = build(spark, sf_dir)
        return kept[key]

    return get


@_once
def coded_frames(spark, sf_dir) -> CodedFrames:
    from ranktide.operators import features as G

    r = C.date_floor(_dedup_narrow(spark, sf_dir), "timestamp", FLOOR).select(
        "user_id", "parent_asin", F.year("timestamp").alias("_y")
    )
    # one materialised input for the two code fits and both long tables
    r = cut_lineage(r)
    tr = r.where(F.col("_y") < VAL_YEAR)
    va = r.where(F.col("_y") == VAL_YEAR)
    mats = G.prepare_interaction_matrices(tr, va)
    train = cut_lineage(mats.train)
    truth = cut_lineage(mats.val.select("u", "i"))
    n_users = mats.users.count()
    n_items = mats.items.count()
    return CodedFrames(train, truth, truth.select("u").distinct(), n_users, n_items)


def _factor_recs(model, cf: CodedFrames):
    return model.recommend(cf.train, K_EVAL, only_users=cf.users)


# Model parameters: the reference's configuration, trimmed only
# where noted for local runs.
ALS_PARAMS = dict(rank=64, reg=0.1, iterations=20)
SVD_PARAMS = dict(k=64, oversample=10, power_iters=2)
BPR_PARAMS = dict(factors=64, lr=0.01, reg=0.01, epochs=100)
FM_PARAMS = dict(dim=32, rate=0.05, epochs=5, batches=2, negatives=4)


def _written(model):
    return type(model)(cut_lineage(model.users), cut_lineage(model.items), model.losses, model.values)


@_once
def _als(spark, sf_dir):
    from ranktide.models.factors import fit_als

    cf = coded_frames(spark, sf_dir)
    return cf, _written(fit_als(cf.train, **ALS_PARAMS))


@_once
def _svd(spark, sf_dir):
    from ranktide.models.blocks import fit_svd

    cf = coded_frames(spark, sf_dir)
    return cf, _written(fit_svd(cf.train, **SVD_PARAMS))


@_once
def _bpr(spark, sf_dir):
    from ranktide.models.strata import fit_bpr

    cf = coded_frames(spark, sf_dir)
    return cf, _written(fit_bpr(cf.train, **BPR_PARAMS))


@_once
def _fm(spark, sf_dir):
    from ranktide.models.pairwise import fit_pairwise

    cf = coded_frames(spark, sf_dir)
    return cf, _written(fit_pairwise(cf.train, cf.n_items, **FM_PARAMS)[0])


@register("als_recs")
def q_als_recs(spark, sf_dir):
    cf, m = _als(spark, sf_dir)
    return _factor_recs(m, cf)


@register("als_similar_items")
def q_als_similar_items(spark, sf_dir):
    _, m = _als(spark, sf_dir)
    return m.similar_items(10)


@register("als_metrics")
def q_als_metrics(spark, sf_dir):
    cf, m = _als(spark, sf_dir)
    return N.evaluate_at_k(_factor_recs(m, cf), cf.truth, cf.users, K_EVAL)


@register("svd_recs")
def q_svd_recs(spark, sf_dir):
    cf, m = _svd(spark, sf_dir)
    return _factor_recs(m, cf)


@register("svd_similar_items")
def q_svd_similar_items(spark, sf_dir):
    _, m = _svd(spark, sf_dir)
    return m.similar_items(10)


@register("svd_metrics")
def q_svd_metrics(spark, sf_dir):
    cf, m = _svd(spark, sf_dir)
    return N.evaluate_at_k(_factor_recs(m, cf), cf.truth, cf.users, K_EVAL)


@register("bpr_recs")
def q_bpr_recs(spark, sf_dir):
    cf, m = _bpr(spark, sf_dir)
    return _factor_recs(m, cf)


@register("bpr_metrics")
def q_bpr_metrics(spark, sf_dir):
    cf, m = _bpr(spark, sf_dir)
    return N.evaluate_at_k(_factor_recs(m, cf), cf.truth, cf.users, K_EVAL)


@register("negative_samples")
def q_negative_samples(spark, sf_dir):
    from ranktide.models.fm import negative_samples

    cf = coded_frames(spark, sf_dir)
    return negative_samples(cf.train, cf.n_items, FM_PARAMS["negatives"])


CODED_SQL = FRAMES_SQL + f"""
uc AS (SELECT u, DENSE_RANK() OVER (ORDER BY u) - 1 AS c FROM (SELECT DISTINCT u FROM f WHERE y <= {VAL_YEAR})),
ic AS (SELECT i, DENSE_RANK() OVER (ORDER BY i) - 1 AS c FROM (SELECT DISTINCT i FROM f WHERE y <= {VAL_YEAR})),
"""


@register(
    "negative_samples_check",
    CODED_SQL + f"""d AS (SELECT u, COUNT(DISTINCT i) AS n FROM tr GROUP BY u)
    SELECT uc.c::INT AS u, n AS positives, {4} * n AS negatives, 0 AS seen_negatives, 0 AS outside
    FROM d JOIN uc ON uc.u = d.u""",
)
def q_negative_samples_check(spark, sf_dir):
    """Per user: positives, negatives, negatives that the user has seen, negatives outside the catalogue."""
    from ranktide.models.fm import negative_samples

    cf = coded_frames(spark, sf_dir)
    drawn = negative_samples(cf.train, cf.n_items, FM_PARAMS["negatives"])
    seen = cf.train.select("u", "i").distinct().withColumn("_seen", F.lit(1))
    return drawn.join(seen, ["u", "i"], "left").groupBy("u").agg(
        F.count_if(F.expr("label = 1")).alias("positives"), F.count_if(F.expr("label = 0")).alias("negatives"),
        F.count_if(F.expr("label = 0 AND _seen = 1")).alias("seen_negatives"),
        F.count_if(F.expr(f"i < 0 OR i >= {cf.n_items}")).alias("outside"))


def _recs_contract(model, cf: CodedFrames):
    """Per validation user known in training: recommendations, seen ones among them, and whether ranks run from 1 with
    falling scores."""
    recs = _factor_recs(model, cf)
    seen = cf.train.select("u", "i").distinct().withColumn("_seen", F.lit(1))
    known = cf.train.select("u").distinct()
    return recs.join(known, "u", "left_semi").join(seen, ["u", "i"], "left").groupBy("u").agg(
        F.count(F.lit(1)).alias("n_recs"), F.count("_seen").alias("n_seen"),
        (F.max("rank") == F.count(F.lit(1))).alias("_dense"),
        F.sort_array(F.collect_list(F.struct("rank", F.round("score", 6).alias("score")))).alias("_s"),  # at most k rows
    ).select("u", "n_recs", "n_seen", (F.col("_dense") & (F.col("_s.score") == F.reverse(F.sort_array("_s.score")))).alias("ordered"))


_CONTRACT_SQL = CODED_SQL + f"""n AS (SELECT COUNT(DISTINCT i) AS items FROM tr),
d AS (SELECT u, COUNT(DISTINCT i) AS n FROM tr GROUP BY u)
SELECT uc.c::INT AS u, LEAST({K_EVAL}, n.items - d.n) AS n_recs, 0 AS n_seen, TRUE AS ordered
FROM d JOIN uc ON uc.u = d.u JOIN eu ON eu.u = d.u CROSS JOIN n"""


@register("als_recs_check", _CONTRACT_SQL)
def q_als_recs_check(spark, sf_dir):
    cf, m = _als(spark, sf_dir)
    return _recs_contract(m, cf)


@register("svd_recs_check", _CONTRACT_SQL)
def q_svd_recs_check(spark, sf_dir):
    cf, m = _svd(spark, sf_dir)
    return _recs_contract(m, cf)


@register("bpr_recs_check", _CONTRACT_SQL)
def q_bpr_recs_check(spark, sf_dir):
    cf, m = _bpr(spark, sf_dir)
    return _recs_contract(m, cf)


@register("fm_recs_check", _CONTRACT_SQL)
def q_fm_recs_check(spark, sf_dir):
    cf, m = _fm(spark, sf_dir)
    return _recs_contract(m, cf)


@register("fm_recs")
def q_fm_recs(spark, sf_dir):
    cf, m = _fm(spark, sf_dir)
    return _factor_recs(m, cf)


@register("fm_metrics")
def q_fm_metrics(spark, sf_dir):
    cf, m = _fm(spark, sf_dir)
    return N.evaluate_at_k(_factor_recs(m, cf), cf.truth, cf.users, K_EVAL)


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """KNN, ALS, SVD and BPR trained and evaluated on one split; timings vary."""
    from ranktide.models.blocks import fit_svd
    from ranktide.models.factors import fit_als
    from ranktide.models.strata import fit_bpr

    mf = model_frames(spark, sf_dir)
    cf = coded_frames(spark, sf_dir)
    fitters = {
        "ALS": lambda: _factor_recs(fit_als(cf.train, **ALS_PARAMS), cf),
        "SVD": lambda: _factor_recs(fit_svd(cf.train, **SVD_PARAMS), cf),
        "BPR": lambda: _factor_recs(fit_bpr(cf.train, **BPR_PARAMS), cf),
    }
    coded = N.compare_models(spark, fitters, cf.truth, cf.users, K_EVAL)
    knn = N.compare_models(
        spark, {"ItemKNN": lambda: K.ItemKNN(KNN_NEIGHBORS, KNN_NEIGHBORS).fit(mf.train).recommend(K_EVAL)},
        mf.truth, mf.users, K_EVAL,
    )
    return coded.unionByName(knn).orderBy(F.desc_nulls_last("hit_rate"))


TUNING_TRIALS = 15


@register("als_tuning")
def q_als_tuning(spark, sf_dir):
    from ranktide.operators.serving import tune_als

    cf = coded_frames(spark, sf_dir)
    return tune_als(cf.train, cf.truth, cf.users, n_trials=TUNING_TRIALS)


@register("als_halving")
def q_als_halving(spark, sf_dir):
    """N3 by successive halving: the same candidates (their iterations are the budget here), survivors go on from their
    factor tables."""
    from ranktide.models import halving as H
    from ranktide.operators.serving import tuning_candidates

    cf = coded_frames(spark, sf_dir)
    trials = [H.Trial(n, c["rank"], c["reg"]) for n, c in enumerate(tuning_candidates(TUNING_TRIALS))]
    return H.search(cf.train, cf.truth, cf.users, trials)[0]


@register(
    "user_sample_fraction",
    """WITH u AS (SELECT DISTINCT user_id FROM reviews)
       SELECT user_id FROM (SELECT user_id, ROW_NUMBER() OVER (ORDER BY md5(user_id || '|42'), user_id) AS r FROM u)
       WHERE r <= CAST(floor(0.1 * (SELECT COUNT(*) FROM u)) AS BIGINT)""",
)
def q_user_sample_fraction(spark, sf_dir):
    from ranktide.operators import features as G

    return G.sample_user_fraction(fx.reviews(spark, sf_dir), 0.1)

"""Factor models on the long interaction table ``(u, i, value)`` with dense
integer codes: what they share, and ALS (M3/M4). Truncated SVD (M6/M7) is in
:mod:`ranktide.models.blocks`, BPR (M5) in :mod:`ranktide.models.strata`.

All of them produce ``users (u, features)`` and ``items (i, features)``
tables and are scored by :func:`ranktide.models.topk.blocked_topk` with seen
items masked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.models.topk import blocked_topk, seen_lists
from ranktide.session import checkpoint_dir


@dataclass
class FactorModel:
    users: DataFrame   # (u, features array<float|double>)
    items: DataFrame   # (i, features)
    losses: list[float] = field(default_factory=list)   # mean loss of each round, where a model has one
    values: list[float] = field(default_factory=list)   # singular values, falling, where a model has them

    def recommend(self, history: DataFrame | None, k: int = 10, only_users: DataFrame | None = None,
                  seen: DataFrame | None = None) -> DataFrame:
        """M0: top-k unseen items per user by dot product; ``seen`` are the history's lists, if they are made already."""
        q = self.users.join(seen_lists(history) if seen is None else seen, "u", "left")
        if only_users is not None:
            q = q.join(only_users.select("u").distinct(), "u", "left_semi")
        return blocked_topk(q, self.items, k, qid="u", cid="i", vec="features", metric="dot", exclude_col="seen")

    def similar_items(self, k: int = 10) -> DataFrame:
        """M4/M7: cosine nearest items (self excluded)."""
        unit = self.items.select(
            "i", F.transform("features", lambda x: x / F.sqrt(F.aggregate(
                F.transform("features", lambda y: y * y), F.lit(0.0), lambda a, b: a + b))).alias("features")
        )
        out = blocked_topk(unit.withColumnRenamed("i", "q"), unit, k, qid="q", cid="i", vec="features",
                           metric="dot", exclude_self=True)
        return out.select(F.col("q").alias("item"), F.col("i").alias("neighbor"),
                          F.col("score").alias("similarity"), "rank")


# ------------------------------------------------------------------ ALS
def fit_als(train: DataFrame, rank: int = 64, reg: float = 0.1, iterations: int = 20, alpha: float = 1.0,
            seed: int = 42, blocks: int | None = None) -> FactorModel:
    """M3: implicit-feedback ALS (Spark ML). Blocks default to the parallelism
    so tiny data does not become hundreds of tiny tasks. Item factors are
    checkpointed each iteration: only then Spark deletes the shuffle files of
    the iterations before, and they would fill the disks. Note that Spark scales
    lambda by each row's rating count, so lambda values are not portable."""
    from pyspark.ml.recommendation import ALS

    checkpoint_dir(train.sparkSession)
    blocks = blocks or max(2, train.sparkSession.sparkContext.defaultParallelism)
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=True, alpha=alpha, userCol="u",
              itemCol="i", ratingCol="value", seed=seed, numUserBlocks=blocks, numItemBlocks=blocks,
              checkpointInterval=1, coldStartStrategy="drop")
    m = als.fit(train.select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("value").cast("float")))
    return FactorModel(m.userFactors.withColumnRenamed("id", "u"), m.itemFactors.withColumnRenamed("id", "i"))

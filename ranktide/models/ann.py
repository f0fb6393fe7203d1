"""Approximate nearest neighbours over tables of random-projection trees.

Each of ``trees`` hash tables cuts the space by projections on random directions, one direction for each level of a
table, at thresholds that halve what is there. Thresholds are fitted on a sample of at most ``SAMPLE`` vectors of a
bucket; every row is indexed. A bucket that still has more than ``leaf`` rows is cut further in the next stage, by
thresholds of a sample of its own, until none is crowded; tight clusters are thus split however close they lie. Equal
vectors are one row of the index, with their first ids.

A query goes into its own bucket of each table and, for the ``probes`` narrowest decisions on its way, into the bucket on
the other side. Buckets are packed into rows, query vectors into chunks, and their exact distances are computed as
products of bounded size, of which the best ``k`` of a query leave the task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ranktide.session import cut_lineage

SAMPLE = 4096
TREES, PROBES, LEAF = 12, 4, 256
_QUERIES = 256


def direction(seed: int, tree: int, level: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, level]).standard_normal(dim)


def fit(vectors: np.ndarray, tree: int, depth: int, leaf: int, seed: int, first: int = 0) -> dict[int, float]:
    """Thresholds of the nodes (1, then 2n and 2n + 1) of a tree that starts at level ``first``: ``depth`` levels at
    most, and none for what the sample cannot tell apart."""
    out, waiting = {}, [(1, 0, np.arange(len(vectors)))]
    while waiting:
        node, level, rows = waiting.pop()
        if level == depth or len(rows) < 2 * max(1, leaf):
            continue
        along = vectors[rows] @ direction(seed, tree, first + level, vectors.shape[1])
        cut = float(np.median(along))
        low = along < cut
        if low.any() and not low.all():
            out[node] = cut
            waiting += [(2 * node, level + 1, rows[low]), (2 * node + 1, level + 1, rows[~low])]
    return out


def descend(vectors: np.ndarray, cuts: dict[int, float], tree: int, seed: int, first: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the leaves that each row belongs to, its own first; with ``probes`` those, too, that it reaches by
    one decision made the other way, for its narrowest decisions."""
    own, margins, levels = np.ones(len(vectors), np.int64), [], 0
    nodes = np.array(sorted(cuts), np.int64)
    values = np.array([cuts[n] for n in nodes.tolist()])
    along = []

    def step(at, projected):
        place = np.minimum(np.searchsorted(nodes, at), max(len(nodes) - 1, 0))
        inner = (nodes[place] == at) if len(nodes) else np.zeros(len(at), bool)
        gap = projected - values[place] if len(nodes) else np.zeros(len(at))
        return inner, gap

    while True:
        projected = vectors @ direction(seed, tree, first + levels, vectors.shape[1])
        inner, gap = step(own, projected)
        if not inner.any():
            break
        along.append(projected)
        margins.append(np.where(inner, np.abs(gap), np.inf))
        own = np.where(inner, 2 * own + (gap >= 0), own)
        levels += 1
    rows, found = [np.arange(len(vectors))], [own]
    if probes and levels:
        width = np.stack(margins, axis=1)
        for nth in np.argsort(width, axis=1)[:, :probes].T:
            able = np.isfinite(width[np.arange(len(vectors)), nth])
            at = np.ones(len(vectors), np.int64)
            for level in range(levels):
                inner, gap = step(at, along[level])
                at = np.where(inner, 2 * at + ((gap >= 0) ^ (nth == level)), at)
            rows.append(np.flatnonzero(able))
            found.append(at[able])
    return np.concatenate(rows), np.concatenate(found)


def _packed(vector) -> bytes:
    """A vector's bytes after one that names their kind: floats if these hold it exactly, else doubles."""
    wide = np.array(vector, np.float64)
    with np.errstate(over="ignore"):
        short = wide.astype(np.float32)
    return b"f" + short.tobytes() if np.array_equal(short, wide) else b"d" + wide.tobytes()


def _vector(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.float32 if packed[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _matrix(column) -> np.ndarray:
    return np.stack([_vector(x) for x in column.to_pylist()])


def _binary(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, v): packed vectors; rows of no vector are left out."""
    kind = rows.schema[key].dataType

    def work(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [_packed(x) for x in batch.column(1).to_pylist()], pa.binary())], names=[key, "v"])

    wide = rows.where(f"{vec} IS NOT NULL AND {key} IS NOT NULL").select(key, F.transform(vec, lambda x: x.cast("double")).alias("v"))
    return wide.mapInArrow(work, f"{key} {kind.simpleString()}, v binary")


def _cut(rows: DataFrame, cuts: DataFrame, seed: int, probes: int) -> DataFrame:
    """``rows`` (id, v, tree, bucket, level) further down where ``cuts`` (tree, bucket, nodes, values, depth) has
    thresholds for their bucket; the others stay."""
    spec = "id " + rows.schema["id"].dataType.simpleString() + ", v binary, tree int, bucket string, level int"
    arrow = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("v", pa.binary()), ("tree", pa.int32()),
                       ("bucket", pa.string()), ("level", pa.int32())])

    def work(it):
        for batch in it:
            trees, buckets = batch.column("tree").to_numpy(), np.array(batch.column("bucket").to_pylist(), object)
            nodes, out = batch.column("nodes"), []
            ids, blobs = batch.column("id").to_pylist(), batch.column("v").to_pylist()
            keys = {}
            for i, key in enumerate(zip(trees.tolist(), buckets.tolist())):
                keys.setdefault(key, []).append(i)
            for (tree, bucket), own in keys.items():
                n = nodes[own[0]].as_py()
                if n is None:
                    out += [(ids[i], blobs[i], tree, bucket, batch.column("level")[i].as_py()) for i in own]
                    continue
                known = dict(zip(n, batch.column("values")[own[0]].as_py()))
                level = batch.column("level")[own[0]].as_py()
                vectors = np.stack([_vector(blobs[i]) for i in own])
                deeper = level + max(known).bit_length()
                for r, node in zip(*descend(vectors, known, tree, seed, level, probes)):
                    out.append((ids[own[r]], blobs[own[r]], tree, f"{bucket}/{node}", deeper))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    joined = rows.join(cuts, ["tree", "bucket"], "left")
    return joined.select("id", "v", "tree", "bucket", "level", "nodes", "values").mapInArrow(work, spec)


def _thresholds(rows: DataFrame, leaf: int, seed: int) -> DataFrame | None:
    """(tree, bucket, nodes, values) for the crowded buckets of ``rows`` that a sample can cut; None if there is none."""
    sizes = rows.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
    part = F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about SAMPLE / 2 rows of a bucket, at most SAMPLE: the bound holds by the rank
    some = rows.join(sizes, ["tree", "bucket"]).where(part * F.col("n") <= SAMPLE / 2)
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("tree", "bucket").orderBy(part, "id"))).where(F.col("nth") <= SAMPLE)
    schema = pa.schema([("tree", pa.int32()), ("bucket", pa.string()), ("nodes", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))])

    def learn(table):
        tree, bucket, n, level = (table.column(c)[0].as_py() for c in ("tree", "bucket", "n", "level"))
        vectors = _matrix(table.sort_by("nth").column("v"))
        share = max(1, leaf * len(vectors) // n)  # sampled rows of a full leaf
        cuts = fit(vectors, tree, 12, max(8, share // 2), seed, level)
        return pa.table([[tree], [bucket], [list(cuts)], [list(cuts.values())]] if cuts else [[], [], [], []], schema=schema)

    cuts = cut_lineage(some.select("tree", "bucket", "n", "level", "nth", "v").groupBy("tree", "bucket").applyInArrow(
        learn, "tree int, bucket string, nodes array<long>, values array<double>"))
    return None if cuts.isEmpty() else cuts


def _started(rows: DataFrame, trees: int) -> DataFrame:
    return rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                       F.lit("").alias("bucket"), F.lit(0).alias("level"))


def vector_ann(queries: DataFrame, catalog: DataFrame, k: int = 5, qid: str = "qid", cid: str = "id", vec: str = "embedding",
               exclude_self: bool = False, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """(qid, id, distance, rank): about the ``k`` nearest catalogue vectors of each query by squared L2 distance (ties
    by id). Distances are exact; a neighbour is missed if no bucket of the query's holds it. A catalogue of at most
    ``leaf`` different vectors is one bucket and the answer exact. Rows without id or vector are left out, vectors must
    be of one length, repeated vectors count each."""
    order = Window.partitionBy("v").orderBy("id")
    every = _binary(catalog.select(F.col(cid).alias("id"), vec), "id", vec)
    # of equal vectors the first k + 1 ids can be in an answer; the rank is limited before the shuffle
    first = every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    copies = cut_lineage(first.groupBy("v").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")))
    asked = cut_lineage(_binary(queries.select(F.col(qid).alias("id"), vec), "id", vec))

    index, probing = _started(copies.select("id", "v"), trees), _started(asked, trees)
    while (cuts := _thresholds(index, leaf, seed)) is not None:
        before = index
        index = cut_lineage(_cut(index, cuts, seed, 0))
        probing = cut_lineage(_cut(probing, cuts, seed, probes))
        if index.join(before, ["id", "tree", "bucket"], "left_anti").isEmpty():
            break

    load = probing.groupBy("tree", "bucket").agg(F.count(F.lit(1)).alias("load"))
    packed = index.groupBy("tree", "bucket").agg(F.collect_list(F.struct("id", "v")).alias("held"))
    packed = packed.join(load, ["tree", "bucket"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("load") - 1) / _QUERIES)))).drop("load")
    chunk = F.pmod(F.xxhash64("id"), F.floor((F.col("load") - 1) / _QUERIES) + 1)
    chunks = probing.join(load, ["tree", "bucket"]).withColumn("chunk", chunk).groupBy("tree", "bucket", "chunk").agg(
        F.collect_list(F.struct("id", "v")).alias("asked"))

    qt, ct = (f.schema["id"].dataType for f in (asked, copies))
    arrow = pa.schema([("qid", to_arrow_type(qt)), ("rep", to_arrow_type(ct)), ("distance", pa.float64())])
    take = k + 1

    def work(it):
        for batch in it:
            out = []
            for own, held in zip(batch.column("asked").to_pylist(), batch.column("held").to_pylist()):
                a, b = (np.stack([_vector(x["v"]) for x in part]) for part in (own, held))
                names = [x["id"] for x in held]
                for x, q in zip(own, a):
                    d = ((b - q) ** 2).sum(axis=1)
                    near = np.argpartition(d, take - 1)[:take] if len(d) > take else np.arange(len(d))
                    near = np.flatnonzero(d <= d[near].max())  # ties are settled by id later
                    out += [(x["id"], names[j], float(d[j])) for j in near.tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    met = chunks.join(packed, ["tree", "bucket", "chunk"]).select("asked", "held")
    hits = met.mapInArrow(work, f"qid {qt.simpleString()}, rep {ct.simpleString()}, distance double").distinct()
    each = hits.join(copies.select(F.col("id").alias("rep"), "ids"), "rep").select("qid", F.explode("ids").alias("id"), "distance")
    if exclude_self:
        each = each.where(F.col("qid") != F.col("id"))
    best = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), F.col("id").alias(cid if cid != qid else "item"), "distance", "rank")


def recall(found: DataFrame, exact: DataFrame, qid: str = "qid", cid: str = "id") -> DataFrame:
    """(qid, recall): the share of the exact neighbours that ``found`` has."""
    hit = exact.join(found.select(qid, cid, F.lit(1).alias("hit")), [qid, cid], "left")
    return hit.groupBy(qid).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

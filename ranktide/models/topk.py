"""Exact top-k of query vectors against a catalogue of vectors.

Dense vectors: both sides are packed where they lie into blocks of rows, and
a task gets a catalogue block and then a share of the queries, so neither side
goes through the driver. A pair of blocks is one numpy product of a fixed
size; seen items are masked and the block's top k kept (ties by catalogue id)
for all its queries at once. Blocks merge by a per-query ranking over at most
``k * n_blocks`` rows. Sparse vectors: see :func:`sparse_topk`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import FloatType

from ranktide.session import cut_lineage

DEFAULT_BLOCK_BYTES = 8 * 1024 * 1024
DENSE_TERM_BYTES = 64 * 1024 * 1024   # of a block's terms with many entries
DENSE_SHARE = 128     # a dense term is in one of so many entries at least
QUERY_ROWS = 128      # sparse queries of a chunk
SHARE_ROWS = 32768    # sparse queries of a share
DENSE_BLOCK_BYTES = 32 * 1024 * 1024
DENSE_SLICE_BYTES = 4 * 1024 * 1024    # of a block, scored at a time
DENSE_KEY_BYTES = 16 * 1024 * 1024     # of the scores of a slice
HEAD = 2048       # first entries of a block: a query's k-th best of them is its first limit
ROUND_DIGITS = 9   # scores closer than 1e-9 tie and fall back to the id order


def _pack_queries(rows: int, key: pa.DataType, with_seen: bool, kind: type):
    """Arrow batches of (id, vector[, seen]) to rows of up to ``rows`` queries."""
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vec = part.column(1)
                out = [pa.array([part.column(0).to_pylist()], pa.list_(key)),
                       pa.array([np.asarray(vec.flatten(), kind).tobytes()], pa.binary())]
                if with_seen:
                    out.append(pa.array([part.column(2).to_pylist()], pa.list_(pa.list_(key))))
                yield pa.RecordBatch.from_arrays(out, names=["_q", "_qv", "_seen"][: len(out)])

    return work


def _pack_catalog(key: pa.DataType, kind: type):
    """Arrow batches of (block, id, vector), sorted by block and id, to one row per block."""
    def row(block, ids, vectors):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([ids], pa.list_(key)), pa.array([b"".join(vectors)], pa.binary())],
            names=["_cb", "_c", "_cv"])

    def work(batches):
        now, ids, vectors = None, [], []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)] if len(blocks) else []
            for a, b in zip(edges, edges[1:]):
                if now is not None and blocks[a] != now:
                    yield row(now, ids, vectors)
                    ids, vectors = [], []
                now = int(blocks[a])
                ids += batch.column(1).slice(a, b - a).to_pylist()
                vectors.append(np.asarray(batch.column(2).slice(a, b - a).flatten(), kind).tobytes())
        if now is not None:
            yield row(now, ids, vectors)

    return work


def best_of_rows(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the ``k`` smallest finite keys of each row; ties go to the smaller column."""
    k = min(k, key.shape[1])
    limit = np.partition(key, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero((key <= limit[:, None]) & np.isfinite(key))
    order = np.lexsort((col, key[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = rank <= k
    return row[keep], col[keep], rank[keep]


def _ids(value) -> np.ndarray:
    """A list of ids as an array, numbers without a detour over Python."""
    return value.values.to_numpy() if pa.types.is_integer(value.type.value_type) and not value.values.null_count else np.array(value.as_py())


def _ranked(k: int, row: np.ndarray, col: np.ndarray, key: np.ndarray):
    """(row, column, key, rank) of the ``k`` smallest rounded keys of each row; ties go to the smaller column."""
    order = np.lexsort((col, np.round(key, ROUND_DIGITS), row))
    row, col, key = row[order], col[order], key[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    return tuple(x[rank <= k] for x in (row, col, key, rank))


def _hits(mask: np.ndarray) -> np.ndarray:
    """Flat places of a contiguous mask's few true cells, looked for eight cells at a time."""
    flat = mask.ravel()
    whole = flat.size // 8 * 8
    at = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _screened(q: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """For products that can be screened in floats of half the length: each query's bound of what these differ by from
    the exact ones, else None. It is a sum's usual bound, (terms + 4) units of rounding times both lengths, doubled."""
    if not len(q) or not len(c):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        longest = math.sqrt(float(np.einsum("ij,ij->i", c, c, dtype=np.float64).max()))
        bound = 2.0 ** -22 * (c.shape[1] + 4) * np.sqrt(np.einsum("ij,ij->i", q, q)) * longest
    # lengths this far from the ends of the smaller floats: neither side overflows, and what underflows is under 1e-9
    return bound if np.isfinite(bound).all() and longest < 1e15 and float(np.abs(q).max(initial=0.0)) < 1e15 else None


def _score_blocks(k: int, metric: str, key_types, exclude_self: bool, with_seen: bool,
                  kinds: tuple[type, type] = (np.float64, np.float64)):
    """A block's scores are compared with the query's k-th best so far, and only what reaches it is rounded and sorted.
    Inner products are compared in floats of half the length first; what can reach the limit is computed again.

    A row holds a block, a chunk of queries, or both; chunks meet the last block."""
    qtype, ctype = key_types

    def work(batches):
        cids = c = small = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if row["_cv"].is_valid:
                    cids = _ids(row["_c"])
                    c = np.frombuffer(row["_cv"].as_buffer(), kinds[1]).reshape(len(cids), -1)
                    small = None
                if not row["_qv"].is_valid or cids is None:
                    continue
                qids = _ids(row["_q"])
                q = np.frombuffer(row["_qv"].as_buffer(), kinds[0]).reshape(len(qids), -1).astype(np.float64)
                skip = [(np.arange(len(qids)), qids)] if exclude_self else []
                if with_seen:
                    seen = [x or [] for x in row["_seen"].as_py()]
                    flat = [x for s in seen for x in s]
                    if flat:
                        skip.append((np.repeat(np.arange(len(seen)), [len(s) for s in seen]), np.array(flat)))
                skip = [(which, np.minimum(np.searchsorted(cids, ids), len(cids) - 1), ids) for which, ids in skip]
                skip = [(which[cids[at] == ids], at[cids[at] == ids]) for which, at, ids in skip]
                step = max(1, min(DENSE_SLICE_BYTES // (8 * max(1, c.shape[1])), DENSE_KEY_BYTES // (8 * len(qids))))
                limit, best, found, pending = np.full(len(qids), np.inf), None, [], 0
                side = -q if metric == "dot" else -2.0 * q   # a smaller key is better
                off = _screened(q, c) if metric == "dot" else None
                if off is not None:
                    short = side.astype(np.float32)
                    small = c.astype(np.float32) if small is None else small
                for first in range(0, len(cids), step):
                    if off is None:
                        own = c[first: first + step].astype(np.float64)
                        key = side @ own.T
                    else:
                        own = small[first: first + step]
                        key = short @ own.T
                    if metric == "l2":
                        key += np.einsum("ij,ij->i", q, q)[:, None]
                        key += np.einsum("ij,ij->i", own, own)[None, :]
                        np.maximum(key, 0.0, out=key)
                    for which, at in skip:
                        here = (at >= first) & (at < first + len(own))
                        key[which[here], at[here] - first] = np.inf
                    if not first and len(own) >= k:
                        head = key[:, :max(HEAD, k)]
                        limit = np.partition(np.where(np.isfinite(head), head, np.inf), k - 1, axis=1)[:, k - 1].astype(np.float64)
                        limit = limit if off is None else limit + off
                    # keys that round to no more than the limit's
                    reach = limit + 10.0 ** -ROUND_DIGITS + 1e-15 * np.abs(limit)
                    if off is not None:   # and those that may, computed again
                        reach = (reach + off + 2.0 ** -22 * np.abs(limit)).astype(np.float32)
                    r, j = np.divmod(_hits(key <= reach[:, None]), len(own))
                    near = key[r, j]
                    fine = np.isfinite(near)
                    r, j, near = r[fine], j[fine] + first, near[fine]
                    if off is not None:
                        near = np.einsum("ij,ij->i", side[r], c[j].astype(np.float64))
                    found.append((r, j, near))
                    pending += len(r)
                    if pending >= k * len(qids) or first + step >= len(cids):
                        best = _ranked(k, *(np.concatenate(x) for x in zip(*([best[:3]] if best else []), *found)))
                        found, pending = [], 0
                        full = best[3] == k
                        limit[best[0][full]] = best[2][full]
                r, j, score, rank = best
                yield pa.RecordBatch.from_arrays([
                    pa.array(qids[r].tolist(), qtype), pa.array(cids[j].tolist(), ctype),
                    pa.array((score if metric == "l2" else -score) + 0.0, pa.float64()), pa.array(rank, pa.int32())],
                    names=["_qid", "_cid", "score", "rank"])

    return work


def blocked_topk(queries: DataFrame, catalog: DataFrame, k: int, *, qid: str = "u", cid: str = "i",
                 vec: str = "features", metric: str = "dot", exclude_col: str | None = None,
                 exclude_self: bool = False, block_bytes: int = DENSE_BLOCK_BYTES, query_rows: int = 512) -> DataFrame:
    """(qid, cid, score, rank): top-k catalogue entries per query.

    ``metric="dot"`` ranks by descending inner product, ``"l2"`` by ascending
    squared Euclidean distance. ``exclude_col`` names an array column of
    catalogue ids to skip per query (seen items). The catalogue is hashed into
    blocks of about ``block_bytes``, so that each query is shuffled a few times
    only; a product has ``query_rows`` times the entries of a slice of a block.
    Floats are packed as floats and widened where they are multiplied."""
    n_cat, dim = catalog.select(F.count(F.lit(1)), F.max(F.size(vec))).first()
    kinds = tuple(np.float32 if df.schema[vec].dataType.elementType == FloatType() else np.float64 for df in (queries, catalog))
    n_blocks = max(1, math.ceil(int(n_cat or 0) * max(int(dim or 0), 1) * np.dtype(kinds[1]).itemsize / block_bytes))
    # a share of the queries passes a block chunk by chunk, so shares need only keep all cores busy
    shares = max(1, math.ceil(4 * queries.sparkSession.sparkContext.defaultParallelism / n_blocks))
    types = {f.name: f.dataType for f in queries.schema.fields} | {"_c": catalog.schema[cid].dataType}
    arrow = to_arrow_type(types[qid]), to_arrow_type(types["_c"])
    qt, ct = types[qid].simpleString(), types["_c"].simpleString()

    q_vec, c_vec = (F.col(vec) if kind == np.float32 else F.transform(vec, lambda x: x.cast("double")) for kind in kinds)
    given = queries.select(qid, q_vec, *([exclude_col] if exclude_col else []))
    seen = f", _seen array<array<{ct}>>" if exclude_col else ""
    packed = given.mapInArrow(_pack_queries(query_rows, arrow[0], bool(exclude_col), kinds[0]), f"_q array<{qt}>, _qv binary{seen}")
    packed = packed.withColumn("_share", F.pmod(F.xxhash64("_q"), F.lit(shares)).cast("int")).withColumn(
        "_cb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    block = F.pmod(F.xxhash64(cid), F.lit(n_blocks)).cast("int")
    blocks = (catalog.select(block.alias("_cb"), F.col(cid).alias("_c"), c_vec.alias("_v")).repartition(n_blocks, "_cb")
              .sortWithinPartitions("_cb", "_c").mapInArrow(_pack_catalog(arrow[1], kinds[1]), f"_cb int, _c array<{ct}>, _cv binary")
              .withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))
    # a task gets a block once, before the chunks of a share: a join would hand a copy of it to Python with each chunk
    met = packed.unionByName(blocks, allowMissingColumns=True).withColumn("_to", F.col("_cb") * shares + F.col("_share"))
    pairs = met.repartitionById(n_blocks * shares, F.col("_to")).sortWithinPartitions(F.col("_cv").isNull()).select(
        "_q", "_qv", "_c", "_cv", *(["_seen"] if exclude_col else []))
    out = pairs.mapInArrow(_score_blocks(k, metric, arrow, exclude_self, bool(exclude_col), kinds),
                           f"_qid {qt}, _cid {ct}, score double, rank int")
    if n_blocks > 1:
        score = F.round("score", ROUND_DIGITS)
        w = Window.partitionBy("_qid").orderBy(score.asc() if metric == "l2" else score.desc(), F.asc("_cid"))
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("_qid").alias(qid), F.col("_cid").alias(cid if cid != qid else "item"), "score", "rank")


def seen_lists(history: DataFrame, user_col: str = "u", item_col: str = "i") -> DataFrame:
    """(user, seen array): a user's distinct items; bounded by the catalogue size."""
    return history.groupBy(user_col).agg(F.collect_set(item_col).alias("seen"))


# ---------------------------------------------------------------- sparse queries
def _packed_blocks(catalog: DataFrame, cid: str, n_blocks: int) -> DataFrame:
    """(_cb, _c, _ti, _tp, _tw): a row per block of the long catalogue: its ids in order, and its entries by term as
    packed terms, places of ids and values."""
    key = to_arrow_type(catalog.schema[cid].dataType)
    schema = pa.schema([("_cb", pa.int32()), ("_c", pa.list_(key)), ("_ti", pa.binary()), ("_tp", pa.binary()), ("_tw", pa.binary())])

    def pack(table):
        ids, pos = np.unique(table.column("_c").to_numpy(zero_copy_only=False), return_inverse=True)
        idx = table.column("_i").to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.lexsort((pos, idx))
        packed = (idx[order], pos[order].astype(np.int32), table.column("_w").to_numpy(zero_copy_only=False)[order].astype(np.float64))
        return pa.Table.from_arrays([pa.array([table.column("_cb")[0].as_py()], pa.int32()), pa.array([ids.tolist()], pa.list_(key)),
                                     *(pa.array([x.tobytes()], pa.binary()) for x in packed)], schema=schema)

    block = F.pmod(F.xxhash64(cid), F.lit(n_blocks)).cast("int")
    rows = catalog.where(F.col(cid).isNotNull() & F.col("idx").isNotNull()).select(
        block.alias("_cb"), F.col(cid).alias("_c"), F.col("idx").cast("int").alias("_i"), F.col("val").cast("double").alias("_w"))
    return rows.groupBy("_cb").applyInArrow(
        pack, f"_cb int, _c array<{catalog.schema[cid].dataType.simpleString()}>, _ti binary, _tp binary, _tw binary")


def _pack_rows(rows: int):
    """Arrow batches to rows that hold up to ``rows`` of theirs each."""
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_pack"])

    return work


def _flat(lists: pa.ListArray):
    """(row of each element, elements) of a list column; a null is no element."""
    lens = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lens), lists.flatten().to_numpy(zero_copy_only=False)


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Each wanted id's place in the sorted ``ids``, -1 if there is none."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    wanted = wanted.astype(ids.dtype) if ids.dtype.kind != "U" else wanted.astype(str)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


class _Block:
    """A catalogue block: its terms in many entries as a dense matrix, the others as runs of entries."""

    def __init__(self, ids, terms, pos, w):
        self.ids = np.array(ids)
        self.n = len(self.ids)
        terms, self.pos, self.w = np.frombuffer(terms, np.int32), np.frombuffer(pos, np.int32), np.frombuffer(w)
        dim = int(terms[-1]) + 1
        self.ptr = np.searchsorted(terms, np.arange(dim + 1))
        df = np.diff(self.ptr)
        often = np.argsort(-df, kind="stable")[: max(1, DENSE_TERM_BYTES // (8 * self.n))]
        often = often[df[often] * DENSE_SHARE >= self.n]
        self.slot = np.full(dim, -1)
        self.slot[often] = np.arange(len(often))
        of = self.slot[terms]
        held = of >= 0
        self.dense = np.bincount(of[held] * self.n + self.pos[held], weights=self.w[held],
                                 minlength=len(often) * self.n).reshape(len(often), self.n)
        self.terms = terms

    def profiles(self, row: np.ndarray, items: np.ndarray, n: int):
        """(row, term, value) of the sums of the rows' items."""
        at = _places(self.ids, items)
        row, at = row[at >= 0], at[at >= 0]
        order = np.argsort(self.pos, kind="stable")
        ptr = np.searchsorted(self.pos[order], np.arange(self.n + 1))
        offs, lens = _gather(ptr, at)
        cell = np.repeat(row, lens) * len(self.slot) + self.terms[order[offs]]
        cells, inverse = np.unique(cell, return_inverse=True)
        return cells // len(self.slot), cells % len(self.slot), np.bincount(inverse, weights=self.w[order[offs]], minlength=len(cells))

    def scores(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """``n`` queries' inner products with every entry."""
        known = idx < len(self.slot)
        row, idx, val = row[known], idx[known], val[known]
        slot, width = self.slot[idx], len(self.dense)
        often = slot >= 0
        out = np.bincount(row[often] * width + slot[often], weights=val[often], minlength=n * width).reshape(n, width) @ self.dense
        row, idx, val = row[~often], idx[~often], val[~often]
        if len(idx):
            offs, lens = _gather(self.ptr, idx)
            out += np.bincount(np.repeat(row * self.n, lens) + self.pos[offs], weights=self.w[offs] * np.repeat(val, lens),
                               minlength=n * self.n).reshape(n, self.n)
        return out


def _gather(ptr: np.ndarray, rows: np.ndarray):
    """Flat offsets of the slices ``ptr[r]:ptr[r+1]`` for every r in ``rows``."""
    starts, lens = ptr[rows], ptr[rows + 1] - ptr[rows]
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total), lens


def _scored(batches, qid: str, exclude_col: str | None, exclude_self: bool, normalize_query: bool, profile_in_task: bool):
    """(queries, block, scores, lengths) of each met pair; what a query must not be given has score 0."""
    now = None
    for batch in batches:
        for r in range(batch.num_rows):
            at = batch.column("_cb")[r].as_py()
            if now != at:
                block, now = _Block(batch.column("_c")[r].as_py(), *(batch.column(c)[r].as_buffer() for c in ("_ti", "_tp", "_tw"))), at
            rows = pa.ipc.open_stream(batch.column("_pack")[r].as_buffer()).read_next_batch()
            n = rows.num_rows
            seen = _flat(rows.column(exclude_col)) if exclude_col else None
            if profile_in_task:
                row, idx, val = block.profiles(*seen, n)
            else:
                (row, idx), (_, val) = _flat(rows.column("idx")), _flat(rows.column("val"))
            row, idx, val = np.asarray(row, np.int64), np.asarray(idx, np.int64), np.asarray(val, np.float64)
            score = block.scores(row, idx, val, n)
            length = np.sqrt(np.bincount(row, weights=val * val, minlength=n))
            if normalize_query:
                score /= np.where(length > 0, length, 1.0)[:, None]
            for which, ids in ([seen] if seen else []) + ([(np.arange(n), rows.column(qid).to_numpy(zero_copy_only=False))] if exclude_self else []):
                hit = _places(block.ids, ids)
                score[which[hit >= 0], hit[hit >= 0]] = 0.0
            yield rows, block, score, (np.minimum(length, 1.0) if normalize_query else length)


def _met(queries: DataFrame, catalog: DataFrame, cid: str, n_blocks: int, n_queries: int) -> DataFrame:
    """Every chunk of queries beside every block. A share of the chunks meets each block in one task: neither side goes
    through the driver, and one block and one chunk are held at a time."""
    spark = queries.sparkSession
    wide = min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_queries / QUERY_ROWS))
    shares = max(1, wide, math.ceil(n_queries / SHARE_ROWS))
    arrow = queries.mapInArrow(_pack_rows(QUERY_ROWS), "_pack binary")
    packs = arrow.withColumn("_share", F.pmod(F.xxhash64("_pack"), F.lit(shares)).cast("int"))
    blocks = _packed_blocks(catalog, cid, n_blocks).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return blocks.join(packs.hint("merge"), "_share").select("_cb", "_c", "_ti", "_tp", "_tw", "_pack")


def sparse_topk(queries: DataFrame, catalog: DataFrame, k: int | None, *, qid: str, cid: str,
                exclude_col: str | None = None, exclude_self: bool = False, normalize_query: bool = False,
                block_bytes: int = DEFAULT_BLOCK_BYTES, profile_in_task: bool = False) -> DataFrame:
    """(qid, cid, score, rank): inner products of sparse query vectors with a
    sparse catalogue, positive scores only, top ``k`` per query (all positive
    scores when ``k`` is None); ties by catalogue id.

    ``queries`` has ``idx`` (array<int>) and ``val`` (array<double>) columns,
    ``catalog`` is the long table ``(cid, idx, val)``. The catalogue is hashed
    into blocks of about ``block_bytes`` (16 bytes per entry), which tasks pack
    by term; chunks of queries meet them in a join. A block's terms with many
    entries are a dense matrix and one product, the others a gather and one
    ``bincount``, so no (query, entry) pair becomes a row and a term shared by
    every item costs no n^2 join rows. ``normalize_query`` divides by the
    query's L2 norm (cosine against unit-length catalogue rows). With
    ``profile_in_task`` the query vector is the sum of the catalogue rows of the
    query's ``exclude_col`` items, built in the task (the catalogue must fit one
    block, see :func:`single_block`)."""
    nnz = catalog.count()
    n_blocks = max(1, math.ceil(nnz * 16 / block_bytes))
    if profile_in_task and n_blocks > 1:
        raise ValueError("profile_in_task needs the catalogue in one block (see single_block)")
    qtype, ctype = queries.schema[qid].dataType, catalog.schema[cid].dataType
    arrow = pa.schema([(qid, to_arrow_type(qtype)), (cid, to_arrow_type(ctype)), ("score", pa.float64()), ("rank", pa.int32())])
    vec = [] if profile_in_task else ["idx", "val"]
    q = queries.select(qid, *vec, *([exclude_col] if exclude_col else []))

    def work(batches):
        for rows, block, score, _ in _scored(batches, qid, exclude_col, exclude_self, normalize_query, profile_in_task):
            key = np.where(score > 0, -np.round(score, ROUND_DIGITS), np.inf)
            r, c, rank = best_of_rows(key, block.n if k is None else k)
            yield pa.RecordBatch.from_arrays(
                [rows.column(qid).take(pa.array(r)), pa.array(block.ids[c].tolist(), arrow.field(cid).type), pa.array(score[r, c], pa.float64()),
                 pa.array(rank, pa.int32())], schema=arrow)

    out = _met(q, catalog, cid, n_blocks, q.count()).mapInArrow(
        work, f"{qid} {qtype.simpleString()}, {cid} {ctype.simpleString()}, score double, rank int")
    if n_blocks > 1:
        w = Window.partitionBy(qid).orderBy(F.desc(F.round("score", ROUND_DIGITS)), F.asc(cid))
        out = out.withColumn("rank", F.row_number().over(w))
        if k is not None:
            out = out.where(F.col("rank") <= k)
    return out


# ---------------------------------------------------------------- fused sparse side
def _first_of(score: np.ndarray, k: int, slack: np.ndarray, by_id: bool) -> np.ndarray:
    """Mask of the positive scores that can be among a row's ``k`` best once they are scaled and rounded: those within
    ``slack`` of the k-th best, of equal ones the first ``k``; with ``by_id`` also the first ``k`` of all."""
    ok = score > 0
    key = np.where(ok, -score, np.inf)
    last = min(k, key.shape[1]) - 1
    row, col = np.nonzero(ok & (key <= np.partition(key, last, axis=1)[:, last][:, None] + slack[:, None]))
    order = np.lexsort((col, key[row, col], row))
    row, col = row[order], col[order]
    same = np.r_[False, (row[1:] == row[:-1]) & (key[row, col][1:] == key[row, col][:-1])] if len(row) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(row)))) if len(row) else np.zeros(0, int)
    keep = np.arange(len(row)) - start < k
    out = (ok & (np.cumsum(ok, axis=1) <= k)) if by_id else np.zeros(score.shape, bool)
    out[row[keep], col[keep]] = True
    return out


def _fuse_rows(k: int, alphas, schema: pa.Schema):
    """Rows (key, has, items, sa, sb, lo, hi), sorted by key, to each key's top ``k`` of every alpha."""
    def fused(q, parts):
        los, his = [p[3] for p in parts if p[3] is not None], [p[4] for p in parts if p[4] is not None]
        lo, hi = (min(los), max(his)) if los else (0.0, 0.0)
        items = np.array([x for p in parts for x in p[0]], dtype=str)
        if not len(items):
            return
        ids, at = np.unique(items, return_inverse=True)
        sa = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(ids))
        raw = np.concatenate([p[2] for p in parts])
        given = ~np.isnan(raw)
        sb = np.zeros(len(ids))
        sb[at[given]] = (raw[given] - lo) / (hi - lo) if hi > lo else 0.0
        for alpha in alphas:
            f = alpha * sa + (1 - alpha) * sb
            best = np.lexsort((np.arange(len(ids)), -np.round(f, ROUND_DIGITS)))[:k]
            yield from ((alpha, q, i, s, n + 1) for n, (i, s) in enumerate(zip(ids[best].tolist(), f[best].tolist())))

    def work(batches):
        now, parts, out = None, [], []
        for batch in batches:
            for q, has, *part in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (q, has):
                    if parts:
                        out += fused(now[0], parts)
                    now, parts = (q, has), []
                parts.append(part)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if parts:
            out += fused(now[0], parts)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return work


def single_block(catalog: DataFrame, block_bytes: int = DEFAULT_BLOCK_BYTES, bytes_per_entry: int = 32) -> bool:
    """Whether the long catalogue fits one block (term- and item-major)."""
    return catalog.count() * bytes_per_entry <= block_bytes


def fused_sparse_topk(queries: DataFrame, catalog: DataFrame, k: int, alphas, *, qid: str, cid: str,
                      exclude_col: str | None = None, normalize_query: bool = False,
                      block_bytes: int = DEFAULT_BLOCK_BYTES, profile_in_task: bool = False) -> DataFrame:
    """(alpha, qid, cid, score, rank): top ``k`` per query and alpha of
    ``alpha * sa + (1 - alpha) * sb``, where ``sb`` is the min-max normalised
    positive sparse score of :func:`sparse_topk` over the whole catalogue and
    ``sa`` a second, already normalised side given per query as the arrays
    ``a_items`` / ``a_sa`` (0 where a side has no entry). Catalogue rows have unit length.

    The sparse side is never materialised: a chunk's scores of a block live
    only inside the task, which returns their least and largest per query, the
    scores of the side-``a`` items and those that can be among the ``k`` best
    (among items of no side-``a`` score the fused order is that of the raw
    scores). Blocks merge per query over at most about ``k * n_blocks`` items
    beside those of side ``a``."""
    nnz = catalog.count()
    n_blocks = max(1, math.ceil(nnz * 16 / block_bytes))
    if profile_in_task and n_blocks > 1:
        raise ValueError("profile_in_task needs the catalogue in one block (see single_block)")
    alphas = [float(a) for a in alphas]
    qtype = queries.schema[qid].dataType
    vec = [] if profile_in_task else ["idx", "val"]
    has = F.col(exclude_col if profile_in_task else "idx").isNotNull().alias("_has")
    q = cut_lineage(queries.select(qid, has, *vec, "a_items", "a_sa", *([exclude_col] if exclude_col else [])))
    steep = 1 / min((1 - a for a in alphas if a < 1), default=1.0)
    spec = f"{qid} {qtype.simpleString()}, _has boolean, items array<string>, sa array<double>, sb array<double>, lo double, hi double"
    arrow = pa.schema([(qid, to_arrow_type(qtype)), ("_has", pa.bool_()), ("items", pa.list_(pa.string())), ("sa", pa.list_(pa.float64())),
                       ("sb", pa.list_(pa.float64())), ("lo", pa.float64()), ("hi", pa.float64())])

    def work(batches):
        for rows, block, score, length in _scored(batches, qid, exclude_col, False, normalize_query, profile_in_task):
            ok = score > 0
            wanted = _first_of(score, k, 4 * 10.0 ** -ROUND_DIGITS * steep * np.maximum(length, 1e-6), max(alphas) >= 1)
            row, items = _flat(rows.column("a_items"))
            at = _places(block.ids, items)
            wanted[row[at >= 0], at[at >= 0]] = True
            wanted &= ok
            some = np.flatnonzero(ok.any(axis=1))
            r, c = np.nonzero(wanted[some])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=len(some)))], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in (
                (block.ids[c].astype(str).tolist(), pa.string()), (np.zeros(len(r)), pa.float64()), (score[some][r, c], pa.float64()))]
            lo, hi = np.where(ok, score, np.inf).min(axis=1)[some], score.max(axis=1)[some]
            yield pa.RecordBatch.from_arrays([rows.column(qid).take(pa.array(some)), rows.column("_has").take(pa.array(some)), *lists,
                                              pa.array(lo), pa.array(hi)], schema=arrow)

    nan = F.lit(float("nan"))
    side_a = q.where(F.size("a_items") > 0).select(
        qid, "_has", F.transform("a_items", lambda x: x.cast("string")).alias("items"), F.col("a_sa").alias("sa"),
        F.transform("a_sa", lambda x: nan).alias("sb"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    found = _met(q.where("_has"), catalog, cid, n_blocks, q.count()).mapInArrow(work, spec)
    out = pa.schema([("alpha", pa.float64()), (qid, to_arrow_type(qtype)), (cid, to_arrow_type(catalog.schema[cid].dataType)),
                     ("score", pa.float64()), ("rank", pa.int32())])
    return (found.unionByName(side_a).repartition(qid, "_has").sortWithinPartitions(qid, "_has").mapInArrow(
        _fuse_rows(k, alphas, out),
        f"alpha double, {qid} {qtype.simpleString()}, {cid} {catalog.schema[cid].dataType.simpleString()}, score double, rank int"))

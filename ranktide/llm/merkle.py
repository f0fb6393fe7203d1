"""Merkle manifest of a table, upper proofs by a butterfly exchange between partitions.

Rows are leaves, one tree for each key (the language), ordered by id; the trees' roots, in the order of their keys, are
the leaves of one more tree. A tree's leaves are dealt into aligned blocks of ``fanout ** block_levels``; a block is
hashed in one task into the root of its own subtree.

The levels above are reached in rounds. In a round, ``fanout ** round_levels`` neighbouring subtrees of equal height
form a group. The blocks that have the same place in each of these subtrees meet and swap their subtree's root, so every
block gets the roots of its whole group, hashes the ancestors up to the group's root itself (each group of places
repeats that work) and writes down the siblings on its own way up. After log(blocks) rounds every block holds the root
and its upper proof; nothing is handed down again. A last subtree with fewer blocks than places sends each of its roots
to several places. A group is never larger than ``fanout ** round_levels`` rows, a block never larger than its leaves.

Last, each block's rows meet their upper proof, once, and every leaf is folded with its siblings up to the root."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranktide.llm.common import materialise

FANOUT = 2
BLOCK_LEVELS = 10
ROUND_LEVELS = 4
TAMPER = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str], fanout: int, most: int | None, lone: bool) -> list[list[str]]:
    """The levels above ``nodes``, themselves first: ``most`` of them (None: until one node is left). With ``lone`` a
    single node is the tree's root and stays; without, it has neighbours elsewhere and goes on being hashed."""
    out = [nodes]
    while (most is None or len(out) <= most) and not (lone and len(out[-1]) == 1):
        out.append([digest("".join(out[-1][i: i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[str]:
    """For each level but the last, the digests of the other members of the run that leads on from place ``at``."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append("".join(nodes[first:at] + nodes[at + 1: first + fanout]))
        at //= fanout
    return out


def fold(node: str, at: int, path: list[str], fanout: int) -> str:
    """The root that a leaf at place ``at`` gives with these siblings."""
    for others in path:
        cut = at % fanout * _DIGEST
        node, at = digest(others[:cut] + node + others[cut:]), at // fanout
    return node


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """The digest of a row's columns, each by its length and value; ``n_chars`` may stand in for the row's own."""
    columns = [n_chars if c == "n_chars" and n_chars is not None else F.col(c) for c in COLUMNS]
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, ...) with ``pos``: the place among the key's rows by ``order``, from 0. A range-partitioned sort
    (rows that tie in all of ``order`` are told apart by where they come from, so no key is too hot), written once; each
    partition's first place is a prefix sum over the partitions that hold the key."""
    by = ["key", *order, "_from"]
    spread = rows.withColumn("_from", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_from")
    row = F.monotonically_increasing_id()
    kept = materialise(ranged.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND((1 << 33) - 1)}), "leaves")
    parts = kept.groupBy("key", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("key", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return (kept.join(starts, ["key", "_part"]).withColumn("pos", (F.col("_row") + F.col("_start")).cast("long"))
            .drop("_part", "_row", "_start"))


def _blocks(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """(key, block, n, node): the root of each block's own subtree, and the number of the key's leaves. A key of several
    blocks has all its block roots at the height of ``block_levels``."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("node", pa.string())])

    def work(table):
        got = table.sort_by("pos")
        top = climb(got.column("leaf").to_pylist(), fanout, block_levels, True)
        return pa.table([[table.column("key")[0].as_py()], [table.column("block")[0].as_py()], [table.num_rows],
                         [top[-1][0]]], schema=schema)

    roots = leaves.select("key", "block", "pos", "leaf").groupBy("key", "block").applyInArrow(
        work, "key string, block long, m long, node string")
    roots = materialise(roots, "blocks")
    totals = roots.groupBy("key").agg(F.sum("m").alias("n"))

    def lift(it):  # a short last block reaches its only node early and goes on with the others
        for batch in it:
            nodes = []
            for m, n, node in zip(*(batch.column(c).to_pylist() for c in ("m", "n", "node"))):
                height = 0
                while fanout**height < m:
                    height += 1
                for _ in range(block_levels - height if n > fanout**block_levels else 0):
                    node = digest(node)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("n"),
                                              pa.array(nodes, pa.string())], names=["key", "block", "n", "node"])

    return roots.join(totals, "key").mapInArrow(lift, "key string, block long, n long, node string")


def _round(state: DataFrame, level: int, fanout: int, round_levels: int) -> DataFrame:
    """One exchange: ``state`` (key, block, blocks, node, path) with ``node`` and ``path`` carried ``round_levels`` up
    from subtrees of ``fanout ** level`` blocks."""
    size, width = fanout**level, fanout**round_levels
    subtree = F.floor(F.col("block") / size)
    last = F.floor((F.col("blocks") - 1) / size)
    held = F.col("blocks") - last * size  # blocks of the last subtree
    own = F.col("block") % size
    places = F.when((subtree == last) & (last > 0) & (held < size), F.sequence(own, F.lit(size - 1).cast("long"), held)).otherwise(F.array(own))
    sent = state.select("key", "block", "blocks", "node", "path", subtree.alias("subtree"), own.alias("own"), F.explode(places).alias("place"))
    met = sent.groupBy("key", F.floor(F.col("subtree") / width).alias("group"), "place").agg(
        F.first("blocks").alias("blocks"),
        F.collect_list(F.struct("subtree", "node")).alias("nodes"),
        F.collect_list(F.when(F.col("place") == F.col("own"), F.struct("block", "subtree", "path"))).alias("members"))
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("node", pa.string()),
                        ("path", pa.list_(pa.string()))])

    def work(it):
        for batch in it:
            rows = []
            for key, blocks, nodes, members in zip(*(batch.column(c).to_pylist() for c in ("key", "blocks", "nodes", "members"))):
                nodes = [x["node"] for x in sorted(nodes, key=lambda x: x["subtree"])]
                levels = climb(nodes, fanout, round_levels, blocks <= size * width)
                rows += [(key, m["block"], blocks, levels[-1][0], m["path"] + siblings(levels, m["subtree"] % width, fanout)) for m in members]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return met.mapInArrow(work, "key string, block long, blocks long, node string, path array<string>")


def uppers(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """(key, block, n, node, path) of the blocks of ``leaves`` (key, block, pos, leaf): the root of the key's tree and
    the siblings from the block's root up to it."""
    blocks = F.ceil(F.col("n") / fanout**block_levels)
    first = materialise(_blocks(leaves, fanout, block_levels).withColumn("blocks", blocks), "subtrees")
    most = first.agg(F.max("blocks")).first()[0] or 0
    state = first.select("key", "block", "blocks", "node", F.array().cast("array<string>").alias("path"))
    level = 0
    while fanout**level < most:
        state, level = materialise(_round(state, level, fanout, round_levels), "round"), level + round_levels
    return first.select("key", "block", "n").join(state.select("key", "block", "node", "path"), ["key", "block"])


def _proved(leaves: DataFrame, upper: DataFrame, spec: str, schema: pa.Schema, row, fanout: int, block_levels: int) -> DataFrame:
    """``row(record, path, upper record)`` for every leaf: its block is hashed once more, for the siblings below."""
    def work(left, right):
        top, got = right.to_pylist()[0], left.sort_by("pos").to_pylist()
        # the block ends below the root if the key has several blocks
        levels = climb([r["leaf"] for r in got], fanout, block_levels, top["n"] <= fanout**block_levels)
        out = [row(r, siblings(levels, i, fanout) + top["path"], top) for i, r in enumerate(got)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return leaves.groupBy("key", "block").cogroup(upper.groupBy("key", "block")).applyInArrow(work, spec)


def manifest(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS,
             tamper: int = TAMPER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs`` (doc_id, source, lang,
    n_chars, text).

    ``root`` covers the whole table, ``subroot`` the rows of the row's lang (null is a lang, the first). The proof's
    digest is of the siblings, from the leaf up. ``folded_root`` is computed from the leaf of the row as found now, and
    rows are found with one more in n_chars where ``tamper`` divides the CRC of the decimal doc_id; a null n_chars or
    doc_id stays as it was. Rows of one lang are ordered by doc_id (null first), then by leaf; equal rows are leaves
    each. Null and empty values differ. Extra columns are ignored, no rows give no rows. A lone row is its own root, with
    an empty proof."""
    size = fanout**block_levels
    # null langs first, then bytewise: the order of '' and '=' + lang
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    touched = (F.crc32(F.col("doc_id").cast("string")) % tamper == 0) & F.col("n_chars").isNotNull()
    rows = docs.select(*COLUMNS).select(
        key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"),
        F.when(touched, leaf(F.col("n_chars") + 1)).alias("found"))
    block = F.floor(F.col("pos") / size)
    leaves = materialise(placed(rows, ["doc_id", "leaf"]).withColumn("block", block), "placed")
    upper = materialise(uppers(leaves, fanout, block_levels, round_levels), "uppers")

    tops = upper.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("node").alias("leaf"))
    tops = materialise(placed(tops, ["name"]).withColumn("block", block), "subroots")
    over = uppers(tops, fanout, block_levels, round_levels)
    named = pa.schema([("key", pa.string()), ("at", pa.int64()), ("root", pa.string()), ("rest", pa.list_(pa.string()))])
    over = materialise(_proved(tops, over, "key string, at long, root string, rest array<string>", named,
                               lambda r, path, top: (r["name"], r["pos"], top["node"], path), fanout, block_levels), "langs")

    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                        ("verified", pa.bool_())])

    def row(r, path, top):
        sub = fold(r["found"] or r["leaf"], r["pos"], path, fanout)
        folded = fold(sub, top["at"], top["rest"], fanout)
        return (r["doc_id"], r["leaf"], top["node"], top["root"], digest("".join(path + top["rest"])), folded, folded == top["root"])

    spec = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proved(leaves, upper.join(over, "key"), spec, schema, row, fanout, block_levels)

"""Hierarchical weighted hash tree: regions hold racks, racks hold shards.

A key descends level by level. At each node every child draws ``-ln(u) / weight``, u being a hash of the key and the
child's path, and the smallest draw wins, so a child gets keys in proportion to its weight. When one child's weight
grows, keys move only into that child: movement stays inside subtrees whose weights change. A shard that is added as a
region of its own therefore takes rows only into itself, and no row moves between the others (law ``key``).

Everything here is DataFrame expressions (``md5``, ``transform``, ``array_min``); rows shuffle without their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, base: int = 40, shards_per_rack: int = 5, racks_per_region: int = 4) -> list[Shard]:
    """Equal shards: the first ``base`` in full racks and regions, each later one as a region of its own."""
    per = shards_per_rack * racks_per_region
    first_new = -(-base // per)
    return [
        Shard(s // per, s // shards_per_rack % racks_per_region, s) if s < base else Shard(first_new + s - base, 0, s)
        for s in range(shards)
    ]


def _pick(key: Column, children: Column) -> Column:
    """The id of the child with the smallest weighted draw (ties, one in 2**52: the smaller id)."""
    def draw(c: Column) -> Column:
        hashed = F.conv(F.substring(F.md5(F.concat(key, c["path"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((hashed + 1) / float(2**52 + 1)) / c["weight"]).alias("draw"), c["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _children(rows: dict[int, tuple[str, float]]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(path).alias("path"), F.lit(float(w)).alias("weight"))
        for i, (path, w) in sorted(rows.items())
    ])


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of each key: three draws down the tree. Shards of no weight get nothing."""
    tree = [s for s in tree if s.weight > 0]
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    rack_ids = {(r, k): i for i, (r, k) in enumerate((r, k) for r in sorted(regions) for k in sorted(regions[r]))}
    top = {r: (f"/r{r}", sum(sum(k.values()) for k in racks.values())) for r, racks in regions.items()}
    racks = F.create_map(*[x for r in sorted(regions) for x in (F.lit(r), _children(
        {rack_ids[r, k]: (f"/r{r}/k{k}", sum(leaves.values())) for k, leaves in regions[r].items()}))])
    leaves = F.create_map(*[x for (r, k), i in sorted(rack_ids.items()) for x in (F.lit(i), _children(
        {s: (f"/r{r}/k{k}/s{s}", w) for s, w in regions[r][k].items()}))])
    return _pick(key, leaves[_pick(key, racks[_pick(key, _children(top))])])


def assign_shards(docs: DataFrame, tree: list[Shard], grown: list[Shard], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16, ``slot`` numbers a shard's rows from 0 without gaps in the order of a
    hash of the id. A null text counts as empty, a null id as one key of its own; repeated rows go to one shard and
    get a slot each; an empty table gives no rows; other columns are ignored. Slots come from counts per (shard,
    hash bucket) plus a rank inside the bucket, so no task holds a whole shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
    ).select(
        "doc_id", "size", "text_crc32", place(F.col("_key"), tree).alias("shard"),
        place(F.col("_key"), grown).alias("grown_shard"),
        (F.conv(F.substring(F.md5("_key"), 1, 8), 16, 10).cast("long") % BUCKETS).alias("_bucket"),
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x BUCKETS rows
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(offsets), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_first") + F.col("_rank")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )

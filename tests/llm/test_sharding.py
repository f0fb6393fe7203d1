import zlib
from collections import defaultdict

from ranktide.llm import sharding
from tests.llm.helpers import docs


def test_law_holds_and_slots_have_no_gaps(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(3000)] + [(5, "text 5"), (None, None), (9, "é"), (9, "é")]
    out = sharding.assign_shards(docs(spark, rows, extra=True), sharding.even_tree(40), sharding.even_tree(41)).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    where = {}
    for r in out:
        slots[r.shard].append(r.slot)
        assert where.setdefault(r.doc_id, r.shard) == r.shard  # the id decides
        assert r.grown_shard in (r.shard, 40)  # only the new shard takes rows
    assert set(slots) <= set(range(40)) and any(r.grown_shard == 40 for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 2 * len(rows) / 40
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    assert all((r["size"], r.text_crc32) in texts[r.doc_id] for r in out)


def test_weights_and_confined_movement(spark):
    tree = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 1, 1, 1), sharding.Shard(1, 0, 2, 2), sharding.Shard(1, 1, 3, 0)]
    more = [*tree[:2], sharding.Shard(1, 0, 2, 2), sharding.Shard(1, 1, 3, 4)]  # region 1 grows
    out = sharding.assign_shards(docs(spark, [(i, "") for i in range(4000)]), tree, more).collect()
    share = [sum(r.shard == s for r in out) / 4000 for s in range(4)]
    assert abs(share[0] - 0.25) < 0.04 and abs(share[1] - 0.25) < 0.04 and abs(share[2] - 0.5) < 0.04 and share[3] == 0
    assert all(r.grown_shard == r.shard or r.grown_shard in (2, 3) for r in out)


def test_empty_table(spark):
    assert sharding.assign_shards(docs(spark, []), sharding.even_tree(3), sharding.even_tree(4)).collect() == []

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranktide.llm import warc
from ranktide.llm.common import shared_path

PAGES = "page_id long, url string, html string, refers_to string"


def _run(spark, rows, **kw):
    root = shared_path(spark, "warc-test")
    manifest = warc.write(spark.createDataFrame([(*r, "x") for r in rows], PAGES), root, **kw)
    return manifest, warc.read(manifest, root), root


def _want(rows, least=0):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(p, first.get(h or "", p))
    out, used = [], set()
    for p, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        if p is None and f is not None:
            out.append((p, len(data), warc.digest(data), "revisit", f))
        elif f is None or f == p and h not in used:
            out.append((p, len(data), warc.digest(data), "response", None))
            used.add(h)
        else:
            out.append((p, len(data), warc.digest(data), "revisit", f))
    return out


def test_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}é") for i in range(200)]
    rows += [(300, None, None), (301, "u v\r\nX: y", ""), (302, "http://long", "x\r\n\r\nWARC/1.1\r\n" * 20000), (7, "again", "<p>7é")]
    manifest, back, root = _run(spark, rows, roll_bytes=2000, partitions=3)
    got = [tuple(r)[:5] for r in back.collect()]
    assert Counter(got) == Counter(_want(rows))
    bodies = {r.page_id: r.payload for r in back.collect() if r.payload is not None}
    assert bodies[302] == rows[-2][2].encode() and bodies[300] == b""
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(rows)
    local = root.removeprefix("file:")
    assert not [x for x in os.listdir(local) if x.startswith("_temporary")]
    ranges = sorted((f.first_id, f.last_id) for f in files)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_same_records_give_the_same_bytes(spark):
    rows = [(i, f"u{i}", f"h{i % 5}") for i in range(60)]
    one, _, _ = _run(spark, rows, partitions=2)
    two, _, _ = _run(spark, list(reversed(rows)), partitions=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_files_do_not_depend_on_runs_or_partitions(spark, monkeypatch):
    """100,000 records, two runs and three partition counts: equal manifests; reading takes a task for some bytes."""
    root = shared_path(spark, "warc-input")
    pages = spark.range(100_000).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(md5(cast(id % 70000 AS string)), 3 + id % 5) AS html")
    pages.repartition(7).write.parquet(root)
    given, seen = spark.read.parquet(root), []
    for kw in ({}, {}, {"partitions": 3}, {"partitions": 16}):
        out = shared_path(spark, "warc-test")
        manifest = warc.write(given, out, range_bytes=4 << 20, roll_bytes=1 << 20, **kw)
        seen.append(sorted(map(tuple, manifest.collect())))
    assert len(seen[0]) > 12 and all(x == seen[0] for x in seen)
    assert sum(x[1] for x in seen[0]) == 100_000
    monkeypatch.setattr(warc, "READ_BYTES", 2 << 20)
    back = warc.read(manifest, out, payload=False)
    assert back.rdd.getNumPartitions() == -(-sum(x[2] for x in seen[0]) // (2 << 20)) > 3
    assert back.count() == 100_000


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]
    _, back, _ = _run(spark, rows, min_revisit_bytes=5)
    assert Counter(tuple(r)[:5] for r in back.collect()) == Counter(_want(rows, 5))


def test_null_id_and_empty_table(spark):
    _, back, _ = _run(spark, [(None, "a", "x"), (4, "b", "x")])
    assert {r.page_id: r.record_type for r in back.collect()} == {None: "revisit", 4: "response"}
    _, back, _ = _run(spark, [])
    assert back.collect() == []


def test_reading_holds_the_manifest(spark):
    """A file whose records, bytes, digest or ids are not those that the manifest lists is not read as if it were."""
    manifest, back, root = _run(spark, [(n, f"http://a/{n}", f"text {n}") for n in range(20)])
    assert back.count() == 20
    for column, wrong in (("records", "records + 1"), ("bytes", "bytes - 1"), ("sha256", "upper(sha256)"), ("first_id", "first_id + 1"),
                          ("last_id", "CAST(NULL AS BIGINT)")):
        with pytest.raises(Exception, match="manifest lists"):
            warc.read(manifest.withColumn(column, F.expr(wrong)), root, payload=False).collect()

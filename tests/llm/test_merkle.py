import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ranktide.llm import merkle, queries
from tests.conftest import SF
from tests.llm.helpers import DOCS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i: i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def way(levels, at, fanout):
    """[(digests left, digests right)] of the siblings on the way up."""
    out = []
    for nodes in levels[:-1]:
        run = range(at - at % fanout, min(len(nodes), at - at % fanout + fanout))
        out.append((["".join(nodes[i] for i in run if i < at)], ["".join(nodes[i] for i in run if i > at)]))
        at //= fanout
    return [(a[0], b[0]) for a, b in out]


def brute(rows, fanout=2):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc, text, lang, source, n in rows:
        own = sha(enc(doc) + enc(source) + enc(lang) + enc(n) + enc(text))
        bad = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        now = sha(enc(doc) + enc(source) + enc(lang) + enc(n + 1) + enc(text)) if bad else own
        groups.setdefault((lang is not None, (lang or "").encode()), []).append(((doc is not None, doc or 0), own, now, doc))
    names = sorted(groups)
    for g in names:
        groups[g].sort(key=lambda x: x[:2])
    trees = {g: tree([r[1] for r in groups[g]], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (_, own, now, doc) in enumerate(groups[g]):
            path = way(trees[g], i, fanout) + way(top, k, fanout)
            node = now
            for a, b in path:
                node = sha(a + node + b)
            out.append((doc, own, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("fanout,block,rounds,n", [(2, 1, 1, 37), (2, 2, 2, 133), (3, 1, 2, 61)])
def test_blocks_and_rounds_give_the_plain_tree(spark, fanout, block, rounds, n):
    """Keys of many, few and single leaves; several rounds; last subtrees of all sizes."""
    langs = ["en"] * 8 + ["de", None]
    rows = [(i * 3, f"text {i}", langs[i % 10] if i else "zz", None if i % 5 == 0 else "s", i if i % 4 else None) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), fanout, block, rounds)
    assert plain(got) == sorted(map(repr, brute(rows, fanout)))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "", "en", None, 0), (5, "", "en", None, 0), (5, "x", "en", None, 1),
            (7, "é퟿日本" * 50_000, "日", "s", 7), (-3, "a", "é", "s", 2**62), (8, None, "z", "s", None)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("key", "pos", "block", "node", "path", "leaf", "_from", "_part", "root"):
        frame = frame.withColumn(name, F.lit("x"))
    got = merkle.manifest(frame, block_levels=1, round_levels=1)
    assert plain(got) == sorted(map(repr, brute(rows)))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", None, None, None)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_query(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op11_merkle(spark, SF)
    assert plain(got) == sorted(map(repr, brute(rows)))
    assert 0 < got.where("NOT verified").count() < len(rows)

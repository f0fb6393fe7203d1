"""Registered queries against their SQL, and the two that SQL cannot express against brute force, on the small tables."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
from ranktide.llm import bpe, queries, urls
from ranktide.sources.fixtures import TABLES
from tests.conftest import SF
from tests.llm.test_urls import expected, plain_tokens, plain_weights
from tools.oracle_check import digest


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle_agrees(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert sorted(df.columns) == sorted(columns) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(columns, want)[0]


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, len(names) + 1)) and "pipeline" in entry.queries()


def test_bpe_query(spark):
    codec = bpe.Codec(bpe.rank_file(public_tokenizers.path(queries.TOKENIZER)), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in queries.op9_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = codec.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_urls_query(spark):
    got = {r.page_id: r for r in queries.op5_urls(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    verdicts = {r.name: r.verdict for r in queries.RULES}
    assert len(got) == len(pages)
    # the whole query once more, by dictionaries: words, labels, splits, weights, verdicts
    words = Counter(w for d in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
                    for w in re.findall("[a-z]+", (d.text or "").lower()) if 1 < len(w) <= urls.LONGEST)
    own = urls.Segmenter(dict(words))
    bad = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.quality is not None or r.toxic is not None:
            bad[r.doc_id] = bad.get(r.doc_id, False) or r.quality == 0 or r.toxic == 1
    labelled = []
    for p in pages:
        host, path, _ = expected(p.url)
        m = re.search("/([0-9]+)[^/]*/?$", path)
        if m and int(m[1]) in bad:
            labelled.append((host, path, bad[int(m[1])]))
    weights, unseen = plain_weights(labelled, own, urls.LEXICON)
    for p in pages:
        host, path, rule = expected(p.url)
        r = got[p.page_id]
        odds = sum(weights.get(t, unseen) for t in plain_tokens(own, host, path)) - urls.MARGIN
        assert (r.host, r.path, r.rule, r.words) == (host, path, rule, " ".join(plain_tokens(own, host, path)))
        assert r.odds == pytest.approx(odds, abs=2e-6)
        assert r.verdict == (verdicts[rule] if rule else "block" if odds > 0 else "allow")


def test_urls_query_decides(spark):
    """Among pages without a rule, hosts of bad words go and nearly all others stay."""
    rows = [r for r in queries.op5_urls(spark, SF.replace("0.001", "0.01")).collect() if r.rule is None]
    bad = [r for r in rows if re.search("casino|spam|free-bets|cheap-pills|adult", r.host)]
    others = [r for r in rows if r not in bad]
    assert bad and all(r.verdict == "block" for r in bad)
    assert sum(r.verdict == "block" for r in others) <= 0.05 * len(others)


def test_bad_hosts_are_told_from_others(spark):
    """Held-out names: hosts of lexicon words are blocked, hosts of the corpus's own words are not."""
    counts = urls.dictionary(spark.read.parquet(f"{SF}/documents.parquet").select("text"))
    pages = spark.createDataFrame(
        [(i, f"http://blog.{h}.example.org/en/{i}") for i, h in enumerate(["cheap-pills", "casinobets", "the", "thereof", "pillscasino"])],
        "page_id long, url string")
    labelled = urls.located(spark.read.parquet(f"{SF}/pages.parquet")).selectExpr("host", "path", "page_id % 7 = 0 AS block")
    got = urls.judge(pages, queries.RULES, counts, urls.train(labelled, counts)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "allow", "block"]

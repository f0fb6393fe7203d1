import itertools
import math
import re
from collections import Counter

import pytest

from ranktide.llm import urls
from ranktide.llm.queries import RULES

DICTIONARY = {"cheap": 5, "pill": 9, "pills": 7, "news": 50, "paper": 40, "newspaper": 8, "the": 100, "rapist": 1, "therapist": 3, "a": 30}


def test_viterbi_against_all_splits():
    own = urls.Segmenter(DICTIONARY)

    def all_splits(name):
        for n in range(len(name)):
            for cuts in itertools.combinations(range(1, len(name)), n):
                yield [name[a:b] for a, b in zip((0, *cuts), (*cuts, len(name)))]

    def cost(parts):
        return sum(own.cost.get(p, own.unknown(len(p))) for p in parts)

    for name in ("cheappills", "newspaper", "therapist", "xqzcheap", "a", "newsthe", "aaa", "pillz"):
        assert cost(own.split(name)) == pytest.approx(min(map(cost, all_splits(name))))
    assert own.split("cheappills") == ["cheap", "pills"] and own.split("") == []
    assert own.split("newsthe" * 3000) == ["news", "the"] * 3000


def expected(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3:], re.S)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
    fits = [r.name for r in RULES if (host == r.host or host.endswith("." + r.host)) and m[2].startswith(r.path)]
    return host, m[2], max(fits, key=len, default=None)


URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q=://b.net/es/", "http://example.com/en/2", "http://m.example.com/en/#t",
        "http://badexample.com/en/", "http://x.net/es/1", "http://net/es/", "http://x.net/en/cheappills", "http://a.com", "ftp://com/",
        "no url", "", None, "://", "http://É.net/fr", "http://x.net/fr/a\nb", "http://cheap-pills.org/casino", "a://b://c.com/", "http://b.org?x=/",
        "http://" + "thenews" * 4000 + ".org/" + "paper/" * 4000]


def counted(spark, words=DICTIONARY):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def model_of(spark, weights=(), unseen=0.0):
    return urls.Model(spark.createDataFrame(list(weights), "token string, weight double"), unseen)


def test_rules_hosts_and_paths(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, URLS[0], "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    pages = pages.selectExpr("*", "'z' AS row", "'z' AS token", "'z' AS words", "'z' AS name")
    got = urls.judge(pages, RULES, counted(spark), model_of(spark)).collect()
    assert len(got) == len(rows)
    by = {r.name: r.verdict for r in RULES}
    for r in got:
        host, path, rule = expected(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, by.get(rule, "allow"))


def plain_tokens(own, host, path):
    return ([f"h:{w}" for part in re.findall("[a-z]+", host.rpartition(".")[0]) for w in own.split(part)]
            + [f"p:{w}" for part in re.findall("[a-z]+", path.lower()) for w in own.split(part)])


def plain_weights(rows, own, words):
    """rows are (host, path, block)."""
    counts = [Counter(t for h, p, k in rows if k is b for t in plain_tokens(own, h, p)) for b in (False, True)]
    size = [c.total() for c in counts]
    every = counts[0] + counts[1]
    factor = [{t: (counts[b][t] + urls.PULL) / (n * size[b] / sum(size) + urls.PULL) for t, n in every.items()} for b in (0, 1)]
    whole = [sum(n / sum(size) * f[t] for t, n in every.items()) for f in factor]
    unseen = math.log(whole[0] / whole[1]) if every else 0.0
    weights = {t: math.log(factor[1][t] / factor[0][t]) + unseen for t in every}
    floors = {k + w: v for w, v in words.items() for k in ("h:", "p:")}
    return weights | {t: max(weights.get(t, unseen), v) for t, v in floors.items()}, unseen


def test_training_counts_every_row(spark):
    rows = [("www.cheappills.org", "/the/news", True)] * 30 + [("thenews.org", "/paper", False)] * 50 + [("", "", False), ("a.b", "/News", None)]
    model = urls.train(spark.createDataFrame(rows, "host string, path string, block boolean"), counted(spark))
    own = urls.Segmenter(DICTIONARY)
    want, unseen = plain_weights(rows, own, urls.LEXICON)
    assert {r.token: r.weight for r in model.weights.collect()} == pytest.approx(want) and model.unseen == pytest.approx(unseen)


def test_labels_alone_block_hosts(spark):
    """Without the fixed words: hosts of words that bad pages have, unseen combinations included, are told from others."""
    rows = [("www.cheappills.org", "/en/1", True)] * 20 + [("therapistnews.org", "/en/2", False)] * 60 + [("www.pillpaper.org", "/en/3", True)] * 20
    model = urls.train(spark.createDataFrame(rows, "host string, path string, block boolean"), counted(spark), words={})
    asked = spark.createDataFrame([(1, "http://pillscheap.net/en/9"), (2, "http://newstherapist.net/en/9"), (3, "http://zzz.net/en/9")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(asked, [], counted(spark), model).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_dictionary_and_empty_tables(spark):
    texts = spark.createDataFrame([("The cat, the CAT x",), (None,), ("dog dog cat",), ("",)], "text string")
    assert {r.word: r.n for r in urls.dictionary(texts).collect()} == {"cat": 3, "dog": 2, "the": 2}
    counts = urls.dictionary(texts.limit(0))
    assert counts.count() == 0
    model = urls.train(spark.createDataFrame([], "host string, path string, block boolean"), counts)
    assert model.unseen == 0 and urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES, counts, model).collect() == []
    got = urls.judge(spark.createDataFrame([(1, "http://a.casino.org/")], "page_id long, url string"), RULES, counts, model).first()
    assert (got.verdict, got.words) == ("block", "h:a h:casino")

"""run() over the small documents table against the same five steps by brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from ranktide.llm import bpe, quality
from tests.conftest import SF
from tests.llm import test_decontam, test_neardup, test_quality, test_substring
from tests.llm.helpers import docs


def distance(p, q):
    m = {k: (p.get(k, 0) / sum(p.values()) + q.get(k, 0) / sum(q.values())) / 2 for k in p.keys() | q.keys()}

    def half(a):
        return sum(v / sum(a.values()) * math.log2(v / sum(a.values()) / m[k]) for k, v in a.items() if v)

    return math.sqrt(max(0, (half(p) + half(q)) / 2))


def character_class(c):
    for i, kind in enumerate((r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\"()\-]", r"[\x00-\x7f]")):
        if re.match(kind, c):
            return i
    return 6


def brute_quality(rows):
    """(doc_id, text) of the kept."""
    classes, words = defaultdict(Counter), defaultdict(Counter)
    own = {i: (Counter(map(character_class, t)), Counter(w.strip(quality.EDGES).lower() for w in t.split())) for i, t, _ in rows}
    for i, _, lang in rows:
        classes[lang] += own[i][0]
        words[lang] += own[i][1]
    common = {}
    for lang, n in words.items():
        common[lang] = sorted((w for w in n if w), key=lambda w: (-n[w], w.encode()))[:100]

    def binned(n, lang):
        out = Counter({w: n[w] for w in common[lang]})
        out["rest of them"] = n.total() - out.total()
        return out

    for i, t, lang in rows:
        far = len(t) >= 200 and distance(own[i][0], classes[lang]) > 0.3
        far = far or len(t.split()) >= 200 and distance(binned(own[i][1], lang), binned(words[lang], lang)) > 0.4
        if not far and not test_quality.base(t)[-1]:
            yield i, t


@pytest.fixture(scope="module")
def stages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [list(brute_quality(rows))]
    ids = {c for _, c in test_neardup.brute(kept[0])}
    kept.append([(i, t) for i, t in kept[0] if i in ids])
    texts = dict(kept[1])
    kept.append([(i, t if gone else texts[i]) for i, _, gone, t in test_substring.brute(kept[1], 50)])
    hit = {r[0] for r in test_decontam.brute(kept[2], items)}
    kept.append([(i, t) for i, t in kept[2] if i not in hit])
    return rows, kept


def test_every_stage_has_work(stages):
    rows, kept = stages
    assert len(rows) > len(kept[0]) > len(kept[1]) > len(kept[3]) and kept[1] != kept[2]


def test_run_agrees_with_brute_force(spark, stages):
    codec = bpe.Codec(bpe.rank_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = dict(stages[1][3])
    assert set(got) == set(want)
    for i, t in want.items():
        ids = codec.encode(t)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded_sha256) == (ids, len(ids), hashlib.sha256(t.encode()).hexdigest())


def test_stages_return_the_columns_of_documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS extra")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in given.drop("extra").schema]
        assert out.where("n_chars <> length(text)").isEmpty()


def test_stages_on_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, None), (3, "a b"), (None, "word " * 80)]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs(spark, rows), SF).collect()
        assert stage(spark, docs(spark, []), SF).collect() == []


def test_rows_without_or_with_repeated_ids_are_told_apart(spark):
    """Unlike clean rows under null ids or one id stay in every stage that removes rows; copies of them go."""
    import random

    from ranktide.llm import decontam, neardup

    rng = random.Random(5)
    say = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(80))
    free, same = [say() for _ in range(30)], [say() for _ in range(5)]
    rows = [(None, t) for t in free] + [(7, t) for t in same] + [(1, free[0]), (None, free[1]), (2, same[0] + " x"), (7, same[1])]
    got = sorted((r.doc_id, r.text) for r in neardup.representatives(docs(spark, rows).repartition(4)).fillna(-1, ["doc_id"]).collect())
    assert got == sorted([(-1, t) for t in free[1:]] + [(7, t) for t in same[1:]] + [(1, free[0]), (2, same[0] + " x")])
    items = spark.createDataFrame([(1, free[3][:120]), (2, same[2][:120])], "item_id long, text string")
    left = sorted(r.text for r in decontam.clean(docs(spark, rows), items).collect())
    assert left == sorted(t for _, t in rows if t not in (free[3], same[2]))

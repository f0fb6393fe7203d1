"""Extra columns of any name, and very long texts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from ranktide.llm import decontam, lm, neardup, quality, sharding, substring
from tests.llm.helpers import docs

NAMES = ("_node", "_PLACE", "_place_", "_rep", "_lead", "node", "component", "_hit", "text_key", "TEXT_KEY_", "tag", "_at", "_places",
         "_places_", "first", "last", "item_id", "bucket")


def say(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [say(rng, 120) for _ in range(12)]
    texts += [texts[0] + " more", texts[1], say(rng, 60) + " " + " ".join(texts[2].split()[:70])]
    return list(enumerate(texts))


def same_but_for_names(plain, odd, of=NAMES):
    assert odd.columns == [*plain.columns, *of]
    got = [r.asDict() for r in odd.collect()]
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in got for c in of)
    keys = plain.columns
    assert sorted(str([r[c] for c in keys]) for r in got) == sorted(str(list(r)) for r in plain.collect()) != []


def test_extra_columns_of_any_name_stay(spark, rows):
    plain = docs(spark, rows)
    odd = plain.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in NAMES])
    items = spark.createDataFrame([(1, " ".join(rows[3][1].split()[:30]))], "item_id long, text string")
    for work in (neardup.representatives, lambda d: decontam.clean(d, items)):
        assert work(plain).count() < len(rows)
        same_but_for_names(work(plain), work(odd))
    cut = substring.remove_repeats(plain)
    assert cut.where("n_removed > 0").count() == 3
    same_but_for_names(cut, substring.remove_repeats(odd, keep=NAMES))


def test_names_of_the_result_are_refused(spark, rows):
    odd = docs(spark, rows[:1]).withColumn("N_words", F.lit(1))
    for work in (quality.judge, substring.remove_repeats):
        with pytest.raises(ValueError, match="n_words"):
            work(odd, keep=("N_words",))


def test_very_long_texts(spark, rows):
    rng = random.Random(12)
    long, item = say(rng, 200_000), say(rng, 20)
    near = long.split()
    near[777] = "other"
    texts = [*rows[:4], (50, long), (51, " ".join(near)), (52, say(rng, 100_000) + " " + item + " " + say(rng, 100_000))]
    d = docs(spark, texts)
    assert {r.doc_id: r.n_words for r in quality.judge(d).collect()} == {i: len(t.split()) for i, t in texts}
    assert {r.doc_id: r.class_id for r in neardup.classes(d).collect()} == {i: 50 if i == 51 else i for i, _ in texts}
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.find(d, items).collect()] == [(52, 9)]
    scored = lm.score(d.select("doc_id", "text"), d.select("doc_id").where("doc_id = 50"))
    assert {r.doc_id: r.n_tokens for r in scored.collect()} == {i: len(t.split()) for i, t in texts}
    placed = sharding.assign_shards(d, sharding.even_tree(40), sharding.even_tree(41)).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in placed} == {i: (len(t) + 16, zlib.crc32(t.encode())) for i, t in texts}

import math
import random
import re
from collections import Counter

import pytest

from ranktide.llm import lm
from tests.llm.helpers import docs


def brute(rows, target, size, pull=lm.PULL):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    n = Counter(w for t in texts for w in t)
    words = sorted(n, key=lambda w: (-n[w], w))[:size]
    model = {}
    for name in ("target", "all"):
        pairs, own, before = Counter(), Counter(), Counter()
        for (i, _), t in zip(rows, texts):
            if name == "all" or i in target and i is not None:
                t = [w if w in words else None for w in t]
                for a, b in zip(["<s>", *t], t):
                    pairs[a, b] += 1
                    own[b] += 1
                    before[a] += 1
        model[name] = pairs, own, before
    entries = len(words) + 1

    def loss(name, t):
        pairs, own, before = model[name]
        t = [w if w in words else None for w in t]
        total = 0
        for a, b in zip(["<s>", *t], t):
            alone = (own[b] + 1) / (own.total() + entries)
            total -= math.log((pairs[a, b] + pull * alone) / (before[a] + pull))
        return total / len(t) if t else None

    return [(i, len(t), loss("target", t), loss("all", t)) for (i, _), t in zip(rows, texts)]


@pytest.mark.parametrize("targets", [[1, 3, 5, 7, 9, 9, None, 12345], []])
def test_agrees_with_brute_force(spark, targets):
    rng = random.Random(1)
    vocabulary = [f"W{i}é" for i in range(60)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 90])))) for i in range(40)]
    rows += [(3, rows[3][1]), (None, "W1é W2é"), (99, None)]
    target = spark.createDataFrame([(t, "x") for t in targets], "doc_id long, text string")
    got = lm.score(docs(spark, rows, extra=True).repartition(3), target, size=25).collect()
    want = brute(rows, set(targets), 25)
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


def test_target_like_texts_score_lower(spark):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=80))) for i in range(80)]
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r.difference for r in lm.score(docs(spark, rows), target).collect()}
    assert max(got[i] for i in range(41, 80, 2)) < min(got[i] for i in range(0, 80, 2))  # held out and others


def test_empty_table(spark):
    assert lm.score(docs(spark, []), spark.createDataFrame([], "doc_id long")).collect() == []


def test_rare_words_are_told_apart(spark):
    """3,000 distinct words: texts that differ in rare words only have different losses, as by brute force."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.choices(common, k=200) + [f"r{i}x{k}" for k in range(10)])) for i in range(150)]
    rows += [(200, "c1 c2 r1x1 r1x2 c3"), (201, "c1 c2 r7x8 r2x5 c3")]
    target = spark.createDataFrame([(t,) for t in range(0, 100, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm.score(docs(spark, rows).repartition(5), target).collect()}
    for i, n, ours, all_ in brute(rows, set(range(0, 100, 2)), 10**6):
        assert (got[i].n_tokens, got[i].target_loss, got[i].background_loss) == (n, pytest.approx(ours), pytest.approx(all_))
    assert got[200].background_loss != pytest.approx(got[201].background_loss)

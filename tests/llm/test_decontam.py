import random
import re

from ranktide.llm import decontam
from tests.llm.helpers import docs


def shingle_set(text):
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)}


def brute(rows, items, threshold=0.8):
    out = []
    for i, t in rows:
        own = shingle_set(t)
        for k, x in items:
            want = shingle_set(x)
            if want and len(want & own) >= threshold * len(want):
                out.append((i, k, round(len(want & own) / len(want), 9), len(want)))
    return sorted(out, key=repr)


def made_up():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([5, 6, 8, 9, 14, 20, 25, 33, 40, 59, 70, 130, 300] * 3)]
    items += [(100, "too few words here"), (101, None), (102, ""), (3, items[5][1]), (103, items[5][1])]
    rows = []
    for i in range(300):
        words = say(rng.choice([0, 3, 50, 400, 3000]))
        if i % 2:
            passage = rng.choice(items[:39])[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = ["(" + passage[0], *passage[1:-1], passage[-1].upper() + ")."]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    return rows + [(7, rows[1][1]), (None, items[8][1]), (900, None)], items


def test_agrees_with_brute_force(spark):
    rows, items = made_up()
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    want = brute(rows, items)
    assert len(want) > 60
    for block_bytes in (decontam.BLOCK_BYTES, 8000):  # one block of items, several
        got = decontam.find(docs(spark, rows, extra=True).repartition(4), bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.containment, 9), r.n_shingles) for r in got), key=repr) == want
    kept = decontam.clean(docs(spark, rows), bench)
    hit = {r[0] for r in want}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, _ in rows if i not in hit)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontam.find(docs(spark, []), bench).collect() == []
    assert decontam.find(docs(spark, [(1, "a b c d e f g")]), bench.limit(0)).collect() == []


def test_short_and_repetitive_items_are_always_candidates():
    """Verbatim items of five to eight words, and of few distinct shingles, in texts of any length."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(say(5 + i % 4))) for i in range(1500)] + [(i, " ".join(say(6) * 30)) for i in range(1500, 1600)]
    texts = [decontam.item_shingles(" ".join(say(rng.randrange(200)) + [t] + say(rng.randrange(200)))) for _, t in items]
    index = decontam.Index(items)
    found = {(a + t, i) for a in range(0, len(texts), 100) for t, i in index.candidates(texts[a: a + 100])}
    assert {(i, i) for i in range(len(items))} <= found

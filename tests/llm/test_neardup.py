import random
import re
from collections import Counter

import numpy as np
import pytest

from ranktide.llm import neardup
from ranktide.llm.graph import components
from tests.llm.helpers import docs


def weighted_jaccard(a, b):
    def bag(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        k = min(5, len(w))
        return Counter(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if k else Counter({(): 1})

    x, y = bag(a), bag(b)
    return (x & y).total() / (x | y).total()


def brute(rows, threshold=0.8):
    """(doc_id, class_id) per row."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and rows[j][1] is not None and weighted_jaccard(rows[i][1], rows[j][1]) >= threshold:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, low[find(i)] if t is not None else d) for i, (d, t) in enumerate(rows)), key=repr)


def made_up(seed, n=50):
    rng = random.Random(seed)
    vocabulary = [f"Wort{i}ä" if i % 3 == 0 else f"w{i}" for i in range(2000)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 80, 200, 500]))
        if i % 9 == 0:
            words = words[:7] * 30  # heavy multiplicities
        rows.append(words)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # copies with a few changes, drifting away
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words + words[: len(words) // 9]
            rows.append(words)
    ids = rng.sample(range(10_000), len(rows))
    out = [(i, " ".join(w)) for i, w in zip(ids, rows)]
    return out + [(out[3][0], out[8][1]), out[5], (None, out[6][1]), (20_000, None), (20_001, None), (20_002, ""), (20_003, " \n"),
                  (20_004, out[9][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_agree_with_brute_force(spark, seed):
    rows = made_up(seed)
    got = neardup.classes(docs(spark, rows, extra=True).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_hot_group_and_drifting_chain(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):  # near copies of one text, most not alike enough to one another's leader
        words = list(base)
        for p in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 5, 6, 9])):
            words[p] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 3 == 0:  # a twin of its own, which may be the only one alike
            words[rng.randrange(150)] = "twin"
            rows.append((5000 + i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(100)]
    words = [f"c{i}" for i in range(100)]
    for i in range(40):  # each like the one before
        rows.append((2000 - i, " ".join(words)))
        words = words[1:] + [f"d{i}"]
    got = neardup.classes(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    kept = neardup.representatives(docs(spark, rows + [rows[0]])).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute(rows)})


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 300).astype(np.uint64)
    for make in (lambda: np.ones(300, np.int64), lambda: rng.integers(1, 9, 300), lambda: rng.integers(1, 100, 300)):
        wa, wb = make(), make()
        wb[:200] = wa[:200]
        wa[290:], wb[:20] = wa[290:] + 5, wb[:20] + 3
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        sig = neardup.signatures([(values, wa), (values, wb)], 4096)
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5 + 0.002


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    bags = [(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), None) for n in (1, 2, 40, 3000)]
    bags = [(v, rng.integers(1, 6, len(v))) for v, _ in bags]
    whole = neardup.signatures(bags, 130)
    for one, row in zip(bags, whole):
        assert (neardup.signatures([one], 130)[0] == row).all()


def test_prefixes_of_differences_meet_for_every_link():
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]

    def changed(words):
        words = list(words)
        for _ in range(rng.randrange(6)):
            p = rng.randrange(len(words))
            words[p: p + rng.randrange(2)] = [f"x{rng.randrange(30)}"] * rng.randrange(3)
        return words

    texts = [changed(base) for _ in range(60)]
    texts += [changed(t) for t in texts]
    sets = [neardup.expanded(neardup.hashes_of(" ".join(t))) for t in [base, *texts]]
    pivot, sims, met = sets[0], [neardup.similarity(sets[0], s) for s in sets], 0
    k, parts = 1 / 9, []
    for s, sim in zip(sets, sims):
        apart = np.setxor1d(pivot, s)
        parts.append((apart, apart[: neardup.prefix(len(apart), len(s), sim >= 0.8, 0.8)], len(apart) - k * len(s)))
    for i in range(1, len(sets)):
        for j in range(1, len(sets)):
            if i != j and 0.6 <= sims[i] < 0.8 and neardup.similarity(sets[i], sets[j]) >= 0.8:
                (x, px, sx), (y, py, sy) = parts[i], parts[j]
                need = int(np.ceil((sx + sy) / 2 - 1e-9))
                own, other = px[: len(x) - need + 1], py[: len(y) - need + 1]
                both = np.intersect1d(own, other)
                assert both.size  # and what the join adds up is enough
                assert both.size + min(len(x) - 1 - np.flatnonzero(x == both[-1])[0], len(y) - 1 - np.flatnonzero(y == both[-1])[0]) >= need
                met += 1
    assert met >= 10


def test_near_copies_make_few_pairs(spark, monkeypatch):
    """3,000 copies with one to three changed words: under 20 candidates a member, and the classes of brute force."""
    rng, rows = random.Random(8), []
    base = [f"b{i}" for i in range(150)]
    for i in range(3000):
        words = list(base)
        for p in rng.sample(range(150), rng.choice([1, 1, 2, 2, 3])):
            words[p] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    asked, verified = [], neardup._verified

    def spy(pairs, texts, threshold):
        asked.append(pairs.count())
        return verified(pairs, texts, threshold)

    monkeypatch.setattr(neardup, "_verified", spy)
    got = dict(map(tuple, neardup.classes(docs(spark, rows)).collect()))
    assert sum(asked) < 20 * len(rows), asked
    sets = [neardup.expanded(neardup.hashes_of(t)) for _, t in rows]
    names = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    grid = np.zeros((len(rows), len(names)), np.float32)
    for i, x in enumerate(sets):
        grid[i, [names[e] for e in x.tolist()]] = 1
    common = grid @ grid.T
    size = np.array(list(map(len, sets)))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, j in np.argwhere(np.triu(common >= 0.8 * (size[:, None] + size[None, :] - common) - 1e-4, 1)).tolist():
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    assert got == {i: top(i) for i in range(len(rows))}


def test_nodes_of_one_component_are_no_rows_for_each_other(spark):
    """Beside a pivot: nodes of its component that all hold an element, some of which ask, and two outside nodes that
    hold another one. Only these two can meet."""
    prefixes = [(b"p", b"in%d" % i, i % 2 == 1, 0, 3, 1.0, [(7, 1)]) for i in range(40)]
    prefixes += [(b"p", b"out%d" % i, i == 0, 0, 3, 1.0, [(9, 1), (100 + i, 2)]) for i in range(2)]
    prefixes = spark.createDataFrame(prefixes, "p binary, node binary, asks boolean, level int, differs long, s double, "
                                               "x array<struct<e: long, at: long>>")
    found = spark.createDataFrame([(b"in%d" % i, b"a") for i in range(40)] + [(b"p", b"a")], "node binary, component binary")
    made, materialise = {}, neardup.materialise

    def spy(df, name):
        made[name] = materialise(df, name)
        return made[name]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(neardup, "materialise", spy)
        pairs = [tuple(map(bytes, r)) for r in neardup._open_pairs(prefixes, found, 0).select("a", "b").collect()]
    assert pairs == [(b"out0", b"out1")]
    assert sorted(bytes(r.node) for r in made["asked"].collect()) == [b"out0", b"out1"]


def test_empty_table(spark):
    assert neardup.classes(docs(spark, [])).collect() == []
    assert neardup.classes(docs(spark, [(4, None), (4, None)])).collect() == [(4, 4), (4, 4)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)]
    edges += [(600, i) for i in range(601, 700)] + [(5, 5), (7, 8), (7, 8)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for one_task in (0, 10**6):  # in rounds, in one task
        got = components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()
        assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)
        assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).collect() == []

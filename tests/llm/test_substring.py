import random
import re

import numpy as np
import pytest

from ranktide.llm import substring
from tests.llm.helpers import docs


def brute(rows, width):
    """(doc_id, n_words, n_removed, text) per row; ``rows`` in any order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - width + 1):
                k = tuple(w[p: p + width])
                first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for p in range(len(w) - width + 1):
                if first[tuple(w[p: p + width])] < i:
                    gone.update(range(p, p + width))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=repr)


def made_up(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"W{i}," for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:8])] + [rows[4], (6, rows[9][1]), (None, rows[2][1]), (2000, None),
             (2001, ""), (2002, "a " * 300), (2003, "a " * 200)]
    return rows


@pytest.mark.parametrize("width,bits", [(50, 20), (12, 20), (4, 20), (50, 7)])
def test_agrees_with_brute_force(spark, width, bits):
    rows = made_up(width)
    got = substring.remove_repeats(docs(spark, rows, extra=True).repartition(5), width=width, cell_bits=bits).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width)


def test_columns_kept_and_empty_table(spark):
    df = docs(spark, [(1, "a b"), (2, None)])
    got = substring.remove_repeats(df, keep=("lang", "n_chars")).collect()
    assert {(r.doc_id, r.text, r.lang, r.n_chars) for r in got} == {(1, "a b", "en", 3), (2, "", "en", None)}
    assert substring.remove_repeats(docs(spark, [])).collect() == []


def test_very_long_text(spark):
    long = " ".join(str(i % 9973) for i in range(400_000))
    part = " ".join(str(i % 9973) for i in range(5000, 5100))
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, [(1, part), (2, long)])).collect()}
    assert got[1].n_removed == 0 and got[2].n_words == 400_000 and got[2].n_removed == 100 * 40


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 2**63, 101).astype(np.uint64)
    for w in (1, 2, 41, 101, 102):
        assert substring.sliding_min(v, w).tolist() == [min(v[i: i + w]) for i in range(len(v) - w + 1)]

import math
import random
import re
from collections import Counter

import pytest

from ranktide.llm import quality
from tests.llm.helpers import DOCS, docs

FRENCH = "le chat de la maison est sur une table et il ne veut pas de lait, dit la dame. "
ENGLISH = "The cat of the house is on a table and it does not want the milk, said the lady. "


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(words[i: i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if n[tuple(words[i: i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def plain(text, n):
    """Text of few repeated triples."""
    rng = random.Random(n)
    return " ".join(rng.choices(text.split(), k=n))


def test_base_counts_and_verdicts(spark):
    rows = [(i, plain(ENGLISH, 60 + i)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a a a a a"), (103, "x\n\n x\nx\n \t\nx"), (104, "a b c d a b c " * 40),
             (105, "#*$%&|<> " * 60), (106, plain(FRENCH, 250)), (107, "é" * 500), (1, plain(ENGLISH, 61)),
             (108, plain("| # $ 12 % & 77 * < > 9 0 = + 31 / 55", 200)), (None, plain(ENGLISH, 120))]
    got = quality.judge(docs(spark, rows, extra=True)).collect()
    want = sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got), key=repr) == want
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(60)) and kept[None]
    assert not any(kept[i] for i in (100, 101, 102, 103, 104, 105, 106, 107, 108))
    by = {r.doc_id: r for r in got}
    assert by[106].word_distance > 0.4 and by[59].word_distance is None and by[103].class_distance is None


def test_languages_have_their_own_reference(spark):
    rows = [(i, plain(ENGLISH, 200 + i), "en") for i in range(30)] + [(100 + i, plain(FRENCH, 200 + i), "fr") for i in range(30)]
    rows += [(200, plain(FRENCH, 200), "en"), (201, plain(ENGLISH, 230), None), (202, plain(ENGLISH, 230), "rare")]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows], DOCS)
    got = {r.doc_id: r for r in quality.judge(df, keep=("source",)).collect()}
    assert all(r.kept for i, r in got.items() if i != 200) and not got[200].kept and got[1].source == "s"


def test_references_count_every_document(spark):
    rows = [(1, "The cat, the Dog", "en"), (2, "THE end.", "en"), (3, None, "en"), (4, "chat", "fr")]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows], DOCS)
    found = quality.references(df, quality.Rules(common=2))
    assert found["en"] == ([13, 5, 0, 4, 2, 0, 0], {"the": 3, "cat": 1}, 6)
    assert found[""][2] == 7 and set(found) == {"", "en", "fr"}


def test_distance():
    import numpy as np

    assert quality.distance(np.array([3, 0]), np.array([0, 5])) == pytest.approx(1)
    assert quality.distance(np.array([3, 9]), np.array([1, 3])) == pytest.approx(0)
    p, q = np.array([1, 3]), np.array([2, 2])
    m = (0.375, 0.625)
    js = sum(0.5 * a * math.log2(a / b) for a, b in zip((0.25, 0.75), m)) + sum(0.5 * a * math.log2(a / b) for a, b in zip((0.5, 0.5), m))
    assert quality.distance(p, q) == pytest.approx(math.sqrt(js))


def test_empty_table(spark):
    assert quality.judge(docs(spark, [])).collect() == []


RUSSIAN = "Кот из дома сидит на столе и не хочет пить молоко, сказала дама в большой шляпе. "


@pytest.mark.parametrize("block_langs", [1024, 2])
def test_small_languages_have_their_own_reference(spark, block_langs):
    """Languages of under 1/256 of all words, in one block of references and in several."""
    rows = [(1, plain(ENGLISH, 70_000), "en"), (2, plain(ENGLISH, 300), "en"), (5, plain(FRENCH, 220), "fr"),
            (6, plain(ENGLISH, 230), None), (7, plain(FRENCH, 240), None), (8, "1 2 3 4 5 | # $ < > " * 60, None)]
    rows += [(10 + i, plain(RUSSIAN, 60 + i), "ru") for i in range(3)] + [(20, "Короткий", "xx"), (21, None, "yy")]
    df = spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows], DOCS)
    got = {r.doc_id: r for r in quality.judge(df, quality.Rules(block_langs=block_langs)).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r.kept} == {2, 5, 6, 7, 10, 11, 12}
    assert got[10].class_distance < 0.1 and got[21].class_distance is None

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ranktide.llm import bpe, langid, queries
from tests.conftest import SF
from tests.llm.helpers import DOCS

RANKS = bpe.rank_file(public_tokenizers.path(queries.TOKENIZER))
PIECES = langid.vocabulary(RANKS)
SMALL = [bytes([i]) for i in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab", b"ca", b"\xc3\xa9", b" abcab"]


def ways(unit):
    """All segmentations into pieces of SMALL, by piece number."""
    number = {p: i for i, p in enumerate(SMALL)}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        parts = [unit[a:b] for a, b in zip(at, at[1:])]
        if all(p in number for p in parts):
            yield [number[p] for p in parts]


def test_sums_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(3)
    model = rng.random((len(SMALL), 3)) * 0.1
    lattice = langid.Lattice(SMALL)
    units = [b" abcab", b" a", b"bc", b" abc", " é".encode(), b"c", b" zzzzzzzz", b"abcabcabc"]
    want = np.array([[sum(np.prod(model[w, k]) for w in ways(u)) for k in range(3)] for u in units])
    np.testing.assert_allclose(langid.log_sums(lattice, units, model), np.log(want))
    of, times = np.array([0, 1, 2, 0, 1, 2, 0, 1]), np.arange(1, 9)
    counts = np.zeros(model.shape)
    for u, k, n in zip(units, of, times):
        total = sum(np.prod(model[w, k]) for w in ways(u))
        for w in ways(u):
            for p in w:
                counts[p, k] += n * np.prod(model[w, k]) / total
    np.testing.assert_allclose(langid.expected(lattice, units, of, times, model), counts, atol=1e-12)


def test_units_cover_whole_texts(monkeypatch):
    long = "x" * 60 + " déjà-vu don't"
    units, at, text, _ = langid.units_of(["Ab ab, 12 AB", "", long, "日本"])
    got = [(int(t), units[i]) for i, t in zip(at, text)]
    assert got == [(0, b" ab")] * 3 + [(2, b" " + b"x" * 24), (2, b"x" * 24), (2, b"x" * 12), (2, " déjà".encode()), (2, b" vu"), (2, b" don't"),
                                       (3, " 日本".encode())]
    monkeypatch.setattr(langid, "_SLICE", 50)
    assert "".join(langid._parts(long * 9)) == long * 9 and langid.units_of([]) [0] == []


def plain_scores(texts, model):
    """Texts' log probabilities by a dictionary and one loop over each unit."""
    number = {p: i for i, p in enumerate(PIECES)}
    logs, out = {}, []
    for t in texts:
        units, at, *_ = langid.units_of([t])
        total = 0
        for i in at:
            u = units[i]
            if u not in logs:
                sums = [np.ones(model.shape[1])]
                for end in range(1, len(u) + 1):
                    sums.append(sum(sums[s] * model[number[u[s:end]]] for s in range(end) if u[s:end] in number))
                logs[u] = np.log(sums[-1])
            total = total + logs[u]
        out.append(total)
    return out


@pytest.fixture(scope="module")
def answered(spark):
    return {r.doc_id: r for r in queries.op13_langid(spark, SF).collect()}


def test_query_finds_held_out_languages(spark, answered):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert len(answered) == len(docs) and {i for i, r in answered.items() if r.held_out} == {d.doc_id for d in held}
    right = [answered[d.doc_id].lang_pred == d.lang for d in held if d.lang and any(map(str.isalpha, d.text or ""))]
    assert len(right) > 30 and np.mean(right) >= 0.95, np.mean(right)
    assert all(0 <= r.score <= 1 for r in answered.values())


def test_prediction_equals_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60")
    model = langid.train(docs.where("doc_id < 40"), PIECES, 1)
    rows = docs.where("length(text) < 4000").collect()
    logs = plain_scores([r.text or "" for r in rows], model.blocks[0].value.astype(float))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r, t in zip(rows, logs):
        if np.ndim(t):
            assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(t))]
            assert got[r.doc_id].score == pytest.approx(1 / np.exp(t - max(t)).sum(), abs=1e-6)


def test_odd_rows_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 2)  # several blocks of languages
    monkeypatch.setattr(langid, "_CACHE_BYTES", 100)  # units are forgotten again and again
    words = defaultdict(list, de="der die und nicht ein", en="the of and not one", es="el la y no uno", fr="le la et pas un", ja="これ は 日本語 です")
    rows = [(k * 10 + i, " ".join([w] * 9), lang, "s", 1) for k, (lang, w) in enumerate(words.items()) for i in range(10)]
    odd = [(900, None, "en", None, None), (901, "", "en", "s", 0), (902, "12 34 !?", "en", "s", 3), (None, "the of and", None, "s", 1),
           (903, "日本語 は " * 9, None, None, 1), (904, "xo yuq ziq vorp " * 60_000, "zz", "s", 1), (904, "der die und", "de", "s", 1), (904, "der die und", "de", "s", 1)]
    frame = spark.createDataFrame(rows + odd, DOCS)
    for name in ("unit", "n", "score", "piece", "held_out", "lang_pred"):
        frame = frame.withColumn(name, F.lit("x"))
    got = defaultdict(list)
    for r in langid.identify(frame, RANKS).collect():
        got[r.doc_id].append(r)
    assert [got[i][0].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and [got[i][0].score for i in (900, 901, 902)] == [0.0] * 3
    assert got[None][0].lang_pred == "en" and not got[None][0].held_out and got[903][0].lang_pred == "ja"
    assert sorted(r.lang_pred for r in got[904])[:2] == ["de", "de"] and len(got[904]) == 3
    assert all(got[r[0]][0].lang_pred == r[2] for r in rows)
    nothing = langid.identify(spark.createDataFrame([], DOCS), RANKS)
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "held_out", "lang_pred", "score"]
    untaught = langid.identify(spark.createDataFrame([(1, "words", None, None, 5)], DOCS), RANKS).first()
    assert (untaught.lang_pred, untaught.score) == ("und", 0.0)

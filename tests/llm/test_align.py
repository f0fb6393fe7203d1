import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ranktide.llm import align, queries
from tests.conftest import SF
from tests.llm.helpers import docs

FILES = [open(public_tokenizers.path(n), "rb").read() for n in (queries.SIDE_A, queries.SIDE_B)]
A = Tokenizer.from_file(public_tokenizers.path(queries.SIDE_A))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.SIDE_B))
UNSPELL = {c: b for c, b in align.byte_alphabet().items()}


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    """By both libraries, all token pairs held against each other."""
    facts, holders = [], defaultdict(set)
    for row, (doc, text) in enumerate(rows):
        links, n_a, n_b, groups = [], 0, 0, ""
        if text:
            code = A.encode(" " + text, add_special_tokens=False)
            ids_b = B.encode(text)
            a = [bytes(UNSPELL[c] for c in t) for t in code.tokens]
            b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in zip(ids_b, (B.id_to_piece(i) for i in ids_b))]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                one, two = spans(a), spans(b)
                first = 0
                for i, (s, e) in enumerate(one):
                    while two[first][1] <= s:
                        first += 1
                    j = first
                    while j < len(two) and two[j][0] < e:
                        links.append((code.ids[i], ids_b[j]))
                        j += 1
                ends = sorted({e for _, e in one} & {e for _, e in two})
                parts, s = [], 0
                for e in ends:
                    parts.append(",".join(str(x) for x, (u, v) in zip(code.ids, one) if s <= u and v <= e) + "|"
                                 + ",".join(str(x) for x, (u, v) in zip(ids_b, two) if s <= u and v <= e))
                    s = e
                groups = ";".join(parts)
        for pair in links:
            holders[pair].add(row)
        facts.append((doc, n_a, n_b, groups, links))
    most = Counter()
    for (a, _), held in holders.items():
        most[a] = max(most[a], len(held))
    return [(doc, n_a, n_b, groups.count("|") if groups else 0, len(links), sum(len(holders[p]) == most[p[0]] for p in links),
             sum(len(holders[p]) for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, groups, links in facts]


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


ODD = ["", None, "a", " ", "  leading and trailing  ", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "日本語 テキスト。", "🙂🙃" * 9,
       "don't we'll I'VE 123456 3.14", "\n\n\t tabs \r\n", "nul \x00 here", "é é ﬁ ①", "x" * 5000, "�﻿", "||;;,,|1,2"]


def test_odd_texts_ties_and_repeats(spark):
    rows = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "the same words"), (None, "the same words"), (90, "very long words " * 20_000)]
    short = [(i, t) for i, t in rows if t is None or len(t) < 10_000]
    got = align.align(docs(spark, short, extra=True).withColumn("run", F.lit("x")).withColumn("radix", F.lit("y")), *FILES, radices=3)
    assert plain(got) == sorted(map(repr, brute(short)))
    assert align.align(docs(spark, []), *FILES).collect() == []
    long = align.align(docs(spark, rows[-1:]), *FILES).first()
    assert long.n_links == long.count_sum == long.n_best and long.n_a > 50_000 and long.n_links == long.n_a + long.n_b - long.n_groups


def test_every_character_splits_alike():
    """The faster encoder gives the library's ids beside every kind of character."""
    codecs = align.Codecs(*FILES, public_tokenizers.PATTERN)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        text = "".join(f" a{chr(c)}1{chr(c)} {chr(c)}-" for c in points[i: i + 4096])
        assert A.encode(text, add_special_tokens=False).ids == codecs.a.encode_ordinary(text), hex(points[i])


def test_merge_counts_and_marks_like_a_dictionary():
    rng = random.Random(5)
    runs, want = [], Counter()
    for _ in range(9):
        own = Counter(rng.choice([rng.randrange(1 << 31), rng.randrange(200) << 14]) for _ in range(rng.choice([0, 1, 7000])))
        want.update(own)
        runs.append(align.packed(*np.array(sorted(own.items()), np.int64).reshape(-1, 2).T))
    got = dict(align.marked(align.merged(runs)))
    most = Counter()
    for p, n in want.items():
        most[p >> align.B_BITS] = max(most[p >> align.B_BITS], n)
    assert got == {p: 2 * n + (n == most[p >> align.B_BITS]) for p, n in want.items()}
    again = align.unpacked(align.run_of(align.merged(runs)), 2)
    assert dict(again.tolist()) == want and (np.diff(again[:, 0]) > 0).all()


def test_many_runs_in_several_merges(spark, monkeypatch):
    """Runs of few links, merged two by two, give what one run gives; one text is half of all rows."""
    rng = random.Random(3)
    words = "the of and Straße naïve tokenization alignment 2024 ,.".split()
    rows = [(i, "the same row" if i % 2 else " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(80)]
    monkeypatch.setattr(align, "RUN_LINKS", 30)
    got = align.align(docs(spark, rows).repartition(3), *FILES, fan=4, radices=2)
    assert plain(got) == sorted(map(repr, brute(rows)))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows]
    assert plain(queries.op12_alignment(spark, SF)) == sorted(map(repr, brute(rows)))

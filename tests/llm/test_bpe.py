import hashlib

import public_tokenizers
import pytest

from ranktide.llm import bpe
from tests.llm.helpers import docs

RANKS = bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
TEXTS = ["", "a", "it's  we'll \n\n 12 é😀 end  ", "word " * 40, "x" * 300, " " * 200 + "a" + "  " * 9,
         "don't \n stop's" * 30, "日本語 テキスト。" * 20, "'" * 50 + "s" * 3, "a\n \n b" * 33]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 50])
def test_chunks_stitch_to_the_whole(size):
    for text in TEXTS:
        parts = []
        for a, b in bpe.cut(text, size):
            parts.append((a, b, *bpe.encode_chunk(CODEC, text[a:b])))
        assert [i for ids in bpe.stitch(parts) for i in ids] == CODEC.encode(text), (size, text[:30])


def test_encode_matches_the_library(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, None), (77, "some words, many of them. " * 3000)]
    out = bpe.encode(docs(spark, rows, extra=True), RANKS, with_ids=True, chunk_chars=64).collect()
    want = []
    for i, t in rows:
        ids = CODEC.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    assert bpe.encode(docs(spark, []), RANKS).collect() == []

"""Cross-entropy difference of a target and a background language model.

Both are word bigram models over one vocabulary, all lower-cased words of all documents (or the ``size`` most frequent,
if one is given) and one entry for all others, with the same smoothing; a word's probability after another is the
relative frequency of the pair, pulled towards the word's own by ``pull`` pseudo-counts, and the word's own has one
count added. The target model counts the target documents, the background model counts all documents. A document's
score is its mean loss per token under the target model less that under the background model: the lower, the more it
is like the target.

Texts become chunks of about a quarter of a million tokens once: the hashes of a chunk's words and the tokens as places among them.
A chunk asks for the counts of its distinct words and pairs, told by 64-bit hashes. The hash space is cut into buckets
that grow with the input; each sums what all chunks hold of its keys and answers each chunk in the order it asked. So
the models are tables that grow with the corpus, spread over the buckets; no task or driver holds them whole."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import bit_filter, bounded_batches, filter_bit, in_filter, materialise
from ranktide.llm.words import MULTIPLIER, OTHER_MULTIPLIER, mix, word_hashes

#: no bound: more words than rows can be counted
VOCABULARY = (1 << 63) - 1
PULL = 10.0
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHUNK = 1 << 18
CHUNK_DOCS = 1 << 16
#: buckets, and bytes of text for each from where more are needed
BUCKETS = 256
BUCKET_BYTES = 1 << 24
_FLUSH = 200_000
_START, _OTHER = np.uint64(1), np.uint64(2)
_LONGS, _INTS, _BOOLS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())
_CHUNKS = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("doc_ids", _LONGS),
                     ("lengths", _INTS), ("ours", _BOOLS), ("n", pa.int64()), ("n_docs", pa.int64()),
                     ("our_n", pa.int64()), ("our_docs", pa.int64())])
_CHUNKS_SQL = ("chunk long, words binary, tokens binary, doc_ids array<long>, lengths array<int>, ours array<boolean>, "
               "n long, n_docs long, our_n long, our_docs long")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> dict[str, int]:
    """The most frequent words of all documents (ties: the smaller word) and their numbers."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(it):
        found = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)
            found.clear()
            return out

        for batch in it:
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
                if len(found) > _FLUSH:
                    yield rows()
        if found:
            yield rows()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return {r.word: i for i, r in enumerate(top.collect())}


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as the planes of their bytes, as many as the largest needs."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(n)


def chunks(docs: DataFrame, target: DataFrame, words: dict[str, int] | None) -> DataFrame:
    """The rows (doc_id, text) in chunks: the hashes of the words, the more frequent first, each token's place among
    them, and whether ``target`` holds a row's doc_id. ``words`` names those that are told apart (none: all).

    A bit filter tells most other rows where they lie, so only the targets (and a few others) are shuffled with the
    ids; by the same join at every size."""
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(ids))
    known = None if words is None else np.sort(word_hashes(" ".join(words)))

    def passes(batch) -> np.ndarray:
        at = batch.column("at").to_numpy(zero_copy_only=False)
        return (at >= 0) & in_filter(shared.value, np.maximum(at, 0))

    def met(it):
        for batch in it:
            yield batch.select(["doc_id", "text"]).filter(pa.array(passes(batch)))

    def row(held):
        ids, ours, tokens = zip(*held)
        lengths = np.array([len(t) for t in tokens], np.int64)
        own, place, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        full, our = lengths > 0, np.array(ours, bool)
        values = [uuid.uuid4().int >> 65, own[order].tobytes(), packed(rank[place]), list(ids), lengths.tolist(), list(ours),
                  int(lengths.sum()), int(full.sum()), int(lengths[our].sum()), int((full & our).sum())]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNKS)], schema=_CHUNKS)

    def work(it):
        held, size = [], 0
        for batch in it:
            batch = batch.filter(pa.array(~passes(batch)))
            for i, text, ours in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ours"))):
                tokens = word_hashes((text or "").lower())
                if known is not None:
                    tokens = np.where(np.isin(tokens, known), tokens, _OTHER)
                held.append((i, ours, tokens))
                size += len(tokens)
                if size >= CHUNK or len(held) >= CHUNK_DOCS:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), filter_bit()).otherwise(F.lit(-1)).alias("at"))
    found = rows.mapInArrow(met, "doc_id long, text string").join(ids.withColumn("ours", F.lit(True)).hint("merge"), "doc_id", "left")
    told = found.select("doc_id", "text", F.coalesce("ours", F.lit(False)).alias("ours"), F.lit(-1).cast("long").alias("at"))
    others = rows.select("doc_id", "text", F.lit(False).alias("ours"), F.col("at").cast("long").alias("at"))
    return told.unionByName(others).mapInArrow(work, _CHUNKS_SQL)


class Chunk:
    """The distinct words and pairs of a chunk; ``keys`` are told apart by their last bit (words have it set)."""

    def __init__(self, words: bytes, tokens: bytes, lengths: list[int], n: int):
        self.words, self.lengths = np.frombuffer(words, np.uint64), np.array(lengths, np.int64)
        self.tokens = unpacked(tokens, n).astype(np.int32)
        ends = np.cumsum(self.lengths)
        full = self.lengths > 0
        self.last = ends[full] - 1
        width = len(self.words) + 1
        codes = np.zeros(n, np.int64)
        codes[1:] = self.tokens[:-1]
        codes[(ends - self.lengths)[full]] = len(self.words)
        codes *= width
        codes += self.tokens
        pairs, pair_of = np.unique(codes, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        self.before, self.after = (x.astype(np.int32) for x in np.divmod(pairs, width))
        hashes = np.concatenate((self.words, [_START]))
        pair = mix(hashes[self.before] * np.uint64(MULTIPLIER) + mix(hashes[self.after] * np.uint64(OTHER_MULTIPLIER)))
        one = np.uint64(1)
        keys = np.concatenate((mix(self.words) | one, pair & ~one))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, ours: list[bool]) -> np.ndarray:
        """Per key in order: times in all and in target documents; for words also as the last one of a text."""
        out = np.zeros((4, len(self.keys)), np.int32)
        our_doc = np.array(ours, bool)
        our = np.repeat(our_doc, self.lengths)
        our_last = our_doc[self.lengths > 0]
        n, m = len(self.words), len(self.before)
        for k, (some, some_last) in enumerate(((slice(None), slice(None)), (our, our_last))):
            out[k, :n] = np.bincount(self.tokens[some], minlength=n)
            out[k, n:] = np.bincount(self.pair_of[some], minlength=m)
            out[2 + k, :n] = np.bincount(self.tokens[self.last[some_last]], minlength=n)
        return out[:, self.order]

    def losses(self, counts: np.ndarray, sizes: tuple, entries: int, pull: float) -> list[np.ndarray]:
        """Each text's mean loss under the background and the target model, from the summed counts (words, then pairs)."""
        n = len(self.words)
        out = []
        for k, (size, texts) in enumerate(sizes):
            own, pairs = counts[k, :n], counts[k, n:]
            before = np.concatenate((own - counts[2 + k, :n], [texts]))[self.before]
            alone = (own + 1) / (size + entries)
            loss = -np.log((pairs + pull * alone[self.after]) / (before + pull))
            full = self.lengths > 0
            starts = (np.cumsum(self.lengths) - self.lengths)[full]
            sums = np.add.reduceat(loss[self.pair_of], starts) if len(starts) else np.zeros(0)
            mean = np.full(len(self.lengths), np.nan)
            mean[full] = sums / self.lengths[full]
            out.append(mean)
        return out


def asked(found: DataFrame, buckets: int) -> DataFrame:
    """What each chunk asks each bucket: its keys there, sorted, as differences, and what it holds of them."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def work(it):
        for batch in it:
            for chunk, words, tokens, lengths, ours, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not n:
                    continue
                own = Chunk(words, tokens, lengths, n)
                counts = own.counts(ours)
                at = ((own.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edges = np.flatnonzero(np.diff(at)) + 1
                rows = [(chunk, int(at[a]), b - a, packed(np.diff(own.keys[a:b], prepend=np.uint64(0))), packed(counts[:, a:b].ravel()))
                        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return found.select("chunk", "words", "tokens", "lengths", "ours", "n").mapInArrow(
        work, "chunk long, bucket int, n int, keys binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """Each question with the sums over all chunks, and on one row of each bucket how many words it has."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("counts", pa.binary()), ("n_words", pa.int64())])

    def work(table):
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(k, n), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), sizes)])
        distinct, place = np.unique(keys, return_inverse=True)
        ends, summed = np.cumsum(sizes).tolist(), np.zeros((4, len(distinct)), np.int64)
        for c, n, e in zip(table.column("counts").to_pylist(), sizes, ends):
            summed[:, place[e - n: e]] += unpacked(c, 4 * n).reshape(4, n).view(np.int64)  # a chunk asks for a key once
        out = [packed(summed[:, place[e - n: e]].ravel()) for n, e in zip(sizes, ends)]
        n_words = [int((distinct & np.uint64(1)).sum()), *[0] * (len(sizes) - 1)]
        return pa.table([table.column("chunk"), table.column("bucket"), table.column("n"), pa.array(out, pa.binary()),
                         pa.array(n_words, pa.int64())], schema=schema)

    return questions.groupBy("bucket").applyInArrow(work, "chunk long, bucket int, n int, counts binary, n_words long")


def score(docs: DataFrame, target: DataFrame, size: int = VOCABULARY, pull: float = PULL) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for each row of ``docs`` (doc_id, text);
    ``target`` holds the doc_id of the target documents.

    Losses are means per token. Texts without words (null, empty) have none: nulls. Without target documents the
    target model knows the vocabulary only. Repeated rows count and are scored each; repeated or null target ids add
    nothing; extra columns are ignored; no rows give no rows. A ``size`` given travels as a table to the driver."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = vocabulary(rows, size) if size < VOCABULARY else None
    found = materialise(chunks(rows, target, words), "chunks")
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    answers = materialise(answered(asked(found, max(BUCKETS, n_bytes // BUCKET_BYTES))), "answers")
    total = found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_docs", "our_n", "our_docs")]).first()
    sizes = tuple(total[:2]), tuple(total[2:])
    entries = 1 + (len(words) if words is not None else answers.agg(F.sum("n_words")).first()[0] or 0)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()),
                        ("background_loss", pa.float64())])

    def work(left, right):
        chunk = {c: left.column(c)[0].as_py() for c in left.column_names}
        own = Chunk(chunk["words"], chunk["tokens"], chunk["lengths"], chunk["n"])
        counts = np.zeros((4, len(own.keys)), np.int64)
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "counts"))))
        end = 0
        for _, n, summed in parts:
            counts[:, own.order[end: end + n]] = unpacked(summed, 4 * n).reshape(4, n)
            end += n
        background, ours = (pa.array(x, pa.float64(), from_pandas=True) for x in own.losses(counts, sizes, entries, pull))
        return pa.table([pa.array(chunk["doc_ids"], pa.int64()), pa.array(chunk["lengths"], pa.int64()), ours, background], schema=schema)

    kept = found.select("chunk", "words", "tokens", "doc_ids", "lengths", "n").groupBy("chunk")
    out = kept.cogroup(answers.select("chunk", "bucket", "n", "counts").groupBy("chunk")).applyInArrow(
        work, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))

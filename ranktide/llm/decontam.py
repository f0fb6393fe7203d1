"""Benchmark decontamination by containment search over MinHash signatures.

Items are partitioned by size: a partition holds items of more than ``block / 2`` and at most ``block`` shingles. A
document is looked at in segments of two neighbouring blocks, so an item that occurs in it lies whole in one segment
and its Jaccard similarity with that segment is about a fifth or more at 0.8 containment, however long the document, if
over half a block of its shingles are distinct. Items of fewer (those of up to eight words, and repetitive ones) become
candidates by exact lookup of their shingles instead. Each
segment's signature (the minimum of its blocks' minima; larger blocks are made of smaller ones) is compared with the
items' value by value; an equal value makes a candidate, and exact containment of the item's shingles in the document
decides. Documents stay where they are: there is no shuffle. The items travel to the tasks in blocks of at most
``block_bytes`` of text, measured before; more items take more passes."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import bounded_batches, set_aside
from ranktide.llm.words import LETTERS, mix, windows, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 48
BLOCK_BYTES = 8 << 20
_BATCH = 1 << 18
OUT = "doc_id long, item_id long, containment double, n_shingles int"


def item_shingles(text: str | None) -> np.ndarray:
    return windows(word_hashes((text or "").lower(), LETTERS), SHINGLE)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * n + 1, dtype=np.uint64)
    return mix(seeds[:n]) | np.uint64(1), mix(seeds[n:])


class Index:
    """Items by size partition, with the sorted signature values of each hash function."""

    def __init__(self, items: list[tuple[int | None, str | None]], hashes: int = HASHES):
        self.a, self.b = _functions(hashes)
        self.items, self.partitions, few = [], {}, []
        for item, text in items:
            all_ = item_shingles(text)
            if len(all_):
                block = 1 << max(3, math.ceil(math.log2(len(all_))))
                own = np.unique(all_)
                if 2 * len(own) > block:
                    self.partitions.setdefault(block, []).append(len(self.items))
                else:
                    few.append((own, len(self.items)))
                self.items.append((item, own))
        shingle = np.concatenate([own for own, _ in few]) if few else np.zeros(0, np.uint64)
        order = np.argsort(shingle, kind="stable")
        self.looked_up = shingle[order], np.repeat([i for _, i in few], [len(own) for own, _ in few]).astype(np.int64)[order]
        self.values = {}
        for block, members in self.partitions.items():
            own = np.array([self.signature(self.items[i][1]) for i in members])  # items x hashes
            order = np.argsort(own, axis=0, kind="stable")
            seen = np.zeros((hashes, 1 << 16), bool)  # leading bits of the values, to look up few
            for h in range(hashes):
                seen[h, own[:, h] >> 16] = True
            self.values[block] = np.take_along_axis(own, order, axis=0), np.array(members)[order], seen

    @classmethod
    def of(cls, state: dict) -> Index:
        """An index from its ``vars``, which travel as plain data."""
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def signature(self, shingle: np.ndarray) -> np.ndarray:
        return np.array([((shingle * a + b) >> np.uint64(32)).min() for a, b in zip(self.a, self.b)], np.uint32)

    def candidates(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) pairs of which a segment and the item agree in a value, or that share a shingle that is looked up."""
        out: set[tuple[int, int]] = set()
        shingle, owners = self.looked_up
        for t, text in enumerate(texts if len(shingle) else ()):
            own = np.unique(text)
            low, high = np.searchsorted(shingle, own, "left"), np.searchsorted(shingle, own, "right")
            for lo, hi in zip(low[high > low].tolist(), high[high > low].tolist()):
                out.update((t, i) for i in owners[lo:hi].tolist())
        if not self.partitions or not texts:
            return out
        base = min(self.partitions)
        counts = np.array([-(-len(t) // base) for t in texts])
        first = np.concatenate(([0], np.cumsum(counts)))  # first base block of each text
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        starts = np.concatenate([np.arange(o, o + len(t), base) for o, t in zip(offsets, texts)])
        joined = np.concatenate(texts)
        minima = np.array([np.minimum.reduceat(((joined * a + b) >> np.uint64(32)).astype(np.uint32), starts)
                           for a, b in zip(self.a, self.b)])
        for block, (values, members, seen) in self.values.items():
            q = block // base
            at = np.concatenate([np.arange(f, f + n, q) for f, n in zip(first, counts)])
            owner = np.repeat(np.arange(len(texts)), -(-counts // q))
            blocks = np.minimum.reduceat(minima, at, axis=1)
            last = np.concatenate((owner[1:] != owner[:-1], [True]))  # a text's last block is a segment alone
            following = np.where(last, blocks, np.roll(blocks, -1, axis=1))
            segments = np.minimum(blocks, following)
            for h in range(len(self.a)):
                own, row = values[:, h], segments[h]
                hit = np.flatnonzero(seen[h, row >> 16])
                low, high = np.searchsorted(own, row[hit], "left"), np.searchsorted(own, row[hit], "right")
                for s, lo, hi in zip(hit[high > low], low[high > low], high[high > low]):
                    out.update((int(owner[s]), int(m)) for m in members[lo:hi, h])
        return out


def _blocks(items: DataFrame, block_bytes: int) -> list[list[tuple]]:
    """The items in lists of about ``block_bytes``; one list is on the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, containment, n_shingles): each item of which the whole text of a document contains at least
    ``threshold`` of the distinct five-word shingles.

    Words are lower-cased runs of letters and digits. Items under five words and null or empty texts match nothing.
    Rows that share a doc_id or an item_id are compared each, and equal result rows stay; extra columns are ignored;
    no documents or no items give no rows."""
    return _hits(docs, items, threshold, block_bytes, F.lit(None)).drop("text_key")


def _hits(docs: DataFrame, items: DataFrame, threshold: float, block_bytes: int, key: Column) -> DataFrame:
    """The rows of :func:`find` and ``key`` (text_key) of the document's row."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.cast("string").alias("text_key"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64()),
                        ("n_shingles", pa.int32()), ("text_key", pa.string())])
    parts = []
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL"),
                         block_bytes):
        index = spark.sparkContext.broadcast(vars(Index(block)))

        def work(it, index=index):
            def matches(ids, texts):
                found = Index.of(index.value)
                for t, i in sorted(found.candidates(texts)):
                    item, own = found.items[i]
                    share = np.isin(own, texts[t]).mean()
                    if share >= threshold:
                        yield ids[t][0], item, float(share), len(own), ids[t][1]

            for batch in it:
                ids, texts, size, out = [], [], 0, []
                for doc, text, row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "text_key"))):
                    own = item_shingles(text)
                    if len(own):
                        ids.append((doc, row))
                        texts.append(own)
                        size += len(own)
                    if size >= _BATCH:
                        out += matches(ids, texts)
                        ids, texts, size = [], [], 0
                out += matches(ids, texts)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        parts.append(rows.mapInArrow(work, f"{OUT}, text_key string"))
    return functools.reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item; all columns stay. A row is told by its doc_id and its text, so others of the
    same doc_id, or of none, stay. Extra columns may have any names."""
    docs, named = set_aside(docs, {"_hit", "text_key"})
    key = F.sha2("text", 256)
    hit = _hits(docs, items, threshold, BLOCK_BYTES, key).select(F.col("doc_id").alias("_hit"), "text_key").distinct()
    return named(docs.join(hit, docs.doc_id.eqNullSafe(F.col("_hit")) & (key == F.col("text_key")), "left_anti"))

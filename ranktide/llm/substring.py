"""Substring de-duplication: every 50-word window that also starts in a document with a smaller id goes.

Pass 1 sketches. A window's count is overestimated by that of its fingerprint, the smallest of the 10-word hashes in
it: equal windows have equal fingerprints. Each document adds its distinct fingerprints to a count-min sketch of its
partition; the partitions' cells are summed, and one bit per cell tells whether it was reached twice. Pass 2 emits the
windows whose fingerprint is estimated repeated in every sketch row, and only these are grouped exactly, by 96 bits of
hash: estimates are never too low, so no repeated window is lost. The sketch has a fixed size (``2 * 2**cell_bits``
bits travel to the tasks); more text makes its estimates looser and pass 2 larger, the result is the same.

A hot window (one passage in a third of all documents) is reduced by a partial minimum before the shuffle, and the
join that carries the minimum back is one that Spark splits where it is skewed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import bit_filter, bounded_batches, filter_bit, in_filter, materialise, set_aside
from ranktide.llm.words import OTHER_MULTIPLIER, mix, windows, word_hashes

WIDTH = 50
GRAM = 10
CELL_BITS = 26
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ROWS = 2
_FLUSH = 1 << 20


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from minima that run forwards and backwards inside blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1: n])


def fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    gram = min(GRAM, width)
    return sliding_min(windows(hashes, gram), width - gram + 1)


def cells(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """The sketch cell of each fingerprint in each row; rows follow one another."""
    return [(mix(prints + np.uint64(r)) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(_ROWS)]


def _repeated_cells(rows: DataFrame, width: int, bits: int) -> np.ndarray:
    """A bit for each sketch cell: whether two documents reach it. Never more than ``2 * 2**bits / 64`` words."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int32())])

    def sketch(it):
        def partial(held):
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(n, pa.int32())], schema=schema)

        held, size = [], 0
        for batch in it:
            for text in batch.column("text").to_pylist():
                prints = fingerprints(word_hashes(text), width)
                if len(prints):
                    held += cells(np.unique(prints), bits)
                    size += 2 * len(held[-1])
                if size >= _FLUSH:
                    yield partial(held)
                    held, size = [], 0
        if held:
            yield partial(held)

    merged = rows.select("text").mapInArrow(sketch, "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    twice = merged.where("n > 1").select((F.col("cell") / 64).cast("int").alias("word"), (F.col("cell") % 64).alias("bit"))
    words = twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros((_ROWS << bits) // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def estimated_repeated(prints: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(prints), bool)
    for cell in cells(prints, bits):
        out &= (sketch[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def _candidates(rows: DataFrame, sketch, width: int, bits: int) -> DataFrame:
    """(h, g, doc_id, at) of each window that the sketch takes for repeated; ``at`` holds the text's tag and the
    window's place."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def work(it):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], schema=schema)

        table = sketch.value
        for batch in it:
            for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text"))):
                hashes = word_hashes(text)
                prints = fingerprints(hashes, width)
                places = np.flatnonzero(estimated_repeated(prints, table, bits))
                if len(places):
                    held.append((
                        windows(hashes, width)[places].view(np.int64),
                        (windows(hashes, width, OTHER_MULTIPLIER)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                        np.full(len(places), doc, np.int64), places | (tag << 32)))
                    size += len(places)
                if size >= _FLUSH // 4:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.where("doc_id IS NOT NULL").mapInArrow(work, "h long, g int, doc_id long, at long")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), width: int = WIDTH, cell_bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, text, *keep) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``width`` words of its document covers it
    whose word sequence also starts in a document with a smaller doc_id; windows are judged on the input. ``text`` is
    the kept words joined by one space. Null texts have no words; a null doc_id is neither smaller than another nor
    has a smaller one; rows that share a doc_id never remove from each other. Columns not named in ``keep`` are
    ignored, and ``keep`` may not name one of the result's own (ValueError). Texts under ``width`` words stay whole; no
    rows give no rows."""
    if taken := {c.lower() for c in keep} & {"doc_id", "text", "n_words", "n_removed"}:
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    bounded_batches(docs.sparkSession)
    docs, named = set_aside(docs.select(F.col("doc_id").cast("long"), "text", *keep), {"tag", "_at", "_places"})
    keep = tuple(docs.columns[2:])
    tagged = docs.withColumn(
        "tag", F.expr("xxhash64(text) & 2147483647L"))
    narrow = tagged.select("doc_id", "tag", "text")
    sketch = docs.sparkSession.sparkContext.broadcast(_repeated_cells(narrow, width, cell_bits))
    found = _candidates(narrow, sketch, width, cell_bits)
    firsts = (found.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
              .where("first < last").select("h", "g", "first"))
    repeated = found.join(firsts, ["h", "g"]).where("doc_id > first")
    # a text has at most as many places as words
    marks = materialise(repeated.groupBy("doc_id", F.shiftright("at", 32).alias("tag")).agg(
        F.collect_set(F.expr("cast(at & 4294967295L as int)")).alias("_places")), "places")
    # texts that lose nothing stay where they are
    marked = docs.sparkSession.sparkContext.broadcast(bit_filter(marks))
    at = tagged.withColumn("_at", filter_bit())

    def where_marked(batch, inside: bool):
        return batch.filter(pa.array(in_filter(marked.value, batch.column("_at").to_numpy(zero_copy_only=False)) == inside))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema)
    passed = at.mapInArrow(lambda it: (where_marked(b, True) for b in it), types)
    joined = passed.join(marks, ["doc_id", "tag"], "left").select("doc_id", "text", "_places", *keep)
    kept_types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def cut(batch, all_places):
        kept, n_words, n_removed = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), all_places):
            words = WORD.findall(text or "")
            gone = 0
            if places:
                edge = np.zeros(len(words) + 1, np.int64)
                edge[places] += 1
                edge[np.array(places) + width] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                gone = len(words) - int(stays.sum())
                words = [w for w, s in zip(words, stays.tolist()) if s]
            kept.append(" ".join(words))
            n_words.append(len(words) + gone)
            n_removed.append(gone)
        own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "text", *keep]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *own, *(batch.column(c) for c in keep)], names=names)

    def cut_marked(it):
        return (cut(b, b.column("_places").to_pylist()) for b in it)

    def cut_others(it):
        return (cut(b, [None] * b.num_rows) for b in (where_marked(b, False) for b in it))

    result = f"doc_id long, n_words long, n_removed long, text string{kept_types}"
    return named(joined.mapInArrow(cut_marked, result).unionByName(at.mapInArrow(cut_others, result)))

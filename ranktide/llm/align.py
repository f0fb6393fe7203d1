"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Both token sequences of a text cover the same bytes. Where both end is a group's end; every stretch between two
neighbouring token ends lies in one A token and one B token, which is one link. A link's pair is one 31-bit number, A id
before B id.

Tasks encode texts and collect records (pair, document, how often). A run of about ``RUN_LINKS`` links is sorted and
radix-partitioned by A id: a radix's part of a run is one row, with its records in one zstd frame and, in another, the
heads: each pair and the number of the run's documents that hold it. All runs are written once to the shared folder.

Counting needs the heads alone. A k-way heap merge reads the runs of a radix, each decompressed as it is consumed, and
adds up what a pair has; while there are more than ``FAN`` runs, groups of that many are merged into longer ones first.
A pair of a third of all documents thus costs one entry a run. The last merge sees all pairs of an A id one after
another and marks the most frequent ones.

Contributions go back by radix: each share of runs meets the radix's counts, a run's records are read through and added
up per document, and the sums of all radices meet in their run."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ranktide.llm.common import bounded_batches, materialise
from ranktide.llm.words import mix

RUN_LINKS = 1 << 20
RUN_DOCS = 1 << 14
FAN = 64
B_BITS = 15
_DOC_BITS = 17
_READ = 1 << 16
_LONG_PIECE = 2048
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, the
    others in order from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Codecs:
    """Both tokenizers, from the content of their files, and their tokens' bytes."""

    def __init__(self, a_json: bytes, b_model: bytes, pattern: str):
        spec = json.loads(a_json)["model"]
        letters = byte_alphabet()
        table = {bytes(letters[c] for c in token): i for token, i in spec["vocab"].items()
                 if all(c in letters for c in token)}
        special = {t["content"].encode() for t in json.loads(a_json)["added_tokens"]}
        ranks = {t: i for t, i in table.items() if t not in special}
        # The merges' order is that of the ids they make, which is what the faster encoder takes as its order.
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long_run = re.compile(rf"\S{{{_LONG_PIECE}}}|\s{{{_LONG_PIECE}}}")
        self.slow = Tokenizer.from_str(a_json.decode())
        self.slow.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for t, i in table.items():
            self.a_bytes[i] = t
        n = self.b.get_piece_size()
        assert n <= 1 << B_BITS and len(self.a_bytes) <= 1 << 16
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n)]
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        #: how the groups' listing shows a token, and the last token of its group
        self.names = [f"{i}{end}" for t, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(t)) for end in (",", last)]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """The ids of both sides; none where the text is null or empty or either side's bytes are not those of the
        text after a space."""
        if not text:
            return None
        spaced = " " + text
        want = spaced.encode()
        # a pre-token of thousands of characters costs the faster encoder its square
        a = (self.slow.encode(spaced, add_special_tokens=False).ids if self.long_run.search(spaced)
             else self.a.encode_ordinary(spaced))
        if b"".join(map(self.a_bytes.__getitem__, a)) != want:
            return None
        b = self.b.encode(text)
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == want else None

    def aligned(self, a: list[int], b: list[int]) -> tuple[np.ndarray, int, str]:
        """A pair for each link, the number of groups, and their digest."""
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        first = np.concatenate(([True], ends[1:] != ends[:-1]))
        common, ends = ends[~first], ends[first]
        # each token's group, whether it is the group's last, and its place in the listing
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        before_a, before_b = (np.concatenate(([0], np.searchsorted(e, common) + 1)) for e in (ends_a, ends_b))
        listing = np.empty(len(a) + len(b), np.int64)
        listing[np.arange(len(a)) + before_b[group_a]] = ids_a * 2 + (common[group_a] == ends_a)
        listing[np.arange(len(b)) + before_a[group_b + 1]] = (ids_b + len(self.a_bytes)) * 2 + (common[group_b] == ends_b)
        listed = "".join(map(self.names.__getitem__, listing.tolist()))[:-1]
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return ids_a[at_a] << B_BITS | ids_b[at_b], len(common), hashlib.sha256(listed.encode()).hexdigest()


# --- runs: rising pairs as differences, zstd frames

_ENTRY, _ENTRY_BYTES = "<QQ", 16


def packed(pairs: np.ndarray, *others: np.ndarray) -> bytes:
    """A zstd frame of rows (difference to the pair before, others...), 64 bits each."""
    rows = np.column_stack([np.diff(pairs, prepend=0), *others]).astype(np.uint64)
    return zstandard.ZstdCompressor(level=3).compress(rows.tobytes())


def unpacked(blob: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(blob), np.uint64).reshape(-1, width).astype(np.int64)
    rows[:, 0] = np.cumsum(rows[:, 0])
    return rows


def entries(blob: bytes) -> Iterator[tuple[int, int]]:
    """(pair, n) of a run of heads, decompressed as they are taken."""
    held, pair = b"", 0
    with zstandard.ZstdDecompressor().stream_reader(blob) as reader:
        while part := reader.read(_READ):
            held += part
            whole = len(held) - len(held) % _ENTRY_BYTES
            rows = np.frombuffer(held[:whole], np.uint64).reshape(-1, 2).astype(np.int64)
            held = held[whole:]
            if len(rows):
                pairs = pair + np.cumsum(rows[:, 0])
                pair = int(pairs[-1])
                yield from zip(pairs.tolist(), rows[:, 1].tolist())


def merged(runs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, n) over all runs, by a heap of their next entries."""
    pair, total = None, 0
    for p, n in heapq.merge(*map(entries, runs)):
        if p != pair:
            if pair is not None:
                yield pair, total
            pair, total = p, 0
        total += n
    if pair is not None:
        yield pair, total


def marked(counted: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(pair, 2 * n + 1 if n is the most that the pair's A id has else 2 * n); the pairs of an A id follow each other."""
    side, held, most = None, [], 0
    for p, n in counted:
        if p >> B_BITS != side:
            yield from ((q, 2 * m + (m == most)) for q, m in held)
            side, held, most = p >> B_BITS, [], 0
        held.append((p, n))
        most = max(most, n)
    yield from ((q, 2 * m + (m == most)) for q, m in held)


def run_of(rows: Iterable[tuple[int, int]]) -> bytes:
    """A zstd frame of entries that come one by one."""
    packer, out, held, before = zstandard.ZstdCompressor(level=3).compressobj(), [], bytearray(), 0
    for p, n in rows:
        held += struct.pack(_ENTRY, p - before, n)
        before = p
        if len(held) >= _READ:
            out.append(packer.compress(bytes(held)))
            held.clear()
    out.append(packer.compress(bytes(held)) + packer.flush())
    return b"".join(out)


def spilled(pairs: np.ndarray, docs: np.ndarray, radices: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, heads, records) of a run's links."""
    radix = (mix((pairs >> B_BITS).astype(np.uint64)) % np.uint64(radices)).astype(np.int64)
    keys, times = np.unique(radix << (31 + _DOC_BITS) | pairs << _DOC_BITS | docs, return_counts=True)
    radix, pairs, docs = keys >> (31 + _DOC_BITS), keys >> _DOC_BITS & ((1 << 31) - 1), keys & ((1 << _DOC_BITS) - 1)
    bounds = [*np.flatnonzero(np.diff(radix, prepend=-1)).tolist(), len(keys)]
    for i, j in zip(bounds, bounds[1:]):
        heads, n = np.unique(pairs[i:j], return_counts=True)
        yield int(radix[i]), packed(heads, n), packed(pairs[i:j], docs[i:j], times[i:j])


def per_document(records: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, links whose pair is marked, sum of counts over links) of a run's records of one radix."""
    value = table[np.searchsorted(table[:, 0], records[:, 0]), 1]
    order = np.argsort(records[:, 1], kind="stable")
    docs, times, value = records[order, 1], records[order, 2], value[order]
    starts = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[starts], np.add.reduceat(times * (value & 1), starts), np.add.reduceat(times * (value >> 1), starts)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_FACTS = ("doc_id", *_NUMBERS, "groups_sha256")


def _encoded(rows: DataFrame, files, pattern: str, radices: int) -> DataFrame:
    """(run, radix, heads, records) and, with radix -1, a run's documents in arrays."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("heads", pa.binary()), ("records", pa.binary()),
                        *((c, longs) for c in _FACTS[:-1]), (_FACTS[-1], pa.list_(pa.string()))])

    def work(it):
        codecs = Codecs(*files.value, pattern)
        run = TaskContext.get().partitionId() << 32

        def flush(facts, links):
            out = [(run, -1, None, None, *map(list, zip(*facts)))]
            docs = np.repeat(np.arange(len(links)), list(map(len, links)))
            out += [(run, *part) + (None,) * len(_FACTS) for part in spilled(np.concatenate(links), docs, radices)]
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i: i + 64]), schema)], schema=schema)

        facts, links, size = [], [], 0
        for batch in it:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                both = codecs.tokens(text)
                if both is None:
                    facts.append((doc, 0, 0, 0, 0, ""))
                    links.append(np.zeros(0, np.int64))
                else:
                    pairs, groups, listed = codecs.aligned(*both)
                    facts.append((doc, len(both[0]), len(both[1]), groups, len(pairs), listed))
                    links.append(pairs)
                size += len(links[-1])
                if size >= RUN_LINKS or len(facts) >= RUN_DOCS:
                    yield from flush(facts, links)
                    facts, links, size, run = [], [], 0, run + 1
        if facts:
            yield from flush(facts, links)

    kinds = ", ".join(f"{c} array<long>" for c in _FACTS[:-1])
    return rows.mapInArrow(work, f"run long, radix int, heads binary, records binary, {kinds}, {_FACTS[-1]} array<string>")


def _counts(heads: DataFrame, runs: int, fan: int) -> DataFrame:
    """(radix, counts): the pairs of each radix with their counts and marks."""
    schema = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("heads", pa.binary())])

    def merge(table):
        first = [table.column(c)[0].as_py() for c in ("slot", "radix")]
        return pa.table([[c] for c in (*first, run_of(merged(table.column("heads").to_pylist())))], schema=schema)

    while runs > fan:
        runs = -(-runs // fan)
        slotted = heads.withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(runs)))
        heads = materialise(slotted.groupBy("slot", "radix").applyInArrow(merge, "run long, radix int, heads binary"), "merged")

    last = pa.schema([("radix", pa.int32()), ("counts", pa.binary())])

    def finish(table):
        counted = run_of(marked(merged(table.column("heads").to_pylist())))
        return pa.table([[table.column("radix")[0].as_py()], [counted]], schema=last)

    return heads.select("radix", "heads").groupBy("radix").applyInArrow(finish, "radix int, counts binary")


def _contributions(records: DataFrame, counts: DataFrame, shares: int) -> DataFrame:
    """(run, sums): what each radix adds to a run's documents."""
    schema = pa.schema([("run", pa.int64()), ("sums", pa.binary())])

    def work(left, right):
        table, out = unpacked(right.column("counts")[0].as_py(), 2), []
        for run, blob in zip(left.column("run").to_pylist(), left.column("records")):
            out.append((run, packed(*per_document(unpacked(blob.as_py(), 3), table))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [[], []], schema=schema)

    one = records.withColumn("share", F.pmod(F.xxhash64("run"), F.lit(shares))).groupBy("radix", "share")
    other = counts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return one.cogroup(other.groupBy("radix", "share")).applyInArrow(work, "run long, sums binary")


def align(docs: DataFrame, a_json: bytes, b_model: bytes, pattern: str = public_tokenizers.PATTERN, fan: int = FAN,
          radices: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs`` (doc_id, text).

    ``a_json`` is the content of a byte-level BPE's file, ``b_model`` that of a piece model that adds a space in front;
    both under 2 MB, they travel as a broadcast. Special tokens' strings inside texts are plain text. A pair's count is
    the number of rows that hold it linked; repeated rows and ids count each. Null and empty texts, and texts that
    either tokenizer does not give back unchanged after a space, have zeros and an empty digest and add to no count.
    Extra columns are ignored, no rows give no rows. ``radices`` (default: 16, more from 64 million rows on) and
    ``fan`` change the work's cut, not the result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if radices is None:
        radices = 16
        n = rows.count()
        while radices < n >> 22:
            radices *= 2
    files = spark.sparkContext.broadcast((a_json, b_model))
    spill = materialise(_encoded(rows, files, pattern, radices), "runs")
    facts, parts = spill.where("radix < 0"), spill.where("radix >= 0")
    runs = facts.count()
    counts = materialise(_counts(parts.select("run", "radix", "heads"), runs, fan), "counts")
    sums = _contributions(parts.select("run", "radix", "records"), counts, -(-runs // fan) or 1)

    numbers = ("doc_id", *_NUMBERS, "n_best", "count_sum")
    schema = pa.schema([*((c, pa.int64()) for c in numbers), ("groups_sha256", pa.string())])

    def added(left, right):
        own = left.to_pylist()[0]
        best, total = np.zeros(len(own["doc_id"]), np.int64), np.zeros(len(own["doc_id"]), np.int64)
        for blob in right.column("sums"):
            rows_ = unpacked(blob.as_py(), 3)
            best[rows_[:, 0]] += rows_[:, 1]
            total[rows_[:, 0]] += rows_[:, 2]
        got = own | {"n_best": best, "count_sum": total}
        return pa.table([pa.array(got[f.name], f.type) for f in schema], schema=schema)

    return facts.select("run", *_FACTS).groupBy("run").cogroup(sums.groupBy("run")).applyInArrow(
        added, ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string")

"""Byte-level BPE over whole texts, long ones in overlapping chunks.

Texts of at most ``chunk_chars`` are one chunk. A longer text is cut into chunks that become rows of their own, spread
over all tasks: chunk k starts at ``k * chunk_chars`` whatever is there and runs into the next one, up to the first
place where white space follows other characters (no pre-token spans such a place, so both chunks have a boundary
there at the latest). Each chunk is pre-tokenised and its pieces are encoded independently. Stitching keeps a chunk's
pieces from the place where it has resynchronised with the chunk before (the first boundary that both have in the
overlap) up to the place where the next one has. What depends on a wrong start or a cut end lies outside. Decoding
concatenates the raw bytes of the ids."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import batches, bounded_batches, each_row, pack

CHUNK_CHARS = 16_384
BREAK = regex.compile(r"(?<=\S)\s")


class Codec:
    """The vocabulary: encodes and decodes in a task, built once for each."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = {i: str(i) for i in table.values()}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def joined(self, ids: list[int]) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids)).encode()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens; the pattern covers every character."""
        return self.pattern.findall(text)


def cut(text: str, size: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping chunks. A chunk that runs into the text's end is the last."""
    out, start = [], 0
    while True:
        m = BREAK.search(text, start + size) if start + size < len(text) else None
        end = m.end() if m else len(text)
        out.append((start, end))
        if not m:
            return out
        start += size


def encode_chunk(codec: Codec, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pieces, how many ids each has, and the ids."""
    pieces = codec.pieces(text)
    known: dict[str, list[int]] = {}
    ids, counts = [], np.empty(len(pieces), np.int32)
    for i, p in enumerate(pieces):
        got = known.get(p)
        if got is None:
            got = known[p] = codec.encode(p)
        ids.extend(got)
        counts[i] = len(got)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1])) if pieces else np.zeros(0)
    return starts.astype(np.int64), counts, np.array(ids, np.int32)


def stitch(chunks):
    """The ids of a text from its chunks in order, as (start, end, piece starts, counts, ids), start and end in
    characters of the text and piece starts from the chunk's start. Holds two chunks at a time."""
    before, since = None, 0
    for chunk in chunks:
        if before is not None:
            start = chunk[0]
            ours, theirs = chunk[2] + start, before[2] + before[0]
            common = np.intersect1d(ours, theirs[theirs >= start])
            at = int(common[0])  # there is one: see cut()
            yield _kept(before, since, at)
            since = at
        before = chunk
    if before is not None:
        yield _kept(before, since, None)


def _kept(chunk, since: int, until: int | None) -> list[int]:
    start, _, starts, counts, ids = chunk
    offsets = np.concatenate(([0], np.cumsum(counts)))
    a = np.searchsorted(starts + start, since)
    b = len(starts) if until is None else np.searchsorted(starts + start, until)
    return ids[offsets[a]: offsets[b]].tolist()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
          ("decoded_sha256", pa.string())]


def _by_ids(rows, schema: pa.Schema, most: int = 1 << 18):
    """Arrow batches of at most 500 results, closed once their texts have ``most`` ids."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += row[1]
        if len(part) >= 500 or held >= most:
            yield pack(part, schema)
            part, held = [], 0
    if part:
        yield pack(part, schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs``.

    ``ranks`` is the content of a tiktoken rank file (under 1 MB; it travels with the job). The ids are those of
    ``encode_ordinary`` over the whole text; ``decoded_sha256`` is of the bytes that decoding them gives. Null texts
    count as empty (no ids), repeated rows are encoded each, extra columns are ignored, no rows give no rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spec = SCHEMA + (", ids array<int>" if with_ids else "")
    arrow = pa.schema(_ARROW + [("ids", pa.list_(pa.int32()))] * with_ids)

    def whole(it):
        codec = Codec(ranks, pattern)

        def one(doc, text):
            ids = codec.encode(text)
            out = (doc, len(ids), hashlib.sha256(codec.joined(ids)).hexdigest(),
                   hashlib.sha256(codec.decode(ids)).hexdigest())
            return out + (np.array(ids, np.int32),) if with_ids else out

        yield from _by_ids((one(*r) for r in each_row(it)), arrow)

    chunk_arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("chunk", pa.int32()),
                             ("start", pa.int64()), ("text", pa.string())])

    def chunks(it):
        task = TaskContext.get().partitionId()

        def parts():
            for n, (doc, text) in enumerate(each_row(it)):
                for k, (a, b) in enumerate(cut(text, chunk_chars)):
                    yield doc, f"{task}/{n}", k, a, text[a:b]

        yield from batches(parts(), chunk_arrow, 64)

    coded_arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("chunk", pa.int32()),
                             ("start", pa.int64()), ("end", pa.int64()), ("starts", pa.binary()),
                             ("counts", pa.binary()), ("ids", pa.binary())])

    def coded(it):
        codec = Codec(ranks, pattern)

        def one(doc, row, chunk, start, text):
            starts, counts, ids = encode_chunk(codec, text)
            return doc, row, chunk, start, start + len(text), starts.tobytes(), counts.tobytes(), ids.tobytes()

        yield from batches((one(*r) for r in each_row(it)), coded_arrow, 64)

    def joined(it):
        codec = Codec(ranks, pattern)

        def texts():
            key, group = None, []  # of one text at most two chunks at a time
            rows_ = each_row(it)
            row = next(rows_, None)
            while row is not None:
                key, doc = row[1], row[0]

                def own():
                    nonlocal row
                    while row is not None and row[1] == key:
                        _, _, _, start, end, starts, counts, ids = row
                        yield (start, end, np.frombuffer(starts, np.int64), np.frombuffer(counts, np.int32),
                               np.frombuffer(ids, np.int32))
                        row = next(rows_, None)

                n, listed, decoded, everything = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in stitch(own()):
                    if ids:
                        listed.update((b"," if n else b"") + codec.joined(ids))
                        decoded.update(codec.decode(ids))
                        n += len(ids)
                        if with_ids:
                            everything.append(np.array(ids, np.int32))
                out = (doc, n, listed.hexdigest(), decoded.hexdigest())
                yield out + (np.concatenate([np.zeros(0, np.int32), *everything]),) if with_ids else out

        yield from _by_ids(texts(), arrow)

    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, spec)
    long = (
        rows.where(F.length("text") > chunk_chars)
        .mapInArrow(chunks, "doc_id long, row string, chunk int, start long, text string")
        .repartition("row", "chunk")
        .mapInArrow(coded, "doc_id long, row string, chunk int, start long, end long, starts binary, counts binary, "
                           "ids binary")
        .repartition("row").sortWithinPartitions("row", "chunk")
        .mapInArrow(joined, spec)
    )
    return short.unionByName(long)


def rank_file(path: str) -> bytes:
    """The rank file, read on the driver from the place its caller names."""
    with open(path, "rb") as f:
        return f.read()

"""Language identification by unigrams over the pieces of a fixed public vocabulary, all segmentations summed.

A text's units are its runs of letters (lower-cased; ASCII letters, apostrophes and every byte of other characters),
with a space in front, runs of over ``UNIT`` bytes cut into several units. A language gives each piece of the vocabulary
a probability; a unit's is the sum over all ways to cut it into pieces, by the forward algorithm, and a text's the
product over its units. Every single byte is a piece, so every unit has a probability.

Training: (language, unit) counts of all labelled texts are a table; expected piece counts of each language come from
forward and backward sums over the distinct units (expectation maximisation, ``ITERATIONS`` rounds from equal
probabilities on), pulled towards the counts of all languages. A model is one number for each piece and language; it
travels in blocks of ``BLOCK`` languages, 13 MB each.

Units are computed as arrays: units of like length side by side, and for each end the pieces that end there, of all
units at once."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranktide.llm.common import bounded_batches, materialise, pack
from ranktide.llm.words import mix, runs, word_spans

UNIT = 24
ITERATIONS = 2
PULL = 500.0
LEAST = 1e-10  # of a piece's probability: a unit's stays within a double
BLOCK = 64
FOLDS, HELD_OUT = 4, 2
NO_LANGUAGE = "und"
_CELLS = 1 << 18
_SLICE = 1 << 20
_HELD = 1 << 18
_FILTER = 1 << 20
_CACHE_BYTES = 1 << 26

#: bytes of a unit: ASCII letters, the apostrophe, and all bytes of other characters
LETTERS = np.array([b >= 0x80 or chr(b).isalpha() or b == 0x27 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15


def vocabulary(ranks: bytes) -> list[bytes]:
    """The pieces of a rank file by rank; it holds all single bytes."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return [t for t, _ in sorted(table.items(), key=lambda x: x[1])]


class Lattice:
    """Which pieces are where in units."""

    def __init__(self, pieces: list[bytes]):
        own = [i for i, p in enumerate(pieces) if len(p) <= UNIT + 1]
        names = self._hashes([pieces[i] for i in own])
        order = np.argsort(names)
        self.names, self.ids = names[order], np.array(own)[order]
        self.maybe = np.zeros(_FILTER, bool)  # most strings are no piece: told without a search
        self.maybe[self.names % np.uint64(_FILTER)] = True
        self.longest = max(len(pieces[i]) for i in own)

    @staticmethod
    def padded(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(list(map(len, units)), np.int64)
        width = int(lengths.max())
        return np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(-1, width), lengths

    @staticmethod
    def _sums(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.multiply.accumulate(np.array([1] + [_BASE] * rows.shape[1], np.uint64))
        sums = np.zeros((rows.shape[1] + 1, len(rows)), np.uint64)
        np.cumsum(((rows.astype(np.uint64) + np.uint64(1)) * power[:-1]).T, axis=0, out=sums[1:])
        inverse = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * rows.shape[1], np.uint64))
        return sums, inverse

    def _hashes(self, pieces: list[bytes]) -> np.ndarray:
        rows, lengths = self.padded(pieces)
        sums, _ = self._sums(rows)
        return mix(sums[lengths, np.arange(len(rows))] + lengths.astype(np.uint64))

    def edges(self, rows: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each end 1, 2, ...: (units, starts, pieces), by unit; every unit as long as that has one."""
        sums, inverse = self._sums(rows)
        out = []
        for end in range(1, rows.shape[1] + 1):
            alive = np.flatnonzero(lengths >= end)
            units, starts, ids = [], [], []
            for start in range(max(0, end - self.longest), end):
                h = mix((sums[end, alive] - sums[start, alive]) * inverse[start] + np.uint64(end - start))
                near = np.flatnonzero(self.maybe[h % np.uint64(_FILTER)])
                at = np.minimum(np.searchsorted(self.names, h[near]), len(self.names) - 1)
                hit = self.names[at] == h[near]
                units.append(alive[near[hit]])
                starts.append(np.full(int(hit.sum()), start))
                ids.append(self.ids[at[hit]])
            units, starts, ids = map(np.concatenate, (units, starts, ids))
            order = np.argsort(units, kind="stable")
            out.append((units[order], starts[order], ids[order]))
        return out


def forward(edges, lengths: np.ndarray, weights) -> np.ndarray:
    """sums[end, unit, ...] over all segmentations of the unit's first ``end`` bytes; ``weights(units, pieces)`` are
    the pieces' probabilities."""
    sums = None
    for end, (units, starts, ids) in enumerate(edges, 1):
        w = weights(units, ids)
        if sums is None:
            sums = np.zeros((len(edges) + 1, len(lengths), *w.shape[1:]))
            sums[0] = 1.0
        if len(units):
            first = np.flatnonzero(np.diff(units, prepend=-1))
            sums[end, units[first]] = np.add.reduceat(sums[starts, units] * w, first, axis=0)
    return sums


def backward(edges, lengths: np.ndarray, weights) -> np.ndarray:
    """sums[start, unit] over all segmentations of what follows the unit's first ``start`` bytes."""
    sums = np.zeros((len(edges) + 1, len(lengths)))
    sums[lengths, np.arange(len(lengths))] = 1.0
    for end in range(len(edges), 0, -1):
        units, starts, ids = edges[end - 1]
        np.add.at(sums, (starts, units), sums[end, units] * weights(units, ids))
    return sums


def by_length(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Indexes of units, short ones first, in parts of bounded size."""
    order = np.argsort(lengths, kind="stable")
    while len(order):
        n = 1
        while n < len(order) and (n + 1) * int(lengths[order[min(2 * n, len(order)) - 1]]) <= cells:
            n = min(2 * n, len(order))
        yield order[:n]
        order = order[n:]


def expected(lattice: Lattice, units: list[bytes], of: np.ndarray, counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of units that belong to language ``of`` and occur ``counts`` times."""
    out = np.zeros(model.shape)
    lengths = np.array(list(map(len, units)), np.int64)
    for part in by_length(lengths, _CELLS):
        rows, n = lattice.padded([units[i] for i in part])
        edges, language, times = lattice.edges(rows, n), of[part], counts[part]

        def weights(u, ids):
            return model[ids, language[u]]

        ahead, behind = forward(edges, n, weights), backward(edges, n, weights)
        total = times / ahead[n, np.arange(len(n))]
        for end, (u, starts, ids) in enumerate(edges, 1):
            np.add.at(out, (ids, language[u]), ahead[starts, u] * weights(u, ids) * behind[end, u] * total[u])
    return out


def log_sums(lattice: Lattice, units: list[bytes], model: np.ndarray) -> np.ndarray:
    """log probability [unit, language]."""
    out = np.zeros((len(units), model.shape[1]))
    lengths = np.array(list(map(len, units)), np.int64)
    for part in by_length(lengths, max(_CELLS // model.shape[1], 1 << 12)):
        rows, n = lattice.padded([units[i] for i in part])
        sums = forward(lattice.edges(rows, n), n, lambda u, ids: model[ids])
        out[part] = np.log(sums[n, np.arange(len(n))])
    return out


def _parts(text: str) -> Iterator[str]:
    """A long text in slices that end at white space."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def units_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units of some texts, for each occurrence its unit and its text, and the units' hashes (rising)."""
    data = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = word_spans(data, LETTERS)
    text = np.searchsorted(np.cumsum([len(t.lower().encode("utf-8", "surrogatepass")) + 1 for t in texts]), starts, side="right")
    several = -(-(ends - starts) // UNIT)
    nth = np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
    starts, ends, text = (np.repeat(x, several) for x in (starts, ends, text))
    starts = starts + nth * UNIT
    ends = np.minimum(ends, starts + UNIT)
    names = runs(data, starts, ends) ^ mix((nth > 0).astype(np.uint64))
    names, first, at = np.unique(names, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [(b"" if nth[i] else b" ") + raw[starts[i]: ends[i]] for i in first], at, text, names


def _each(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[int]]]:
    """Texts of a batch in bounded lots, each with the row it is of."""
    texts, rows, size = [], [], 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        for part in _parts(t or ""):
            texts.append(part)
            rows.append(i)
            size += len(part)
            if size >= _SLICE:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def unit_counts(docs: DataFrame) -> DataFrame:
    """(lang, unit, n) over all texts; counts are merged in each task first."""
    schema = pa.schema([("lang", pa.string()), ("unit", pa.binary()), ("n", pa.int64())])

    def work(it):
        held = Counter()

        def flush():
            items = list(held.items())
            for i in range(0, len(items), 10_000):
                yield pack([(lang, unit, n) for (lang, unit), n in items[i: i + 10_000]], schema)
            held.clear()

        for batch in it:
            lang = batch.column("lang").to_pylist()
            for texts, rows in _each(batch):
                units, at, text, _ = units_of(texts)
                names = sorted({lang[r] for r in rows})
                place = {x: i for i, x in enumerate(names)}
                of = np.array([place[lang[r]] for r in rows], np.int64)[text]
                both, n = np.unique(of * len(units) + at, return_counts=True)
                for k, m in zip(both.tolist(), n.tolist()):
                    held[names[k // len(units)], units[k % len(units)]] += m
                if len(held) >= _HELD:
                    yield from flush()
        yield from flush()

    return (docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
            .mapInArrow(work, "lang string, unit binary, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n")))


class Model:
    """Languages, and their pieces' probabilities as broadcast blocks [piece, language]."""

    def __init__(self, spark, pieces: list[bytes], languages: list[str], blocks: list[np.ndarray]):
        self.pieces, self.languages = pieces, languages
        self.blocks = [spark.sparkContext.broadcast(b.astype(np.float32)) for b in blocks]


def _count(units: DataFrame, model: Model) -> DataFrame:
    """(lang, piece, n): expected counts under the model."""
    place = {x: i for i, x in enumerate(model.languages)}
    pieces, blocks = model.pieces, model.blocks
    schema = pa.schema([("lang", pa.string()), ("pieces", pa.list_(pa.int32())), ("n", pa.list_(pa.float64()))])
    names = model.languages

    def work(it):
        lattice, total = Lattice(pieces), {}
        for batch in it:
            of = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            unit, n = batch.column("unit").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for b in np.unique(of // BLOCK).tolist():
                own = np.flatnonzero(of // BLOCK == b)
                got = expected(lattice, [unit[i] for i in own], of[own] % BLOCK, n[own], blocks[b].value.astype(np.float64))
                for k in np.unique(of[own] % BLOCK).tolist():
                    total[b * BLOCK + k] = total.get(b * BLOCK + k, 0) + got[:, k]
            if len(total) > BLOCK:
                yield from send(total)
                total = {}
        yield from send(total)

    def send(total):
        for k, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pack([(names[k], seen.astype(np.int32), counts[seen])], schema)

    rows = units.mapInArrow(work, "lang string, pieces array<int>, n array<double>")
    return (rows.select("lang", F.explode(F.arrays_zip("pieces", "n")).alias("x"))
            .groupBy("lang", F.col("x.pieces").alias("piece")).agg(F.sum("x.n").alias("n")))


def train(docs: DataFrame, pieces: list[bytes], iterations: int = ITERATIONS) -> Model:
    """The model of ``docs`` (lang, text); null langs and texts teach nothing. Texts of any script and length count
    whole; a language is whatever ``lang`` says."""
    spark, size = docs.sparkSession, len(pieces)
    units = materialise(unit_counts(docs), "units")
    languages = sorted(r.lang for r in units.select("lang").distinct().collect())
    spans = [languages[i: i + BLOCK] for i in range(0, len(languages), BLOCK)]
    model = Model(spark, pieces, languages, [np.full((size, len(s)), 1.0 / size) for s in spans])
    for _ in range(iterations if languages else 0):
        counts = materialise(_count(units, model), "pieces")
        every = counts.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        common = np.ones(size)
        common[every.column("piece").to_numpy()] += every.column("n").to_numpy()
        common /= common.sum()
        blocks = []
        for span in spans:
            own = np.zeros((size, len(span)))
            got = counts.where(F.col("lang").isin(span)).toArrow()
            place = {x: i for i, x in enumerate(span)}
            np.add.at(own, (got.column("piece").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]), got.column("n").to_numpy())
            blocks.append(np.maximum((own + PULL * common[:, None]) / (own.sum(axis=0) + PULL), LEAST))
        model = Model(spark, pieces, languages, blocks)
    return model


class Known:
    """Log probabilities of the units that a task has met, up to a fixed number of bytes, then anew."""

    def __init__(self, lattice: Lattice, blocks):
        self.lattice, self.blocks = lattice, blocks
        self.hashes, self.found = np.zeros(0, np.uint64), None

    def logs(self, units: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """A row for each unit; ``hashes`` rise."""
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        own = [units[i] for i in np.flatnonzero(new)]
        fresh = np.hstack([log_sums(self.lattice, own, b.value.astype(np.float64)) for b in self.blocks]) if own else np.zeros((0, 1))
        out = np.empty((len(units), self.found.shape[1] if self.found is not None else fresh.shape[1]))
        out[new] = fresh if own else out[new]
        if not new.all():
            out[~new] = self.found[at[~new]]
        if self.found is None or self.found.nbytes > _CACHE_BYTES:
            self.hashes, self.found = hashes, out
        elif own:
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.found = np.insert(self.found, at[new], fresh, axis=0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text): the likeliest of the model's languages, all
    equally likely beforehand (ties: the first by name), and its probability. ``und`` with score 0 for a null text, one
    without a letter, or a model without languages. Repeated rows and ids are judged each, extra columns are ignored,
    no rows give no rows."""
    bounded_batches(docs.sparkSession)
    pieces, blocks, names = model.pieces, model.blocks, model.languages
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(it):
        known = Known(Lattice(pieces), blocks) if names else None
        for batch in it:
            total = np.zeros((batch.num_rows, len(names)))
            for texts, rows in _each(batch) if names else ():
                units, at, text, hashes = units_of(texts)
                if not units:
                    continue
                row, logs = np.array(rows)[text], known.logs(units, hashes)
                for k in range(len(names)):
                    total[:, k] += np.bincount(row, logs[at, k], batch.num_rows)
            out = []
            for doc, text, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), total):
                if names and text and any(map(str.isalpha, text)):
                    best = int(t.argmax())
                    out.append((doc, names[best], float(1 / np.exp(t - t[best]).sum())))
                else:
                    out.append((doc, NO_LANGUAGE, 0.0))
            if out:
                yield pack(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    """Whether a document is left out of training: by the CRC of its decimal id (a null id is not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang); the model is of the rows that
    are not held out."""
    bounded_batches(docs.sparkSession)
    model = train(docs.where(~held_out()), vocabulary(ranks))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

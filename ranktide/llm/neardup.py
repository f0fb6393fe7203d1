"""Near-duplicate classes by BagMinHash.

A text is the multiset of its five-word shingles (words lower-cased). Multiplicities are discretised on a doubling
scale: the weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on, and each shingle has an independent
Poisson process per piece, of rate ``registers`` times the piece's length, whose points carry a uniform register and a
uniform place in the piece. A text of multiplicity w sees the points below w: whole pieces, and part of the last one.
The first point that each register sees is the signature; two texts agree in a register with the probability of their
weighted Jaccard similarity. Points are drawn in the order of time up to a horizon at which every register is filled.

Bands of the signature are the buckets of candidates. Equal texts are one node from the start. A bucket of up to
``SMALL`` nodes is verified pair by pair, by exact multiset overlap of the texts. In a larger one all nodes are verified
against a pivot, the node with the most bucket mates; those farther than two links' distance from it go on to smaller
buckets, of nodes that share one more band (texts of similarity 0.8 share eight of 26 bands on average, and fewer than
two in 4 of 10,000 cases). The weighted Jaccard distance is a metric, so what is left to find are links of a node
that is near its pivot but not linked with it. Two such texts differ in what each differs from the pivot, so a link
needs a minimum overlap of these differences, and a prefix filter over them (the rarest first) names the few
pairs that can have it. Such pairs are asked in levels: one in 256 nodes against all others, then one in 16, then the
rest, each time only where the two are in different components by then. So no link between candidates
that decides about a component is lost, and a bucket of k near copies costs about k verifications, not their square."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StructField, StructType

from ranktide.llm.common import bit_filter, bounded_batches, filter_bit, in_filter, materialise, pack, set_aside
from ranktide.llm.graph import components
from ranktide.llm.words import mix, shingles, word_hashes

BANDS = 26
ROWS = 5
THRESHOLD = 0.8
_BATCH = 1 << 17
_DRAWS = 1 << 18
SMALL = 8
LEVELS = 2
_SEGMENT_BITS = 8
_COUNT_BITS = 24
_EPSILON = 1e-9


def hashes_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower())


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles and how often each occurs."""
    return np.unique(shingles(hashes), return_counts=True)


def expanded(hashes: np.ndarray) -> np.ndarray:
    """The multiset as a set: a shingle's k-th occurrence is an element of its own."""
    values, counts = bag(hashes)
    starts = np.cumsum(counts) - counts
    times = (np.arange(counts.sum()) - np.repeat(starts, counts)).astype(np.uint64)
    return np.sort(mix(np.repeat(values, counts) + times * np.uint64(0x9E3779B97F4A7C15)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two expanded multisets."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of ``registers`` point names for each (shingles, multiplicities), none of them empty."""
    out = np.zeros((len(texts), registers), np.uint64)
    horizon = 5 + np.log(registers)  # points that a register sees, on average
    todo = np.arange(len(texts))
    while len(todo):
        element, owner, rate, room, own_horizon = [], [], [], [], []
        for i, t in enumerate(todo):
            values, counts = texts[t]
            limit = horizon / counts.sum()
            low, length = 0, 1
            while len(values):  # the pieces of the weight axis
                element.append(mix(values + np.uint64(low * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
                owner.append(np.full(len(values), i))
                rate.append(np.full(len(values), float(length * registers)))
                room.append(np.minimum((counts - low) / length, 1.0))
                own_horizon.append(np.full(len(values), limit))
                low, length = low + length, max(1, low + length)
                more = counts > low
                values, counts = values[more], counts[more]
        element, owner, rate, room, limit = map(np.concatenate, (element, owner, rate, room, own_horizon))
        time, drawn = np.zeros(len(element)), 0
        places, times, names = [], [], []
        while len(element):
            several = min(max(_DRAWS // len(element), 1), 64)  # how many points at once: no matter for what they are
            counter = np.arange(drawn + 1, drawn + several + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            draw = mix(element[:, None] + counter)
            at = -np.log(_unit(draw)) / rate[:, None]
            at[:, 0] += time
            at = np.cumsum(at, axis=1)
            name = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
            seen = (at < limit[:, None]) & (_unit(mix(name)) < room[:, None])
            register = (name % np.uint64(registers)).astype(np.int64) + (owner * registers)[:, None]
            places.append(register[seen])
            times.append(at[seen])
            names.append(name[seen])
            alive, time, drawn = at[:, -1] < limit, at[:, -1], drawn + several
            element, owner, rate, room, limit, time = (x[alive] for x in (element, owner, rate, room, limit, time))
        place, time, name = map(np.concatenate, (places, times, names))
        first = np.full(len(todo) * registers, np.inf)
        np.minimum.at(first, place, time)
        found = np.zeros(len(todo) * registers, np.uint64)
        wins = time == first[place]
        found[place[wins]] = name[wins]
        full = np.isfinite(first.reshape(-1, registers)).all(axis=1)
        out[todo[full]] = found.reshape(-1, registers)[full]
        todo, horizon = todo[~full], horizon * 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of each signature; bands of different places never meet."""
    parts = signature.reshape(len(signature), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def _signed(rows: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """(doc_id, node, n, bands): node names the word sequence (null: null text), n counts shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(it):
        def flush(held):
            full = [i for i, h in enumerate(held) if h[1] is not None and len(h[1])]
            bags = [bag(held[i][1]) for i in full]
            keys = bands(signatures(bags, n_bands * n_rows), n_rows).view(np.int64).tolist() if bags else []
            by = dict(zip(full, keys))
            size = dict(zip(full, (int(c.sum()) for _, c in bags)))
            return pa.RecordBatch.from_arrays([
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([None if h[1] is None else hashlib.blake2b(h[1].tobytes(), digest_size=16).digest() for h in held], pa.binary()),
                pa.array([size.get(i, 0) for i in range(len(held))], pa.int64()),
                pa.array([by.get(i) for i in range(len(held))], pa.list_(pa.int64()))], schema=schema)

        held, words = [], 0
        for batch in it:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((doc, None if text is None else hashes_of(text)))
                words += 0 if text is None else len(held[-1][1])
                if words >= _BATCH or len(held) >= 2000:
                    yield flush(held)
                    held, words = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(work, "doc_id long, node binary, n long, bands array<long>")


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``needed`` (node, rep): the texts pass a filter where they lie, and only those
    that it lets through are shuffled."""
    sketch = rows.sparkSession.sparkContext.broadcast(bit_filter(needed, "rep"))
    schema = pa.schema([("node", pa.binary()), ("text", pa.string())])

    def work(it):
        bits = sketch.value
        for batch in it:
            found = []
            for i in np.flatnonzero(in_filter(bits, batch.column("at").to_numpy(zero_copy_only=False))).tolist():
                text = batch.column("text")[i].as_py()
                if text is not None:
                    found.append((hashlib.blake2b(hashes_of(text).tobytes(), digest_size=16).digest(), text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    passed = rows.select(filter_bit().alias("at"), "text").mapInArrow(work, "node binary, text string")
    return passed.join(needed.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def prefix(differs: int, size: int, linked: bool, threshold: float) -> int:
    """How many of a text's ``differs`` differences from a pivot, in any order that all texts keep, :func:`_open_pairs`
    has to know; ``size`` counts the text's elements.

    Two texts x and y are linked if they differ in at most k * (|x| + |y|) elements, k = (1 - t) / (1 + t). With
    differences X and Y from the pivot a that is |X| + |Y| - 2 * |X and Y| elements, so the overlap of X and Y must be
    o = (s(x) + s(y)) / 2 at least, with s(x) = |X| - k * |x|, and the first |X| - o + 1 of X meet the first |Y| - o + 1
    of Y. For the one of smaller s, o is at least its own s, and k * |y| + 1 elements do. For the other one, o is at
    least s(x) - k * |y|, as the overlap is at most |Y|, and |y| is at most |x| / t. A text linked with a is the smaller
    one beside any that is not: s is at most k * |a| for it, and over that for the other."""
    k = (1 - threshold) / (1 + threshold)
    return min(differs, int(np.floor(k * size * (1 if linked else 1 + 1 / threshold) + _EPSILON)) + 1)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, pivot, sim, size, apart) for the pairs (a, b, pivot boolean): exact overlap of their multisets, the number
    of b's elements and, where a is b's pivot and near enough, what b differs in from it."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    longs = pa.list_(pa.int64())
    reach = 1 - threshold

    def work(it):
        known = (None, None)  # a run of pairs has one pivot
        for batch in it:
            sims, apart, size = [], [], []
            for a, pivot, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "pivot", "ta", "tb"))):
                if known[0] != a:
                    known = a, expanded(hashes_of(ta))
                own = expanded(hashes_of(tb))
                sims.append(similarity(known[1], own))
                size.append(len(own))
                elements = None
                if pivot and 1 - sims[-1] <= 3 * reach + _EPSILON:
                    elements = np.setxor1d(known[1], own, assume_unique=True)
                    elements = mix(elements ^ np.frombuffer(a[:8], np.uint64)).view(np.int64)  # told by their pivot, too
                apart.append(elements)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), batch.column("pivot"), pa.array(sims, pa.float64()),
                 pa.array(size, pa.int64()), pa.array(apart, longs)], names=["a", "b", "pivot", "sim", "size", "apart"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "pivot", "ta", "tb")
    return joined.mapInArrow(work, "a binary, b binary, pivot boolean, sim double, size long, apart array<long>")


def _fit(n, m, least: float):
    """Whether texts of n and m shingles can have this similarity."""
    return F.least(n, m) >= F.lit(least - _EPSILON) * F.greatest(n, m)


def _searched(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """All verified pairs of the buckets' nodes, in rounds: small buckets whole, others against a pivot; what is far from
    the pivot meets again in buckets that are told by one more band (each set of bands in one order)."""
    far = max(0.0, 1 - 2 * (1 - threshold))  # from this similarity on a node needs no other pivot
    bands_of = members.select("node", F.col("bucket").alias("band"))
    out, active = None, members.withColumn("band", F.col("bucket"))
    while True:
        lead = active.groupBy("bucket").agg(F.max(F.struct("mates", "node", "n")).alias("lead"), F.count(F.lit(1)).alias("size"))
        led = materialise(active.join(lead.where("size > 1"), "bucket").select(
            "bucket", "band", "node", "n", "mates", "size", F.col("lead.node").alias("a"), F.col("lead.n").alias("an")), "buckets")
        if led.isEmpty():
            return out
        small = led.where(F.col("size") <= SMALL)
        one, two = (small.select("bucket", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
        each = one.join(two, "bucket").where((F.col("a") < F.col("b")) & _fit("na", "nb", threshold)).select("a", "b")
        large = led.where((F.col("size") > SMALL) & (F.col("node") != F.col("a")))
        star = large.where(_fit("n", "an", max(0.0, 1 - 3 * (1 - threshold)))).select("a", F.col("node").alias("b"))
        pairs = each.withColumn("pivot", F.lit(False)).unionByName(star.withColumn("pivot", F.lit(True)))
        tried = materialise(_verified(pairs.groupBy("a", "b").agg(F.max("pivot").alias("pivot")), texts, threshold), "verified")
        out = tried if out is None else out.unionByName(tried)
        rest = (large.join(tried.select("a", F.col("b").alias("node"), "sim"), ["a", "node"], "left")
                .where(F.coalesce("sim", F.lit(0.0)) < far - _EPSILON).select("bucket", "band", "node", "n", "mates"))
        active = rest.join(bands_of.withColumnRenamed("band", "next"), "node").where("next > band").select(
            F.xxhash64("bucket", "next").alias("bucket"), F.col("next").alias("band"), "node", "n", "mates")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs`` (doc_id, text).

    ``class_id`` is the smallest doc_id of the document's class: those linked, directly or through others, by a
    weighted Jaccard similarity of at least ``threshold``. Texts of fewer than five words are one shingle; texts
    without words equal one another; a null text is in a class of its own. Rows that share a doc_id are compared each,
    as texts. A null doc_id takes part, and names a class only if no other can (class_id null). Extra columns are
    ignored, no rows give no rows."""
    signed, reps = _components(docs, threshold, n_bands, n_rows)
    # null texts have no node; every other row takes the smallest id of its component
    smallest = reps.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = reps.join(smallest, "component").select("node", "class_id")
    return (signed.select("doc_id", "node").join(named, "node", "left")
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def _components(docs: DataFrame, threshold: float, n_bands: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row and (node, rep, component) of each node; rep is the smallest doc_id of its rows."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(_signed(rows, n_bands, n_rows), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    postings = nodes.select("node", "rep", "n", F.explode("bands").alias("bucket"))
    sizes = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(postings.join(sizes, "bucket"), "buckets")
    mates = shared.groupBy("node").agg(F.sum("size").alias("mates"))
    members = materialise(shared.join(mates, "node").select("bucket", "node", "n", "mates"), "members")
    texts = materialise(_texts(rows, shared.select("node", "rep").distinct()), "texts")
    tried = _searched(members, texts, threshold)
    found = None
    if tried is not None:
        linked = F.col("sim") >= threshold - _EPSILON
        links = tried.where(linked).select("a", "b")
        found = materialise(components(links), "components")
        prefixes = materialise(_prefixes(tried, threshold), "prefixes")
        for level in range(LEVELS, -1, -1):
            more = materialise(_verified(_open_pairs(prefixes, found, level), texts, threshold), "verified").where(linked).select("a", "b")
            if not more.isEmpty():
                links = links.unionByName(more)
                found = materialise(components(links), "components")

    reps = nodes.select("node", "rep", F.col("node").alias("component")) if found is None else (
        nodes.select("node", "rep").join(found, "node", "left")
        .select("node", "rep", F.coalesce("component", "node").alias("component")))
    return signed, reps


def _element_counts(near: DataFrame, kinds: int = 1, told=None) -> np.ndarray:
    """How many rows of ``near`` hold an element, by a hash of it, up to 255: a table of fixed size (and, by chance, a
    little more). Tasks send their elements packed, by segment of the table. An element may be ``kinds`` times its hash
    and its kind; ``told`` gives a number for each row of counts by kind, where the segments are summed."""
    shift = _COUNT_BITS - _SEGMENT_BITS
    packed = pa.schema([("segment", pa.int32()), ("cells", pa.binary())])
    merged = pa.schema([("segment", pa.int32()), ("counts", pa.binary())])

    def send(it):
        def rows(held):
            cells = np.sort(np.concatenate(held))
            segments, starts = np.unique(cells // (kinds << shift), return_index=True)
            return pack([(int(s), c.tobytes()) for s, c in zip(segments, np.split(cells, starts[1:]))], packed)

        held, size = [], 0
        for batch in it:
            for elements in batch.column("apart").to_pylist():
                held.append((np.array(elements, np.int64) & ((kinds << _COUNT_BITS) - 1)).astype(np.int32))
                size += len(elements)
            if size > 1 << 20:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    def merge(table):
        segment, counts = table.column("segment")[0].as_py(), np.zeros(kinds << shift, np.int64)
        for cells in table.column("cells").to_pylist():
            counts += np.bincount(np.frombuffer(cells, np.int32) - segment * (kinds << shift), minlength=kinds << shift)
        counts = told(counts.reshape(-1, kinds)) if told else np.minimum(counts, 255)
        return pa.table([pa.array([segment], pa.int32()), pa.array([counts.astype(np.uint8).tobytes()])], schema=merged)

    sent = near.select("apart").mapInArrow(send, "segment int, cells binary")
    rows = sent.groupBy("segment").applyInArrow(merge, "segment int, counts binary").toArrow()
    out = np.zeros(1 << _COUNT_BITS, np.uint8)
    for segment, counts in zip(rows.column("segment").to_pylist(), rows.column("counts").to_pylist()):
        out[segment << shift: (segment + 1) << shift] = np.frombuffer(counts, np.uint8)
    return out


def _prefixes(tried: DataFrame, threshold: float) -> DataFrame:
    """(p, node, asks boolean, level, differs, s, x): the prefixes of the nodes' differences from a pivot p, as arrays of
    elements e and their places at. They begin with the rarest elements; elements that no two texts hold never become rows.
    Nodes that are not linked with p but near it ask. ``level`` is 2 for one in 256 nodes, 1 for one in
    16 of the others and 0 for the rest, by their hash."""
    near = tried.where("pivot AND size(apart) > 0").select("a", "b", "sim", "size", "apart")
    shared = tried.sparkSession.sparkContext.broadcast(_element_counts(near))
    k, far = (1 - threshold) / (1 + threshold), max(0.0, 1 - 2 * (1 - threshold))
    schema = pa.schema([("p", pa.binary()), ("node", pa.binary()), ("asks", pa.bool_()), ("differs", pa.int64()), ("s", pa.float64()),
                        ("e", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))])

    def met(it):
        counts = shared.value
        for batch in it:
            rows = []
            for p, node, sim, size, elements in zip(*(c.to_pylist() for c in batch.columns)):
                elements, linked = np.array(elements, np.int64), sim >= threshold - _EPSILON
                n = counts[elements & ((1 << _COUNT_BITS) - 1)]
                order = np.lexsort((elements, n))[: prefix(len(elements), size, linked, threshold)]
                at = np.flatnonzero(n[order] > 1)
                if len(at):
                    rows.append((p, node, not linked and sim >= far - _EPSILON, len(elements), len(elements) - k * size,
                                 elements[order][at], at + 1))
            if rows:
                yield pack(rows, schema)

    kept = near.mapInArrow(met, "p binary, node binary, asks boolean, differs long, s double, e array<long>, at array<long>")
    drawn = F.floor(-F.log2((F.pmod(F.xxhash64("node"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) / 4)
    return kept.select("p", "node", "asks", "differs", "s", F.least(drawn, F.lit(LEVELS)).cast("int").alias("level"),
                       F.arrays_zip("e", "at").alias("x"))


def _meeting(counts: np.ndarray) -> np.ndarray:
    """For each cell a bit for each kind of node (2 if it asks, and 1 if it is outside its pivot's component) that tells
    whether such a node can meet another one in it, from the numbers of nodes by kind. One of the two has to ask and
    one has to be outside, as nodes of one component do not meet."""
    inside, outside, asks_inside, asks_outside = counts.T
    return ((asks_outside > 0) | (asks_inside + asks_outside > 0) << 1 | (outside + asks_outside > 0) << 2
            | (inside + outside + asks_inside + asks_outside > 1) << 3)


def _asked_elements(part: DataFrame, level: int) -> DataFrame:
    """A row for each element of the prefixes in ``part`` by which a node may meet one of another component beside the
    same pivot, one of the two asking at this level: a table of fixed size tells most others, which never become rows.
    Most nodes of a large bucket are in their pivot's component, so they are rows only for what an outside node holds.
    Places from which not even the node of the smallest s that it may meet lets an overlap be reached are left out.
    Nodes that asked at a lower level wait for it."""
    asks = F.col("asks") & (F.col("level") == level)
    kind = asks.cast("int") * 2 + (F.col("component") != F.col("home")).cast("int")
    part = part.where(~F.col("asks") | (F.col("level") <= level)).withColumn("kind", kind)
    low = part.groupBy("p").agg(*[F.min(F.when(F.col("kind") == k, F.col("s"))).alias(f"low{k}") for k in range(4)])
    least = (F.when(F.col("kind") == 0, F.col("low3")).when(F.col("kind") == 1, F.least("low2", "low3"))
             .when(F.col("kind") == 2, F.least("low1", "low3")).otherwise(F.least("low0", "low1", "low2", "low3")))
    last = F.col("differs") + 1 - F.ceil((F.col("s") + least) / 2 - F.lit(_EPSILON))
    part = part.join(low, "p").withColumn("last", last).where("last IS NOT NULL").withColumn("x", F.filter("x", lambda x: x["at"] <= F.col("last")))
    keys = F.transform("x", lambda x: F.xxhash64("p", x["e"])).alias("key")
    part = part.where("size(x) > 0").select(
        "p", "node", "component", "asks", "level", "differs", "s", "kind", keys, F.col("x.e").alias("e"), F.col("x.at").alias("at"))
    cells = F.transform("key", lambda k: k.bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)) * 4 + F.col("kind"))
    shared = part.sparkSession.sparkContext.broadcast(_element_counts(part.select(cells.alias("apart")), 4, _meeting))
    each = ("p", "node", "component", "asks", "level", "differs", "s")

    def met(it):
        held = shared.value
        for batch in it:
            lists = batch.column("key")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            kinds = batch.column("kind").to_numpy()[row]
            hit = (held[lists.flatten().to_numpy() & ((1 << _COUNT_BITS) - 1)] >> kinds) & 1 == 1
            row = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in each), *(batch.column(c).flatten().filter(pa.array(hit)) for c in ("e", "at"))],
                names=[*each, "e", "at"])

    return materialise(part.mapInArrow(met, "p binary, node binary, component binary, asks boolean, level int, differs long, "
                                            "s double, e long, at long"), "asked")


def _open_pairs(prefixes: DataFrame, found: DataFrame, level: int) -> DataFrame:
    """(a, b, pivot) pairs of different components, one of which asks at this level, that can have the overlap of their
    differences which a link needs: they share elements of the prefixes that this overlap leaves, and these and what
    comes after the last of them are enough. Levels come in turn, the few nodes of the highest first, and what they link
    is one component before the next level asks: so k texts that are linked through each other make about k pairs for
    each of a few texts, not all pairs."""
    part = prefixes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    homes = prefixes.select("p").distinct().join(found.select(F.col("node").alias("p"), F.col("component").alias("home")), "p", "left")
    each = _asked_elements(part.join(homes.select("p", F.coalesce("home", "p").alias("home")), "p"), level)

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("p", "e", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "component", "asks", "level", "differs", "s", "at")])

    x, y = named(each.where(F.col("asks") & (F.col("level") == level)), "x"), named(each, "y")
    need = F.ceil((F.col("x_s") + F.col("y_s")) / 2 - F.lit(_EPSILON))
    once = ~F.col("y_asks") | (F.col("y_level") < level) | ((F.col("y_level") == level) & (F.col("x_node") < F.col("y_node")))
    meet = ((x["p"] == y["p"]) & (x["e"] == y["e"]) & (F.col("x_component") != F.col("y_component")) & once
            & (F.col("x_at") + need <= F.col("x_differs") + 1) & (F.col("y_at") + need <= F.col("y_differs") + 1))
    pairs = x.join(y, meet).groupBy(x["p"], "x_node", "y_node").agg(
        F.count(F.lit(1)).alias("met"), F.min(F.col("x_differs")).alias("nx"), F.min(F.col("y_differs")).alias("ny"),
        F.max("x_at").alias("ix"), F.max("y_at").alias("iy"), F.min(need).alias("need"))
    able = pairs.where(F.col("met") + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= F.col("need"))
    return able.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"), F.lit(False).alias("pivot")).distinct()


def _with_node(docs: DataFrame) -> DataFrame:
    """All columns and the row's node (null: null text)."""
    def work(it):
        for batch in it:
            nodes = [None if t is None else hashlib.blake2b(hashes_of(t).tobytes(), digest_size=16).digest()
                     for t in batch.column("text").to_pylist()]
            yield batch.append_column("_node", pa.array(nodes, pa.binary()))

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField("_node", BinaryType())]))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, all columns, and every row of a null text. It is the one of the smallest doc_id (a null
    one only if there is no other), then of the smallest node, then the first by text and the other columns; other rows
    of its doc_id, or of none, are in classes of their own. Extra columns may have any names."""
    docs, named = set_aside(docs, {"_node", "_place", "_rep", "_lead"})
    _, reps = _components(docs, threshold, BANDS, ROWS)
    lead = reps.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "node")).alias("lead"))
    lead = lead.select(F.col("lead.rep").alias("_rep"), F.col("lead.node").alias("_lead"))
    rows = _with_node(docs)
    found = rows.join(lead, (rows["_node"] == lead["_lead"]) & rows["doc_id"].eqNullSafe(lead["_rep"]), "left_semi")
    order = ["text", *sorted(f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text"))]
    place = F.row_number().over(Window.partitionBy("doc_id", "_node").orderBy(*order))
    first = found.withColumn("_place", place).where("_place = 1").select(*docs.columns)
    return named(first.unionByName(docs.where("text IS NULL")))

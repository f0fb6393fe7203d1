"""Quality rules: how far a document's histograms are from those of its language.

Two histograms describe a text: its characters by class, and its words by the language's ``common`` most frequent
words (all others are one bin). A language's reference is the sum over all its documents. A document is far when the
Jensen-Shannon distance (base 2, so 0 to 1) of a histogram to the reference passes a limit; texts under a minimum
length are not judged by that histogram, since few counts are far from anything.

Every language has a reference. References are a table, of which blocks of about ``block_langs`` languages travel to the
tasks; a document meets the block of its language. Documents of no language are compared with each, and with the sum of
all, and the nearest counts."""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranktide.llm.common import bounded_batches, materialise

#: words as the rules count them
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
#: stripped from a word before it is looked up
EDGES = ".,;:!?'\"()|"
#: the character classes: lower case, upper case, digits, white space, punctuation, other ASCII, all else
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = 7
_FLUSH = 200_000


@dataclass(frozen=True)
class Rules:
    common: int = 100
    block_langs: int = 1024
    min_class_chars: int = 200
    min_words: int = 200
    max_class_distance: float = 0.3
    max_word_distance: float = 0.4
    base_min_words: int = 50
    base_max_repeat_percent: int = 50


def _class_table() -> np.ndarray:
    table = np.full(129, 5, np.int64)
    for c in range(128):
        x = chr(c)
        table[c] = (0 if "a" <= x <= "z" else 1 if "A" <= x <= "Z" else 2 if "0" <= x <= "9" else 3 if x in SPACE
                    else 4 if x in PUNCTUATION else 5)
    table[128] = 6
    return table


TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(TABLE[np.minimum(points, 128)], minlength=CLASSES)


def bare(word: str) -> str:
    return word.strip(EDGES).lower()


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        often = {t for t, n in Counter(triples).items() if n > 1}
        covered_to = 0  # words before this one are counted or not covered
        for i, t in enumerate(triples):
            if t in often:
                repeated += i + 3 - max(i, covered_to)
                covered_to = i + 3
    return sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms of counts, neither empty."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def half(a):
        own = a > 0
        return float((a[own] * np.log2(a[own] / m[own])).sum())

    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


def word_distance(words: Counter, bins: dict[str, int], reference: np.ndarray) -> float:
    own = np.zeros(len(reference), np.int64)
    for word, times in words.items():
        own[bins.get(bare(word), len(bins))] += times
    return distance(own, reference)


def reference_table(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, key, n) for each language, "" being all together: counts of the character classes and of all words, whose
    keys begin with a space, and of its common words. Over every document; ``common`` + 8 rows a language."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.string()), ("n", pa.int64())])

    def work(it):
        found: dict[str, Counter] = {}

        def rows():
            out = [(lang, k, n) for lang, c in found.items() for k, n in c.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in it:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if text:
                    counts = found.setdefault(lang, Counter())
                    words = Counter(WORD.findall(text))
                    for word, n in words.items():
                        counts[bare(word)] += n
                    for i, n in enumerate(class_counts(text).tolist()):
                        counts[f" {i}"] += n  # no word holds a space
                    counts[" words"] += words.total()
            if sum(map(len, found.values())) > _FLUSH:
                yield rows()
        if found:
            yield rows()

    partial = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(
        work, "lang string, key string, n long")
    counts = partial.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # the counts of all languages together are a language of their own, named ""
    counts = materialise(counts, "language-counts")
    every = counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "key", "n")
    both = counts.where("lang <> ''").unionByName(every)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = (both.where("key NOT LIKE ' %' AND key <> ''").withColumn("_rank", F.row_number().over(order))
           .where(F.col("_rank") <= rules.common).drop("_rank"))
    return materialise(both.where("key LIKE ' %'").unionByName(top), "references")


def collected(table: DataFrame) -> dict[str, tuple[list[int], dict[str, int], int]]:
    """For each language of ``table``: counts of the character classes, counts of its common words, and all words."""
    found: dict[str, dict[str, int]] = {}
    for lang, key, n in zip(*(c.to_pylist() for c in table.select("lang", "key", "n").toArrow().columns)):
        found.setdefault(lang, {})[key] = n
    out = {}
    for lang, own in found.items():
        words = sorted((k for k in own if not k.startswith(" ")), key=lambda k: (-own[k], k))
        out[lang] = [own.get(f" {i}", 0) for i in range(CLASSES)], {k: own[k] for k in words}, own[" words"]
    return out


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[list[int], dict[str, int], int]]:
    """The references of all languages, for tables of few of them."""
    return collected(reference_table(docs, rules))


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, class_distance double, word_distance double")


def judge(docs: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance,
    word_distance, *keep) for each row of ``docs`` (doc_id, text, lang).

    ``base_failed``: under ``base_min_words`` words, or over ``base_max_repeat_percent`` of them in repeated triples.
    ``kept``: neither that nor a distance over its limit. A distance is null where the text is too short for it. A
    null text has no words and fails; a null language is held against every reference; repeated rows are judged each;
    columns not in ``keep`` are ignored, and ``keep`` may not name one of the result's own (ValueError); no rows give no
    rows."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if taken := {c.lower() for c in keep} & {"doc_id", *names}:
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    kept_types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    table = reference_table(docs.select("lang", "text"), rules)
    n_blocks = max(1, -(-table.where("key = ' words'").count() // rules.block_langs))
    block = F.pmod(F.xxhash64("lang"), F.lit(n_blocks))
    shared = [docs.sparkSession.sparkContext.broadcast(collected(table.where(block == k))) for k in range(n_blocks)]

    def ready_for(found):
        ready = {}
        for lang, (classes, common, words) in found.items():
            bins = {w: i for i, w in enumerate(common)}
            ready[lang] = np.array(classes), bins, np.array([*common.values(), words - sum(common.values())])
        return ready

    def nearest(text, words, against, so_far=()):
        """The least distances to ``against`` and of those known before; null for a text too short."""
        by_class, by_word = ([x] if x is not None else [] for x in so_far or (None, None))
        if len(text) >= rules.min_class_chars:
            own = class_counts(text)
            by_class += [distance(own, classes) for classes, _, _ in against]
        if len(words) >= rules.min_words:
            counted = Counter(words)
            by_word += [word_distance(counted, bins, reference) for _, bins, reference in against]
        return min(by_class, default=None), min(by_word, default=None)

    def nearer(found):
        """The distances so far with those to one more block, for texts of no language."""
        def work(it):
            ready = ready_for(found.value)
            for batch in it:
                rows = [nearest(t or "", WORD.findall(t or ""), ready.values(), so_far)
                        for t, *so_far in zip(*(batch.column(c).to_pylist() for c in ("text", "_class", "_word")))]
                for i, name in enumerate(("_class", "_word")):
                    batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array([r[i] for r in rows], pa.float64()))
                yield batch
        return work

    def judged(found):
        def work(it):
            ready = ready_for(found.value)

            def one(text, lang, *so_far):
                words = WORD.findall(text)
                n = len(words)
                chars, symbols, lines, repeated = base_counts(text, words)
                failed = n < rules.base_min_words or 100 * repeated > rules.base_max_repeat_percent * n
                # a language without a reference has no text that is long enough to be judged
                against = ready.values() if not lang else [ready[lang]] if lang in ready else []
                by_class, by_word = nearest(text, words, against, so_far)
                far = (by_class or 0) > rules.max_class_distance or (by_word or 0) > rules.max_word_distance
                return n, chars, symbols, lines, repeated, failed, not failed and not far, by_class, by_word

            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            for batch in it:
                if batch.num_rows:
                    rows = [one(t or "", *rest) for t, *rest in zip(*(batch.column(c).to_pylist() for c in ("text", "_lang", "_class", "_word")))]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types)),
                         *(batch.column(f"_keep{i}") for i in range(len(keep)))], names=["doc_id", *names, *keep])
        return work

    none = F.lit(None).cast("double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("_lang"),
                       none.alias("_class"), none.alias("_word"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    out = f"doc_id long, {COLUMNS}{kept_types}"
    if n_blocks == 1:
        return rows.mapInArrow(judged(shared[0]), out)
    at = F.pmod(F.xxhash64("_lang"), F.lit(n_blocks))
    parts = [rows.where((F.col("_lang") != "") & (at == k)).mapInArrow(judged(found), out) for k, found in enumerate(shared)]
    unnamed = rows.where("_lang = ''")
    for found in shared[:-1]:
        unnamed = unnamed.mapInArrow(nearer(found), rows.schema)
    return functools.reduce(DataFrame.unionByName, [*parts, unnamed.mapInArrow(judged(shared[-1]), out)])

"""URL filter: rules first, then naive Bayes over segmented words.

Names in hosts and paths are runs of letters. A unigram Viterbi search splits each distinct name into the most probable
words; its dictionary is every word of the corpus with its exact count. Neither dictionary nor model is held anywhere as
a whole: a name's substrings are joined with the word counts, so a task has the words of its own names, and a page's
tokens are joined with their weights.

The words of a host and of a path are the tokens of a multinomial naive Bayes model with two equally likely classes. A
class's probability of a token is its share of all tokens times (n + PULL) / (expected n + PULL), n being its count in
the class and the expected one that of no difference between classes: tokens that both classes have alike, or that were
hardly seen, weigh nothing. Words of a short fixed list weigh at least what is set there. A page is blocked if its odds
are over e to the ``MARGIN``."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm.common import batches, bounded_batches, each_row, materialise

#: letters of the longest dictionary word, and of an unknown piece: longer unknown names are several pieces
LONGEST = 24
PULL = 5.0
MARGIN = 1.0
_FLUSH = 200_000
_LETTERS = re.compile(r"[a-z]+")

#: words that speak for blocking whatever the labels say, alone or two together (fixed values)
STRONG, WEAK = 1.5, 0.75
STRONG_WORDS = "adult bingo casino escort gambling jackpot lottery nude pharma poker porn sex slots spam viagra warez xxx".split()
WEAK_WORDS = "ads bet bets betting cheap click coupon dating deals farm free loan loans pills promo track tracker win".split()
LEXICON = {w: STRONG for w in STRONG_WORDS} | {w: WEAK for w in WEAK_WORDS}


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str  # host and path, such as net/es/

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): all words (runs of a to z, of 2 to 24 letters) of all texts, with their counts."""
    bounded_batches(texts.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(it):
        found = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)
            found.clear()
            return out

        for batch in it:
            for text in batch.column("text").to_pylist():
                if text:
                    found.update(w for w in _LETTERS.findall(text.lower()) if 1 < len(w) <= LONGEST)
                    if len(found) > _FLUSH:
                        yield rows()
        if found:
            yield rows()

    counts = texts.select(F.col(text_col).alias("text")).mapInArrow(work, "word string, n long")
    return materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")


def substrings(name: str) -> set[str]:
    """What may be a dictionary word in ``name``."""
    return {name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1)}


class Segmenter:
    """Unigram Viterbi: the words of a run of letters whose product of probabilities is largest. ``total`` is the sum
    of all counts of the dictionary and ``usual`` its mean, by default those of ``counts``; a word of the fixed list
    counts as a usual one at least."""

    def __init__(self, counts: dict[str, int], total: int | None = None, usual: float | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        usual = (total / len(counts) if counts else 1) if usual is None else usual
        known = counts | {w: max(counts.get(w, 0), usual) for w in LEXICON}
        self.total = math.log(total)
        self.cost = {w: self.total - math.log(n) for w, n in known.items()}

    def unknown(self, length: int) -> float:
        """An unknown word: ten times less probable with each letter."""
        return self.total + length * math.log(10)

    def split(self, name: str) -> list[str]:
        """The words of ``name`` in order; of equally probable splits the one with the longer first words."""
        n = len(name)
        best, step = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = math.inf
            for j in range(min(n, i + LONGEST), i, -1):
                cost = self.cost.get(name[i:j], self.unknown(j - i)) + best[j]
                if cost < best[i]:
                    best[i], step[i] = cost, j
        got, i = [], 0
        while i < n:
            got.append(name[i: step[i]])
            i = step[i]
        return got


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for each row of ``names`` (name, each once), by the word counts (word, n)."""
    size = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, usual = size[0] or 1, (size[0] or 1) / (size[1] or 1)
    keyed = names.select("name", F.md5("name").alias("key"))

    def cut(it):
        yield from batches(((key, w) for name, key in each_row(it) for w in substrings(name)),
                           pa.schema([("key", pa.string()), ("word", pa.string())]), 20_000)

    own = (keyed.mapInArrow(cut, "key string, word string").join(counts, "word")
           .groupBy("key").agg(F.collect_list("word").alias("own"), F.collect_list("n").alias("ns")))

    def split(it):
        def rows():
            for name, words, ns in each_row(it):
                yield name, Segmenter(dict(zip(words or (), ns or ())), total, usual).split(name)

        yield from batches(rows(), pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))]))

    return keyed.join(own, "key", "left").select("name", "own", "ns").mapInArrow(split, "name string, words array<string>")


def tokens(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, place, token) for each row of ``rows`` (row, host, path): the words of the host without its last label
    (h:...) and of the path (p:...)."""
    before = F.regexp_extract("host", r"(?s)^(.*)\.[^.]*$", 1)

    def named(text, kind):
        runs = F.regexp_extract_all(text, F.lit("([a-z]+)"))
        return F.transform(runs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    each = rows.select("row", F.posexplode(F.concat(named(before, "h:"), named(F.lower("path"), "p:"))).alias("place", "x"))
    each = each.select("row", "place", "x.kind", "x.name")
    words = materialise(segmented(each.select("name").distinct(), counts), "segments")
    return each.join(words, "name").select(
        "row", "kind", "place", F.posexplode("words").alias("nth", "word")).select(
        "row", F.struct("place", "nth").alias("place"), F.concat("kind", "word").alias("token"))


def lexicon(spark: SparkSession, words: dict[str, float] = LEXICON) -> DataFrame:
    """(token, floor) of the fixed words, in hosts and in paths."""
    return spark.createDataFrame([(k + w, v) for w, v in words.items() for k in ("h:", "p:")], "token string, floor double")


@dataclass(frozen=True)
class Model:
    weights: DataFrame  # (token, weight): log odds of block
    unseen: float  # of all other tokens


def train(pages: DataFrame, counts: DataFrame, words: dict[str, float] = LEXICON) -> Model:
    """The model of all rows of ``pages`` (host, path, block boolean; a null block teaches nothing)."""
    rows = materialise(pages.where("block IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "host", "path", "block"), "labelled")
    seen = tokens(rows, counts).join(rows.select("row", "block"), "row").groupBy("token").agg(
        F.count_if("block").alias("n1"), F.count_if(~F.col("block")).alias("n0"))
    seen = materialise(seen, "tokens")
    n1, n0 = (x or 0 for x in seen.agg(F.sum("n1"), F.sum("n0")).first())
    n, of = F.col("n1") + F.col("n0"), max(1, n1 + n0)

    def factor(count, size):
        return (count + F.lit(PULL)) / (n * F.lit(size / of) + F.lit(PULL))

    factors = seen.select("token", (n / F.lit(of)).alias("share"), factor(F.col("n1"), n1).alias("f1"), factor(F.col("n0"), n0).alias("f0"))
    whole = factors.agg(F.sum(F.col("share") * F.col("f1")), F.sum(F.col("share") * F.col("f0"))).first()
    unseen = math.log(whole[1] / whole[0]) if whole[0] else 0.0
    weight = F.coalesce(F.log("f1") - F.log("f0"), F.lit(0.0)) + F.lit(unseen)
    weights = factors.join(lexicon(pages.sparkSession, words), "token", "full").select("token", F.greatest(weight, "floor").alias("weight"))
    return Model(materialise(weights, "weights"), unseen)


def judge(pages: DataFrame, rules: list[Rule], counts: DataFrame, model: Model) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, odds) for each row of ``pages`` (page_id, url).

    The verdict is the longest fitting rule's, else ``block`` if ``odds``, the model's log odds less ``MARGIN``, are above
    0. A null url or one without ``://`` has an empty host and path and no tokens, and is allowed. Repeated rows are
    judged each; extra columns are ignored; no rows give no rows."""
    host, path = F.col("host"), F.col("path")
    rows = materialise(located(pages).withColumn("row", F.monotonically_increasing_id()), "pages")
    sums = tokens(rows, counts).join(model.weights, "token", "left").groupBy("row").agg(
        F.sum(F.coalesce("weight", F.lit(model.unseen))).alias("sum"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), " ").alias("words"))
    verdicts = F.lit(None).cast("string")
    for r in rules:
        verdicts = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(verdicts)
    odds = F.coalesce("sum", F.lit(0.0)) - F.lit(MARGIN)
    own = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return (rows.withColumn("rule", rule_of(host, path, rules)).join(sums, "row", "left").withColumn("odds", odds)
            .select("page_id", "host", "path", "rule", F.coalesce(verdicts, own).alias("verdict"),
                    F.coalesce("words", F.lit("")).alias("words"), "odds"))


def located(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    host, path = split_url(F.col("url"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

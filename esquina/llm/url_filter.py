"""URL filter: rules first, then naive Bayes over the words of host and path.

Hosts run words together. Counts of the words of all page texts are joined to the substrings of every distinct part of
a name, so the dictionary is never broadcast, and a unigram Viterbi search splits the part with its own candidates
only. Multinomial naive Bayes, fitted by grouped counts on labelled URLs, then scores the words; its table has one row
per word of the labelled sample, which is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from esquina.llm.labelled_urls import ALLOWED, BLOCKED
from esquina.operators.stage import settle

ALLOW, BLOCK = "allow", "block"
# Host, path and verdict of the rules.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
# A word of a name has at most so many letters, by which its substrings are bounded.
LONGEST_WORD = 20
# Parts of names longer than this are cut into runs of this length before they are searched for words.
LONGEST_PART = 64
# Labelled URLs that a model is fitted on, at most; beyond, those with the least hashes are taken.
MOST_LABELLED = 100_000
# Share of URLs that are taken to be blocked before a word is seen.
PRIOR_BLOCKED = 0.1
# Added to the count of every word in both classes.
SMOOTHING = 0.1
# What a run of letters that is no known word counts as, against a corpus of N words: 10 / (N * 10^length).
UNKNOWN_TOP = 10.0


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case. Empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_col: str, path_col: str, rules: list[tuple[str, str, str]]) -> Column:
    """``name, verdict`` of the longest rule that fits; of equal lengths the first in order of the alphabet."""

    def one(rule_host: str, start: str, verdict: str) -> Column:
        fits = ((F.col(host_col) == rule_host) | F.endswith(F.col(host_col), F.lit(f".{rule_host}"))) & F.startswith(F.col(path_col), F.lit(start))
        return F.when(fits, F.struct(F.lit(-len(rule_host + start)).alias("size"), F.lit(rule_host + start).alias("name"), F.lit(verdict).alias("verdict")))

    return F.array_min(F.array_compact(F.array(*[one(*r) for r in rules])))


def parts_of(text: Column) -> Column:
    """Runs of letters and digits, in runs of ``LONGEST_PART`` at most, and no longer ones."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[\\p{{L}}\\p{{M}}]{{1,{LONGEST_PART}}}|[0-9]{{1,{LONGEST_PART}}}"), F.lit(0))


def letter_parts(text: Column) -> Column:
    return F.filter(parts_of(text), lambda p: ~p.rlike("^[0-9]"))


def word_counts(pages: DataFrame, text: Column) -> DataFrame:
    """``word, n``: how often each word of up to ``LONGEST_WORD`` letters stands in the texts of all pages."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    each = pages.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST_WORD)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, blocked``: the shipped labels."""
    rows = [(f"http://{u}", True) for u in BLOCKED] + [(f"http://{u}", False) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, blocked boolean")


# --- segmentation ----------------------------------------------------------

def best_split(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of ``part`` with the largest product of word probabilities; of equal ones that whose last word is longest."""
    best = [0.0] + [-math.inf] * len(part)
    back = [0] * (len(part) + 1)
    log_total = math.log(total)
    for end in range(1, len(part) + 1):
        for begin in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(part[begin:end])
            word = math.log(n) - log_total if n else math.log(UNKNOWN_TOP) - log_total - (end - begin) * math.log(10)
            if best[begin] + word > best[end]:
                best[end], back[end] = best[begin] + word, begin
    words, end = [], len(part)
    while end:
        words.append(part[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``part, words`` for distinct ``part``: every one meets only those words of the corpus that it holds."""
    total = max(1, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    spans = F.expr(
        f"flatten(transform(sequence(1, length(part)), b -> transform(sequence(1, least({LONGEST_WORD}, length(part) - b + 1)), n -> substr(part, b, n))))"
    )
    pieces = parts.select("part", F.explode(F.array_distinct(spans)).alias("word"))
    # A piece of very many parts is joined as often, which Spark splits at run time; a part has 1300 pieces at most.
    known = pieces.join(counts, "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for text, words in zip(texts.to_pylist(), found.to_pylist()):
            rows.append(best_split(text, {w["word"]: w["n"] for w in words or ()}, total))
        return pa.array(rows, pa.list_(pa.string()))

    return parts.join(known, "part", "left").select("part", split("part", "known").alias("words"))


# --- naive Bayes -----------------------------------------------------------

@dataclass
class UrlModel:
    """Evidence for blocking: log odds before any word and per word of the labelled sample."""

    odds: float
    words: dict[str, float]


def train(labelled: DataFrame, counts: DataFrame, prior: float = PRIOR_BLOCKED, most: int = MOST_LABELLED) -> UrlModel:
    """Fitted on ``url, blocked``: rows without a label take no part, and at most ``most`` rows do."""
    rows = labelled.filter("blocked IS NOT NULL").select("url", "blocked").distinct()
    rows = rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(most)
    tokens = url_words(rows.select("url", "blocked", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), counts)
    each = tokens.select("blocked", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("blocked").alias("yes"), F.count_if(~F.col("blocked")).alias("no")
    )
    table = each.collect()
    yes, no = (sum(r[c] for r in table) + SMOOTHING * len(table) for c in ("yes", "no"))
    words = {r["word"]: math.log((r["yes"] + SMOOTHING) / yes) - math.log((r["no"] + SMOOTHING) / no) for r in table}
    return UrlModel(math.log(prior / (1 - prior)), words)


def url_words(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``words``: of host and path, whose parts are split into words.

    Each distinct list of parts is split once; its words are joined back, and Spark spreads a list of very many rows.
    """
    own = rows.withColumn("host_parts", letter_parts(F.col("host"))).withColumn("path_parts", letter_parts(F.col("path")))
    both = own.select(F.explode(F.array("host_parts", "path_parts")).alias("parts"))
    lists = settle(both.filter(F.size("parts") > 0).distinct(), "url-parts")
    parts = lists.select(F.explode("parts").alias("part")).distinct()
    split = lists.select("parts", F.posexplode("parts").alias("at", "part")).join(segmented(parts, counts), "part")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])
    named = settle(split.groupBy("parts").agg(F.flatten(in_order).alias("words")), "url-words")
    of_host = named.select(F.col("parts").alias("host_parts"), F.col("words").alias("host_words"))
    of_path = named.select(F.col("parts").alias("path_parts"), F.col("words").alias("path_words"))
    joined = own.join(of_host, "host_parts", "left").join(of_path, "path_parts", "left")
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("host_words", none), F.coalesce("path_words", none))
    return joined.select(*rows.columns, words.alias("words"))


def log_odds(words: Column, model: UrlModel) -> Column:
    """Words that no labelled URL has tell nothing."""
    table = F.create_map(*[F.lit(x) for pair in sorted(model.words.items()) for x in pair]) if model.words else F.create_map().cast("map<string,double>")
    return F.aggregate(words, F.lit(model.odds), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))


def judge(pages: DataFrame, model: UrlModel, counts: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``page_id, host, path, words, log_odds, rule, verdict`` of every row.

    The longest rule decides; without one a URL is blocked if its words make that likelier than not. A null URL, or one
    without ``://``, has no host, no path and no words and is allowed, as is a host without known words. Rows that
    repeat are judged each; a null id stays null; other columns take no part.
    """
    rules = RULES if rules is None else rules
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    scored = url_words(rows, counts).withColumn("log_odds", log_odds(F.col("words"), model))
    found = scored.withColumn("found", rule_of("host", "path", rules)) if rules else scored.withColumn("found", F.lit(None).cast("struct<name: string, verdict: string>"))
    verdict = F.coalesce("found.verdict", F.when(F.col("log_odds") > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return found.select("page_id", "host", "path", "words", "log_odds", F.col("found.name").alias("rule"), verdict.alias("verdict"))


def corpus_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Word counts of all pages and of the labelled URLs' own words, which may stand in no page."""
    own = labelled_urls(pages.sparkSession).select(F.explode(letter_parts(F.regexp_replace("url", r"^http://|\.test", " "))).alias("word"))
    shipped = own.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    both = word_counts(pages, F.col(f"`{html_col}`")).unionByName(shipped)
    return settle(both.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def filter_urls(pages: DataFrame) -> DataFrame:
    """Verdicts of all ``pages`` (page_id, url, html) by the rules, the shipped labels and the pages' own words."""
    counts = corpus_counts(pages)
    return judge(pages, train(labelled_urls(pages.sparkSession), counts), counts)

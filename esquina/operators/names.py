"""Which street does a text mean: trigram suggestions and code-or-name resolution.

Scores depend on the street name only, so the segments are reduced to one row per name
first, and the requests to one row per normalised text. Candidates come from two
equi-joins and every candidate is then checked exactly:

* in-order substrings: a matching name holds every literal run of the pattern, so the
  join is on one slice of such a run, the least common one. All such matches score the same,
  so the names are searched in their order, range by range, and a query leaves when it has
  as many as it wants;
* similarity: two sets over a threshold share a gram among the first few of each, in any
  order that both sides use (prefix filter). The commonest grams are put last.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from esquina.functions import checks
from esquina.functions import text as tx
from esquina.operators.skew import hot_rows, spread_lookup
from esquina.operators.stage import settle

# Fixed value: number of suggestions when the request gives none.
DEFAULT_LIMIT = 20

# So many token hits score more than the flat value of a substring match.
MANY_TOKENS = 5

# Thresholds in percent, so that the set bounds are exact integers.
SIMILAR, FLAT = 35, 70

# Grams that are put last; a bound for what the driver reads.
COMMON_GRAMS = 256
# Names of this length and more share one key.
LONG_NAME = 256
# Names in the first range that is searched for substrings, and how many times as many in each later one.
FIRST_NAMES, MORE_NAMES = 256, 8


@dataclass
class NameIndex:
    """One row per street name, with its grams in the shared order and its place ``ord`` by name, null last."""

    names: DataFrame
    common: list[str]
    size: int
    # Stored forms of the two look-ups, by ``key`` and by ``gram``; made from the names where there is none.
    slices: DataFrame | None = None
    grams: DataFrame | None = None

    def by_slice(self) -> DataFrame:
        return name_slices(self.names) if self.slices is None else self.slices

    def by_gram(self) -> DataFrame:
        return name_grams(self.names) if self.grams is None else self.grams

    def spread(self, keyed: DataFrame, asked: DataFrame, key: str) -> DataFrame:
        """Names joined to queries by a slice; one that very many names have is salted."""
        # A slice has at most one row per name.
        counts = None
        if self.size > hot_rows(keyed):
            counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return spread_lookup(keyed, asked, counts, [key], F.col("nnorm"), "inner")


@dataclass
class StreetIndex:
    """A street table and what look-ups need of it. Parts that are not stored are made by the job that needs them."""

    streets: DataFrame
    stored_names: NameIndex | None = None
    codes: DataFrame | None = None
    blocks: DataFrame | None = None
    segments: DataFrame | None = None

    def names(self) -> NameIndex:
        return self.stored_names or name_index(self.streets)


def indexed(streets: DataFrame | StreetIndex) -> StreetIndex:
    return streets if isinstance(streets, StreetIndex) else StreetIndex(streets)


def name_slices(names: DataFrame) -> DataFrame:
    return names.withColumn("key", F.explode_outer(_name_keys(F.col("nnorm"))))


def name_grams(names: DataFrame) -> DataFrame:
    """The first few grams of every name, with their places."""
    return names.withColumn("n", F.size("grams")).select(
        "*", F.posexplode_outer(F.slice("grams", F.lit(1), _prefix_length(F.col("n"), SIMILAR))).alias("at", "gram")
    )


def _strings(values: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _gram_order(grams: Column, common: list[str]) -> Column:
    last = _strings(common)
    return F.concat(F.array_sort(F.array_except(grams, last)), F.array_intersect(last, grams))


def name_index(streets: DataFrame) -> NameIndex:
    """Distinct names with a representative code. Reads at most 256 grams to the driver."""
    names = settle(
        in_name_order(
            streets.groupBy("nombre_cal")
            .agg(F.min("numero_cal").alias("numero_cal"))
            .withColumn("nnorm", tx.norm_text(F.col("nombre_cal")))
            .withColumn("grams", tx.trigrams(F.col("nnorm")))
        ),
        "names",
    )
    counted = names.select(F.explode("grams").alias("g")).groupBy("g").count()
    top = counted.orderBy(F.desc("count"), "g").limit(COMMON_GRAMS).collect()
    common = [r["g"] for r in sorted(top, key=lambda r: (r["count"], r["g"]))]
    return NameIndex(names.withColumn("grams", _gram_order(F.col("grams"), common)), common, names.count())


def in_name_order(names: DataFrame) -> DataFrame:
    """Adds ``ord``, 0 and up without gaps; the counts of the sorted table's parts are broadcast, one row for each."""
    row = F.monotonically_increasing_id()
    placed = settle(names.orderBy(F.asc_nulls_last("nombre_cal")).withColumn("_row", row), "names-in-order")
    part, in_part = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn("ord", F.col("_start") + in_part).drop("_part", "_row", "_start")


def _least(n: Column, percent: Column | int) -> Column:
    """Smallest whole number that is at least ``percent`` of n."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _prefix_length(n: Column, percent: Column | int) -> Column:
    return F.greatest(n - _least(n, percent) + 1, F.lit(0))


def _few_tokens() -> Column:
    """Whether no name can score more than the flat value by its token hits."""
    return F.size(F.filter("toks", lambda t: t != "")) < MANY_TOKENS


def prepare_queries(queries: DataFrame, index: NameIndex) -> DataFrame:
    """Adds tokens, pattern, ordered grams and the join keys to (qnorm, k)."""
    toks = tx.name_tokens(F.col("qnorm"))
    common = _strings(index.common)
    q = (
        queries.withColumn("toks", toks)
        .withColumn("raw", tx.like_pattern(F.col("toks")))
        .withColumn("pat", tx.spark_like_pattern(F.col("raw")))
        .withColumn("runs", tx.literal_runs(F.col("raw")))
        .withColumn("qgrams", _gram_order(tx.trigrams(F.col("qnorm")), index.common))
    )
    slices = F.flatten(F.transform("runs", lambda r: tx.grams(r, 3)))
    rare_first = F.concat(F.array_except(slices, common), F.array_intersect(common, slices))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
    key = F.when(F.size(slices) > 0, F.get(rare_first, F.lit(0))).otherwise(longest["r"])
    lengths = F.transform(
        F.sequence(F.least(tx.wildcard_min_length(F.col("raw")), F.lit(LONG_NAME)), F.lit(LONG_NAME)),
        lambda n: F.concat(F.lit("length "), n.cast("string")),
    )
    return (
        q.withColumn("keys", F.when(F.size("runs") == 0, lengths).otherwise(F.array(key)))
        .drop("raw", "runs")
    )


def _name_keys(nnorm: Column) -> Column:
    """Slices of one to three characters, and the length."""
    length = F.concat(F.lit("length "), F.least(F.length(nnorm), F.lit(LONG_NAME)).cast("string"))
    return F.concat(*[tx.grams(nnorm, n) for n in (1, 2, 3)], F.array(length))


def _pair_scores(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("sim", tx.set_similarity(F.col("qgrams"), F.col("grams")))
        .withColumn("is_like", tx.like(F.col("nnorm"), F.col("pat")))
        .withColumn("bonus", tx.token_bonus(F.col("toks"), F.col("nnorm")))
        .withColumn("score", tx.suggestion_score(F.col("sim"), F.col("is_like"), F.col("bonus")))
    )


def substring_pairs(queries: DataFrame, index: NameIndex, low: int = 0, high: int | None = None) -> DataFrame:
    """Pairs whose name holds the query tokens in order, of the names at places from ``low`` up to ``high``."""
    keyed = index.by_slice()
    keyed = keyed if low == 0 else keyed.filter(F.col("ord") >= low)
    keyed = keyed if high is None else keyed.filter(F.col("ord") < high)
    asked = queries.withColumn("key", F.explode("keys")).drop("keys")
    return _pair_scores(index.spread(keyed, asked, "key").drop("key")).filter("is_like")


def first_substrings(queries: DataFrame, index: NameIndex, wanted: list[str]) -> DataFrame:
    """The pairs of ``substring_pairs`` that can be answers: per query the first ``k`` that score the flat value by
    their order, and those found on the way that score more. Queries whose token hits may score more see all names.
    """
    flat = F.col("sim") <= tx.LIKE_SCORE
    in_order = Window.partitionBy("qnorm", "k").orderBy("ord")
    found: list[DataFrame] = []
    low, size = 0, FIRST_NAMES
    while True:
        high = low + size if low + size < index.size else None
        pairs = substring_pairs(queries, index, low, high).withColumn("few", _few_tokens())
        later = pairs.filter(~(F.col("few") & flat)).withColumn("_at", F.lit(None).cast("int"))
        first = pairs.filter(F.col("few") & flat).withColumn("_at", F.row_number().over(in_order)).filter(F.col("_at") <= F.col("k"))
        found.append(settle(first.filter(F.col("_at") <= checks.MAX_LIMIT).unionByName(later).select(*wanted, "sim", "few"), "substring-pairs"))
        if high is None:
            break
        so_far = _union(found).filter(F.col("few") & flat).groupBy("qnorm", "k").agg(F.count(F.lit(1)).alias("n"))
        enough = so_far.filter(F.col("n") >= F.col("k")).select("qnorm", "k")
        queries = settle(queries.join(enough, ["qnorm", "k"], "left_anti"), "open-queries")
        if queries.isEmpty():
            break
        low, size = high, size * MORE_NAMES
    return _union(found).drop("few")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def similar_pairs(queries: DataFrame, index: NameIndex) -> DataFrame:
    """Pairs over the similarity threshold ``percent`` of the query, each found once."""
    left = queries.withColumn("qn", F.size("qgrams")).withColumn(
        "gram", F.explode_outer(F.slice("qgrams", F.lit(1), _prefix_length(F.col("qn"), F.col("percent"))))
    )
    right = index.by_gram()
    percent = F.col("percent")
    first_shared = F.get(F.array_intersect("qgrams", "grams"), F.lit(0))
    pairs = index.spread(right, left, "gram").filter(
        (F.col("n") * 100 >= F.col("qn") * percent)
        & (F.col("qn") * 100 >= F.col("n") * percent)
        & (F.col("at") < _prefix_length(F.col("n"), percent))
        & (first_shared == F.col("gram"))
    )
    scored = _pair_scores(pairs.drop("gram", "at", "n", "qn"))
    return scored.filter((F.col("sim") > tx.MIN_SIMILARITY) & (F.col("sim") * 100 >= percent - 1e-9))


def rank_names(queries: DataFrame, index: NameIndex, k_max: int) -> DataFrame:
    """The best names of every distinct (qnorm, k): rank 1 to k, best score first."""
    prepared = settle(prepare_queries(queries, index), "name-queries")
    wanted = ["qnorm", "k", "nombre_cal", "numero_cal", "score"]
    by_substring = first_substrings(prepared, index, wanted)
    # With k names at 0.7 already, a name that is less similar cannot be an answer, unless its token hits lift it.
    filled = by_substring.groupBy("qnorm", "k").agg(F.count(F.lit(1)).alias("found"))
    graded = prepared.join(filled, ["qnorm", "k"], "left").withColumn(
        "percent", F.when((F.col("found") >= F.col("k")) & _few_tokens(), F.lit(FLAT)).otherwise(F.lit(SIMILAR))
    )
    # The two sides are disjoint: similar names of a pattern come from the second.
    low = by_substring.filter(F.col("sim") <= tx.LIKE_SCORE).select(*wanted)
    high = similar_pairs(graded, index).filter(~F.col("is_like") | (F.col("sim") > tx.LIKE_SCORE)).select(*wanted)
    best = Window.partitionBy("qnorm").orderBy(F.desc("score"), F.asc_nulls_last("nombre_cal"))
    return (
        low.unionByName(high)
        .withColumn("rank", F.row_number().over(best))
        .filter((F.col("rank") <= k_max) & (F.col("rank") <= F.col("k")))
        .drop("k")
    )


def suggest(requests: DataFrame, streets: DataFrame | StreetIndex) -> DataFrame:
    """Street suggestions for (req_id, qstr, limit): req_id, rank, code, name, score.

    Requests that fail the argument checks give no rows; see ``suggest_status``.
    """
    asked = requests.filter(checks.valid_suggest(F.col("qstr"), F.col("limit"))).select(
        "req_id",
        tx.norm_text(F.col("qstr")).alias("qnorm"),
        F.coalesce("limit", F.lit(DEFAULT_LIMIT)).alias("limit"),
    )
    counts = settle(
        asked.groupBy("qnorm").agg(F.max("limit").alias("k"), F.count(F.lit(1)).alias("n")), "suggest-texts"
    )
    ranked = rank_names(counts.select("qnorm", "k"), indexed(streets).names(), checks.MAX_LIMIT)
    joined = spread_lookup(asked, ranked, counts, ["qnorm"], F.col("req_id"), "inner")
    return joined.filter(F.col("rank") <= F.col("limit")).select(
        "req_id", "rank", "numero_cal", "nombre_cal", "score"
    )


def suggest_status(requests: DataFrame, min_chars: int = 0) -> DataFrame:
    return requests.select(
        "req_id", checks.status(checks.valid_suggest(F.col("qstr"), F.col("limit"), min_chars)).alias("status")
    )


def answer_counts(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Number of answers per request, 0 where there are none."""
    found = answers.groupBy("req_id").agg(F.count(F.lit(1)).alias("count"))
    return requests.select("req_id").join(found, "req_id", "left").na.fill(0, ["count"])


def street_codes(streets: DataFrame) -> DataFrame:
    """One stored code per normalised code: that of the lowest segment id."""
    return (
        streets.groupBy(tx.norm_code(F.col("numero_cal")).alias("qcode"))
        .agg(F.min_by("numero_cal", "id").alias("by_code"))
    )


def resolve_streets(texts: DataFrame, streets: DataFrame | StreetIndex) -> DataFrame:
    """(q, code) for distinct texts: the street with that code, else the best name."""
    keyed = texts.select("q", tx.norm_code(F.col("q")).alias("qcode"), tx.norm_text(F.col("q")).alias("qnorm"))
    index = indexed(streets)
    codes = street_codes(index.streets) if index.codes is None else index.codes
    looked = settle(keyed.join(codes, "qcode", "left"), "street-texts")
    misses = looked.filter(F.col("by_code").isNull()).select("qnorm").distinct().withColumn("k", F.lit(1))
    named = rank_names(misses, index.names(), 1).select("qnorm", F.col("numero_cal").alias("by_name"))
    return looked.join(named, "qnorm", "left").select(
        "q", F.when(F.col("by_code").isNotNull(), F.col("by_code")).otherwise(F.col("by_name")).alias("code")
    )

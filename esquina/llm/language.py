"""The language of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined: the likelihood of the text under byte-trigram models, the language that the markup
declares, the address suffix, and the prior of the host. Priors are smoothed along host, registered domain and all
pages; they and the weights of the declared language and the suffix are sums over all pages, made by grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from esquina.operators.stage import settle

BUCKETS = 1 << 15
TRAIN_DOCS = 4_000  # labelled documents that the trigram models are counted from, about
MOST_LANGUAGES = 64
TEMPER = 0.1  # weight of a trigram: neighbouring trigrams tell much the same
STRENGTH = 5.0  # pages for which the next wider level of the prior counts
SLACK = 0.5  # added to every count of the declared language and the suffix
LANG_ATTRIBUTE = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased letters and spaces."""
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    raw = np.frombuffer(plain.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return ((three * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # bucket, language

    def scores(self, text: str | None) -> list[float]:
        """Tempered log likelihood of each language; zero without letters."""
        found = trigrams(text or "")
        return (TEMPER * self.logs[found].sum(0)).tolist() if len(found) else [0.0] * len(self.languages)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", limit: int = TRAIN_DOCS) -> TextModel:
    """Trigram counts over about ``limit`` labelled documents, whole texts; the driver gets one sum per language and bucket."""
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (lang_col, "lang"))])
    labelled = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    chosen = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows.count()))) < limit).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    summed = settle(chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    sizes = summed.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in summed.filter(F.col("lang").isin(languages)).toLocalIterator():
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return TextModel(languages, np.log(counts / counts.sum(0)) if languages else counts)


def address(url: Column) -> dict[str, Column]:
    """Host, registered domain (its last two labels) and suffix of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    return {
        "host": host,
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "suffix": F.element_at(labels, -1),
    }


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, url, html, text`` rows with the scores of their text, its posterior alone, and the other evidence."""

    @F.arrow_udf("array<double>")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.scores(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    n = len(model.languages)
    found = pages.select(
        "page_id",
        "url",
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), LANG_ATTRIBUTE, 1)).alias("declared"),
        *[c.alias(k) for k, c in address(F.col("url")).items()],
        scores("text").alias("scores"),
    )
    weights = F.transform("scores", lambda x: F.exp(x - F.array_max("scores")))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    named = found.withColumn("weights", weights)
    return named.select(
        *[c for c in found.columns], *[(F.col("weights")[i] / total).alias(f"p{i}") for i in range(n)]
    )


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """``page_id, url, lang, confidence, text_lang, declared, suffix`` for every row of ``pages``.

    ``pages`` has ``page_id, url, html, text``. A page's own text is left out of the sums it is judged by. Evidence that
    is missing (no text, no declared language, no address) says nothing; with none at all the commonest language is
    given. Ties go to the first language in order. Without any language known ``lang`` is null.
    """
    columns = ["page_id", "url", "lang", "confidence", "text_lang", "declared", "suffix"]
    n = len(model.languages)
    if not n:
        empty = pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
        return empty.select("*", *[F.lit(None).cast("string").alias(c) for c in columns[4:]])
    rows = settle(evidence(pages, model), "page-evidence")
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(n)]
    hosts = rows.groupBy("host", "domain", "suffix").agg(*sums)
    vector = lambda name: F.array(*[f"p{i}" for i in range(n)]).alias(name)
    by_domain = hosts.groupBy("domain").agg(*sums).select(F.col("domain").alias("_domain"), vector("by_domain"))
    by_suffix = hosts.groupBy("suffix").agg(*sums).select(F.col("suffix").alias("_suffix"), vector("by_suffix"))
    known = hosts.select("host", "domain", "suffix", vector("by_host"))
    known = known.join(by_domain, F.col("domain") == F.col("_domain")).join(by_suffix, F.col("suffix") == F.col("_suffix"))
    known = known.select(F.col("host").alias("_host"), "by_host", "by_domain", "by_suffix")
    by_declared = rows.groupBy(F.col("declared").alias("_declared")).agg(*sums).select("_declared", vector("by_declared"))
    everything = rows.agg(*sums).first()
    overall = [float(everything[f"p{i}"] or 0.0) for i in range(n)]
    joined = rows.join(known, F.col("host") == F.col("_host")).join(by_declared, F.col("declared") == F.col("_declared"))

    def less(name: str) -> list[Column]:
        """The sums of the other pages."""
        return [F.greatest(F.col(name)[i] - F.col(f"p{i}"), F.lit(0.0)) for i in range(n)]

    def plus(parts: list[Column]) -> Column:
        return sum(parts[1:], parts[0])

    host, domain, suffix, declared = (less(x) for x in ("by_host", "by_domain", "by_suffix", "by_declared"))
    wide = [(overall[i] + SLACK) / (sum(overall) + n * SLACK) for i in range(n)]
    middle = [(domain[i] + STRENGTH * wide[i]) / (plus(domain) + STRENGTH) for i in range(n)]
    prior = [(host[i] + STRENGTH * middle[i]) / (plus(host) + STRENGTH) for i in range(n)]
    # How often a language has this suffix or declaration; the other half of each ratio is the same for all languages.
    said = [F.when(F.col("declared") != "", F.log((declared[i] + SLACK) / (overall[i] + 2 * SLACK))).otherwise(0.0) for i in range(n)]
    ends = [F.when(F.col("suffix") != "", F.log((suffix[i] + SLACK) / (overall[i] + 2 * SLACK))).otherwise(0.0) for i in range(n)]
    score = [F.col("scores")[i] + F.log(prior[i]) + said[i] + ends[i] for i in range(n)]
    fused = joined.select("page_id", "url", "declared", "suffix", "scores", F.array(*score).alias("fused"))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_position("fused", F.array_max("fused")).cast("int")
    share = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("fused")))
    text_best = F.array_position("scores", F.array_max("scores")).cast("int")
    heard = F.exists("scores", lambda x: x != 0)
    return fused.select(
        "page_id",
        "url",
        F.get(names, best - 1).alias("lang"),
        (1 / share).alias("confidence"),
        F.when(heard, F.get(names, text_best - 1)).alias("text_lang"),
        "declared",
        "suffix",
    )

"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per failed rule;
a policy is a set of rules with a version, applied to stored bits without touching a text again, and the
effect of leaving a rule out comes from a count of bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from esquina.llm.batches import drop_kept

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the struct m of measurements

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "too_few_words", "m.n_words < 50"),
    Rule(1, "repeated_runs", "100 * m.n_repeat_words > 50 * m.n_words"),
    Rule(2, "symbols", "10 * m.n_symbols > m.n_words"),
    Rule(3, "repeated_lines", "2 * m.n_dup_lines > m.n_lines"),
    Rule(4, "short_words", "m.word_chars < 2 * m.n_words"),
    Rule(5, "long_words", "m.word_chars > 40 * m.n_words"),
)
BASE = ("too_few_words", "repeated_runs")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask_of(names: tuple[str, ...]) -> int:
    known = {r.name: r.mask for r in RULES}
    return sum(known[n] for n in set(names))


def measure_text(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one whole text; all zero without text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    plain = text.decode("utf-8", "replace")
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(plain) - sum(plain.count(c) for c in BLANKS),
        sum(plain.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first time included."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 2**20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measured(text: Column) -> Column:
    """A struct with the measurements of a text column."""
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kind = pa.struct([(n, pa.int64()) for n in names])

    @F.arrow_udf(f"struct<{', '.join(f'{n}: long' for n in names)}>")
    def measure(texts: pa.Array) -> pa.Array:
        drop_kept()
        return pa.array([dict(zip(names, measure_text(t.as_py()))) for t in texts], kind)

    return measure(text.cast("binary"))


def failures() -> Column:
    """The failure bits, from the struct ``m`` of measurements."""
    return F.expr("CAST(" + " + ".join(f"IF({r.fails}, {r.mask}, 0)" for r in RULES) + " AS LONG)")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measurements and ``fail_bits``.

    A null or empty text measures zero everywhere and so fails ``too_few_words``. Rows that repeat stay
    repeated, an id may be null, and other columns are not read.
    """
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), measured(F.col(f"`{text_col}`")).alias("m"))
    return found.select("doc_id", "m.*", failures().alias("fail_bits"))


def verdicts(ledger_rows: DataFrame, policy: str = "v2") -> DataFrame:
    """``base_failed`` and ``kept`` of a policy, from the stored bits."""
    base, chosen = mask_of(BASE), mask_of(POLICIES[policy]) | mask_of(BASE)
    return ledger_rows.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(base) != 0,
            "kept": F.col("fail_bits").bitwiseAND(chosen) == 0,
        }
    )


def ablations(ledger_rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone rejects, and those kept without it.

    Only the counts of bit patterns are shuffled, at most 2 to the number of rules; an empty table gives zeros.
    """
    chosen = mask_of(POLICIES[policy])
    patterns = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(chosen).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.mask & chosen]
    rest = {r.name: F.col("bits").bitwiseAND(chosen & ~r.mask) for r in rules}
    sums = {
        r.name: [
            F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a)
            for a, c in (
                ("n_failed", F.col("bits").bitwiseAND(r.mask) != 0),
                ("n_alone", F.col("bits") == r.mask),
                ("n_kept_without", rest[r.name] == 0),
            )
        ]
        for r in rules
    }
    wide = patterns.agg(*[F.struct(F.lit(n).alias("rule"), *s).alias(n) for n, s in sums.items()])
    return wide.select(F.explode(F.array(*sums)).alias("r")).select("r.*")


def keep_good(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all columns as they are. Nothing is shuffled."""
    chosen = mask_of(POLICIES[policy]) | mask_of(BASE)
    m = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measured(m).alias("m"))
    return rows.filter(failures().bitwiseAND(chosen) == 0).select("row.*")

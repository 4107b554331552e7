"""Passages that repeat: spans of documents covered by word windows that start anywhere else too.

All windows of one text whose least run of ``GRAM`` words lies at the same place form a region, so each window is
in exactly one region and equal windows meet under the same run. Regions are the streamed documents and, gathered
by run, the reference shards: each shard gets one suffix automaton with the number of places of every state, through
which its regions are streamed; a window whose state has two places or more is repeated. Shards are sent where their
regions are rather than broadcast, since the reference is the whole corpus and has no size bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from esquina.llm.sketch import mix, word_hashes
from esquina.operators.stage import settle

WINDOW = 35
GRAM = 8
# Different regions of one run up to which they share an automaton; beyond, their windows are counted one by one.
SHARD_REGIONS = 1_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
REGIONS = "doc_id long, row_key long, run long, content long, start int, windows int"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Regions:
    """The regions of texts."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.place = mix((np.arange(2 * window, dtype=np.uint64) + np.uint64(1)) * _STEP)

    def of(self, text: bytes | None) -> tuple[np.ndarray, ...]:
        """Run hash, content hash, first window and number of windows of each region."""
        h = word_hashes(text)
        if len(h) < self.window:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty
        # A polynomial in the hashes of the run's words, mixed once. Runs only gather regions; contents tell them apart.
        runs = np.zeros(len(h) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            runs *= _STEP
            runs += h[j : j + len(runs)]
        runs = mix(runs)
        wide = self.window - self.gram + 1
        views = np.lib.stride_tricks.sliding_window_view(runs, wide)
        least = np.concatenate([v.argmin(1) for v in np.array_split(views, len(views) // 65_536 + 1)])
        at = least + np.arange(len(least))
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at))
        start = np.concatenate(([0], ends[:-1]))
        windows = ends - start
        size = windows + self.window - 1
        first = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(first, size)
        word = np.repeat(start, size) + inside
        off = word - np.repeat(at[start], size) + self.window
        content = np.add.reduceat(mix(h[word] ^ self.place[off]), first)
        content = mix(content ^ mix((windows.astype(np.uint64) << np.uint64(8)) | (at[start] - start).astype(np.uint64)))
        return runs[at[start]].view("i8"), content.view("i8"), start, windows


class SuffixAutomaton:
    """Of several word sequences, with the number of places where the strings of each state end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, steps: dict[bytes, int], link: int) -> int:
        self.next.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.next) - 1

    def _clone(self, at: int, word: bytes, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes], places: int) -> None:
        last = 0
        for w in words:
            target = self.next[last].get(w)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._clone(last, w, target)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                at = last
                while at >= 0 and w not in self.next[at]:
                    self.next[at][w] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.next[at][w]
                    whole = self.length[target] == self.length[at] + 1
                    self.link[new] = target if whole else self._clone(at, w, target)
                last = new
            self.places[last] += places

    def count(self) -> None:
        """Passes the numbers of places on to the shorter strings."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]

    def repeated(self, words: list[bytes], window: int) -> int:
        """Bit i is set if the ``window`` words from i on end in two places or more."""
        state, matched, bits = 0, 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.places[state] > 1:
                bits |= 1 << (i - window + 1)
        return bits


def shard_masks(window: int):
    """For the regions of one run: which windows repeat, for those whose content occurs once."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        automaton, single = SuffixAutomaton(), []
        for doc_id, row_key, start, places, words in zip(*(t.column(c).to_pylist() for c in ("doc_id", "row_key", "start", "places", "words"))):
            split = words.split()
            automaton.add(split, min(places, 2))
            if places == 1:
                single.append((doc_id, row_key, start, split))
        automaton.count()
        rows = [(d, k, s, automaton.repeated(w, window)) for d, k, s, w in single]
        yield span_batch([r for r in rows if r[3]])

    return run


SPANS = "doc_id long, row_key long, start int, mask long"


def span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [])
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "row_key", "start", "mask"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text hash and text, and the whole row beside them. A missing id is -1: rows of equal texts lose the same words anyway."""
    text = F.col(f"`{text_col}`").cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1).cast("long"))
    return docs.select(key.alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"), row.alias("row"))


def region_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Regions(window, gram)
        for b in batches:
            found = [of.of(t.as_py()) for t in b.column("text")]
            size = [len(f[0]) for f in found]
            if not sum(size):
                continue
            which = pa.array(np.repeat(np.arange(len(size)), size))
            parts = [np.concatenate(p) for p in zip(*found)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(p).cast(k) for p, k in zip(parts, kinds)]
            ids = [b.column(c).take(which) for c in ("doc_id", "row_key")]
            yield pa.RecordBatch.from_arrays([*ids, *columns], ["doc_id", "row_key", "run", "content", "start", "windows"])

    return rows.mapInArrow(run, REGIONS)


def region_words(needed: DataFrame, window: int) -> DataFrame:
    """The words of the regions that each text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("text")[i].as_py().split()
                wanted = b.column("wanted")[i].as_py()
                if wanted:
                    cut = [b" ".join(words[w["start"] : w["start"] + w["windows"] + window - 1]) for w in wanted]
                    same = [b.column(c).take(pa.array([i] * len(wanted))) for c in ("doc_id", "row_key")]
                    own = [pa.array([w[c] for w in wanted], k) for c, k in (("run", pa.int64()), ("start", pa.int32()), ("places", pa.int64()), ("windows", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, *own, pa.array(cut, pa.binary())], ["doc_id", "row_key", "run", "start", "places", "windows", "words"])

    some = needed.filter(F.size("wanted") > 0)
    return some.mapInArrow(run, "doc_id long, row_key long, run long, start int, places long, windows int, words binary")


def counted_windows(regions: DataFrame, window: int) -> DataFrame:
    """The masks of regions whose run has too many different ones for one automaton: every window for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            names = ("doc_id", "row_key", "run", "start", "places", "windows", "words")
            for doc_id, row_key, run_, start, places, windows, words in zip(*(b.column(c).to_pylist() for c in names)):
                split = words.split()
                for i in range(windows):
                    rows.append((doc_id, row_key, run_, start, places, i, b" ".join(split[i : i + window])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                names = ["doc_id", "row_key", "run", "start", "places", "i", "words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, row_key long, run long, start int, places long, i int, words binary"
    hashed = regions.mapInArrow(run, schema).withColumn("w1", F.xxhash64("words")).withColumn("w2", F.xxhash64(F.lit(1), "words"))
    # Both sides of the join read them, so they are made once and written.
    each = settle(hashed.drop("words", "run"), "windows")
    again = each.groupBy("w1", "w2").agg(F.sum("places").alias("n")).filter("n > 1").select("w1", "w2")
    marked = each.filter("places = 1").join(again, ["w1", "w2"])
    bit = F.expr("shiftleft(1L, i)")
    return marked.groupBy("doc_id", "row_key", "start").agg(F.bit_or(bit).alias("mask"))


def cut_spans(text: bytes, spans: list[dict], window: int) -> tuple[int, int, bytes]:
    """Words, removed words and the text without them; white space after a removed word goes with it."""
    found = list(WORD.finditer(text))
    edge = np.zeros(len(found) + 1, np.int64)
    for s in spans:
        mask, i = s["mask"], s["start"]
        while mask:
            if mask & 1:
                edge[i] += 1
                edge[i + window] -= 1
            mask, i = mask >> 1, i + 1
    gone = np.cumsum(edge[:-1]) > 0
    ends = [m.start() for m in found[1:]] + [len(text)]
    kept = b"".join(text[m.start() : e] for m, e, g in zip(found, ends, gone.tolist()) if not g)
    return len(found), int(gone.sum()), kept.rstrip(b" \t\n\x0b\x0c\r")


def without_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_regions: int = SHARD_REGIONS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``row, n_words, n_removed, text``: every row of ``docs``, and its text without the words of repeated windows.

    A window is ``window`` consecutive words of one text; it is repeated if the same words start anywhere else,
    in the same text too. Windows are judged on the input. A text that loses nothing stays as it is; null has no
    words and stays null; a row that repeats is a second place of all its windows; rows with one id and different
    texts are told apart. ``shard_regions`` and ``gram`` do not change the result.
    """
    rows = keyed(docs, id_col, text_col)
    shared = settle(shared_regions(region_rows(rows.select("doc_id", "row_key", "text"), window, gram)), "shared-regions")
    open_ = shared.filter("first AND kinds > 1 AND fewest = 1")
    asked = F.struct("run", "start", "windows", "places", "kinds")
    wanted = open_.groupBy(F.col("doc_id").alias("w_id"), F.col("row_key").alias("w_key")).agg(F.collect_list(asked).alias("wanted"))
    texts = rows.repartition("doc_id", "row_key")
    # Plain equality, so that the joins keep the way the texts are dealt.
    same = (F.col("doc_id") == F.col("w_id")) & (F.col("row_key") == F.col("w_key"))
    # Of rows that are wholly equal one is enough here.
    few = texts.join(wanted, same).select("doc_id", "row_key", "text", "wanted").dropDuplicates(["doc_id", "row_key"])
    needed = settle(few, "open-texts")
    return finished(texts.drop("text"), shared, needed, window, shard_regions, text_col)


def shared_regions(regions: DataFrame) -> DataFrame:
    """The regions whose run is found again, in one shuffle and one table.

    ``places``: regions of this run and content; ``first``: one of them stands for all; ``kinds``: contents of the run;
    ``fewest``: the least of their places.
    """
    by_content = Window.partitionBy("run", "content")
    by_run = Window.partitionBy("run")
    place = by_content.orderBy("doc_id", "row_key", "start", "windows")
    counted = (
        # Dealt by run, which serves the windows by run and content too.
        regions.repartition("run")
        .withColumn("first", F.row_number().over(place) == 1)
        .withColumn("places", F.count(F.lit(1)).over(by_content))
        .withColumn("kinds", F.sum(F.col("first").cast("long")).over(by_run))
        .withColumn("fewest", F.min("places").over(by_run))
    )
    return counted.filter("kinds > 1 OR places > 1")


def finished(texts: DataFrame, shared: DataFrame, needed: DataFrame, window: int, shard_regions: int, text_col: str) -> DataFrame:
    """Marks the windows of all regions and cuts them out of ``texts``."""
    small = needed.withColumn("wanted", F.filter("wanted", lambda w: w["kinds"] <= shard_regions))
    large = needed.withColumn("wanted", F.filter("wanted", lambda w: w["kinds"] > shard_regions))
    masks = region_words(small, window).groupBy("run").applyInArrow(shard_masks(window), SPANS)
    more = counted_windows(region_words(large, window), window)
    whole = shared.filter("places > 1").select("doc_id", "row_key", "start", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    spans = masks.unionByName(more).unionByName(whole)
    listed = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("row_key").alias("s_key")).agg(
        F.collect_list(F.struct("start", "mask")).alias("spans")
    )
    same = (F.col("doc_id") == F.col("s_id")) & (F.col("row_key") == F.col("s_key"))
    cut = cut_column(window)
    text = F.col("row").getField(text_col).cast("binary")
    return texts.join(listed, same, "left").select("row", cut(text, "spans").alias("c")).select("row", "c.*")


def cut_column(window: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    @F.arrow_udf("struct<n_words: long, n_removed: long, text: string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for text, listed in zip(texts, spans):
            raw, found = text.as_py(), listed.as_py()
            n, gone, kept = cut_spans(raw, found, window) if found else (len(raw.split()) if raw else 0, 0, raw)
            rows.append({"n_words": n, "n_removed": gone, "text": None if kept is None else kept.decode("utf-8", "replace")})
        return pa.array(rows, kind)

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of every row cut, all other columns as they are."""
    found = without_repeats(docs, window, id_col=id_col, text_col=text_col)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])

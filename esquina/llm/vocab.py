"""Token ids of whole texts by way of their distinct units.

A unit is a stretch of text that the tokenizer certainly treats on its own: a word with the space before it
(byte-level vocabularies) or a word (vocabularies that drop white space). A batch of texts is split into units
in Arrow, only units never seen before are given to the tokenizer, and ids are gathered by unit number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from esquina.llm.batches import kept

# Bytes of units and their ids that a Python worker keeps; it only saves time.
HELD_BYTES = 48 << 20
# Text that is worked on at once, in bytes.
SLICE = 2 << 20
# Places that always separate two matches of the pre-tokenizer: a letter before one of these characters.
LETTER_THEN_SIGN = "([A-Za-zÀ-ɏ])([%*#$&|.,;:!?])"
BLANK = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
# Stands between units while a text is split.
MARK = "\x01"


class Held:
    """Ids of units in two generations of Arrow arrays: a full young one takes the old one's place."""

    def __init__(self, limit: int):
        self.limit = limit // 2
        self.young = self.old = (pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64))

    def get(self, units: pa.Array) -> np.ndarray:
        """For distinct units: their places among the young ones, less than 0 where new."""
        return places(units, self.young[0])

    def promoted(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``units`` the old generation knows, their ids and their sizes."""
        known, flat, ends = self.old
        at = places(units, known)
        return at >= 0, *gathered(flat, ends, at[at >= 0])

    def put(self, units: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        known, before, ends = self.young
        joined = pa.concat_arrays([known, units])
        more = np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
        self.young = (joined, np.concatenate([before, flat]), more)

    def rest(self) -> None:
        """To be called between slices: the young generation grows old when it has its share of bytes."""
        if self.young[0].nbytes + self.young[1].nbytes + self.young[2].nbytes > self.limit:
            self.old = self.young
            self.young = (pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64))


def places(units: pa.Array, known: pa.Array) -> np.ndarray:
    """Where distinct ``units`` stand among the distinct ``known`` ones, -1 where nowhere.

    The few are hashed and the many looked up in them, as a table of the many would be made anew for every slice.
    """
    found = pc.index_in(known, value_set=units)
    at = np.full(len(units), -1, np.int64)
    at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return at


def gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` numbered ``at``, one after another, and their sizes."""
    begin, size = ends[at], ends[at + 1] - ends[at]
    before = np.cumsum(size)
    total = int(before[-1]) if len(before) else 0
    return flat[np.arange(total) + np.repeat(begin - before + size, size)], size


class UnitIds:
    """``spaced``: units carry the space before them. Otherwise white space separates units and is dropped.

    A text that holds the string of a special token, or the mark between units, is given to the tokenizer whole.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([MARK, *special])
        self.spaced = spaced
        self.sign = re.compile("(?<=[A-Za-zÀ-ɏ])(?=[%*#$&|.,;:!?])")
        self.blank = re.compile(r"(?<=\S)(?=[ \n])")
        # Words that may share one call, and what stands between them there.
        self.joinable = re.compile(r" ?\S+" if spaced else r"[^\s\x01]+")
        self.between = "\n" if spaced else f" {MARK} "
        [self.mark] = self._raw(["\n" if spaced else MARK])[0].tolist()
        self.held = Held(HELD_BYTES)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units, one after another, and their sizes."""
        joinable = [i for i, u in enumerate(units) if self.joinable.fullmatch(u)]
        others = np.setdiff1d(np.arange(len(units)), joinable).tolist()
        own = dict(zip(others, self._raw([units[i] for i in others])))
        groups = [joinable[i : i + 64] for i in range(0, len(joinable), 64)]
        runs, sizes = [], np.zeros(len(units), np.int64)
        for group, ids in zip(groups, self._raw([self.between.join([units[i] for i in g]) for g in groups])):
            is_mark = ids == self.mark
            ends = np.r_[np.flatnonzero(is_mark), len(ids)]
            sizes[group] = np.diff(np.r_[-1, ends]) - 1
            runs.append(ids[~is_mark])
        sizes[others] = [len(own[i]) for i in others]
        if not others:
            return np.concatenate([np.empty(0, np.uint32), *runs]), sizes
        flat = np.concatenate([np.empty(0, np.uint32), *runs, *[own[i] for i in others]])
        order = np.array([*joinable, *others], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return gathered(flat, ends, place)[0], sizes

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct units among the young ones, where new ones are put."""
        at = self.held.get(distinct)
        if (at < 0).any():
            missing = distinct.filter(pa.array(at < 0))
            old, flat, sizes = self.held.promoted(missing)
            self.held.put(missing.filter(pa.array(old)), flat, sizes)
            new = missing.filter(pa.array(~old))
            self.held.put(new, *self._learn(new.to_pylist()))
            # Both came behind the ones before, in this order.
            order = np.concatenate([np.flatnonzero(old), np.flatnonzero(~old)])
            at[np.flatnonzero(at < 0)[order]] = len(self.held.young[0]) - len(missing) + np.arange(len(missing))
        return at

    def _ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``units``, one after another, and their sizes."""
        if not len(units):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        coded = units.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy()]
        return gathered(self.held.young[1], self.held.young[2], places)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more than texts). Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, BLANK + BLANK).to_numpy(zero_copy_only=False) & ~whole if self.spaced else np.zeros(len(texts), bool)
        apart = whole | odd
        ids, at = self._split(texts if not apart.any() else pc.if_else(pa.array(apart), "", texts))
        if apart.any():
            own = [ids[i:j] for i, j in zip(at[:-1], at[1:])]
            for i in np.flatnonzero(apart).tolist():
                text = texts[i].as_py()
                if whole[i]:
                    own[i] = self._raw([text])[0]
                else:
                    own[i] = self._ids(pa.array([u for run in self.blank.split(text) for u in self.sign.split(run)], pa.string()))[0]
            ids, at = np.concatenate(own), np.cumsum([0, *map(len, own)])
        self.held.rest()
        return ids, at

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without neighbouring blanks, or whose blanks are dropped anyway."""
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if self.spaced:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{MARK} "), "\n", f"{MARK}\n{MARK}")
            split = pc.split_pattern(pc.replace_substring_regex(marked, LETTER_THEN_SIGN, f"\\1{MARK}\\2"), MARK)
        else:
            split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_THEN_SIGN, r"\1 \2"))
        ids, sizes = self._ids(split.flatten())
        bounds = split.offsets.to_numpy().astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with a ``text`` column in runs of rows of about ``SLICE`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // SLICE
    starts = np.flatnonzero(np.r_[True, np.diff(run) > 0]).tolist() if len(run) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def unit_ids(path: str, spaced: bool) -> UnitIds:
    return kept((path, spaced), lambda: UnitIds(path, spaced))

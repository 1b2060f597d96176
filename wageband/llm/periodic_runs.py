"""Maximal periodic runs of words, found by branching tandem repeats in an enhanced suffix array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from wageband.llm.common import with_arrow_columns

LEAST_LENGTH = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass(frozen=True)
class SuffixArray:
    """Suffixes of a text of whole numbers in order, with what the search for repeats needs.

    ``order`` holds the suffixes' places, ``place`` its inverse, ``common[s]`` the length of the
    longest common prefix of the suffixes at s - 1 and s. ``ranks[k]`` is equal at two places just
    if the 2^k numbers from there on are; all are different in the last one. A suffix needs a
    number that occurs nowhere else behind it, as each document's end is.
    """

    text: np.ndarray
    order: np.ndarray
    place: np.ndarray
    common: np.ndarray
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, text: np.ndarray) -> SuffixArray:
        """By doubling the sorted prefixes; suffixes that are alone in their group stay as they are."""
        n = len(text)
        order = np.argsort(text, kind="stable")
        leads = np.ones(n, bool)
        leads[1:] = text[order[1:]] != text[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(leads, np.arange(n), 0))
        ranks, common, width = [rank], np.zeros(n, np.int64), 1
        slots = np.flatnonzero(~(leads & np.append(leads[1:], True)))
        while len(slots):
            at = order[slots]
            pair = rank[at].astype(np.int64) * n + rank[at + width]
            by_pair = np.argsort(pair, kind="stable")
            at, pair = at[by_pair], pair[by_pair]
            order[slots] = at
            leads = np.ones(len(at), bool)
            leads[1:] = pair[1:] != pair[:-1]
            # Neighbours that part now share at least ``width`` numbers and fewer than twice that.
            apart = np.flatnonzero(leads[1:] & (rank[at[1:]] == rank[at[:-1]])) + 1
            left, right = at[apart - 1] + width, at[apart] + width
            shared = np.full(len(apart), width, np.int64)
            for k in range(len(ranks) - 2, -1, -1):
                step = (ranks[k][left] == ranks[k][right]).astype(np.int64) << k
                left, right, shared = left + step, right + step, shared + step
            common[slots[apart]] = shared
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(leads, np.arange(len(at)), 0))]
            ranks.append(rank)
            slots = slots[~(leads & np.append(leads[1:], True))]
            width *= 2
        return cls(text, order, rank, common, ranks)

    def intervals(self, least: int):
        """(depth, first slot, last slot, cuts) of every group of suffixes that share ``least`` numbers or more.

        ``cuts`` are the slots at which its children but the first begin.
        """
        slots = np.flatnonzero(self.common >= least)
        depths = self.common[slots].tolist()
        open_, before = [], -1
        for slot, depth in zip(slots.tolist(), depths):
            if slot != before + 1:
                while open_:
                    deep, first, cuts = open_.pop()
                    yield deep, first, before, cuts
            first = slot - 1
            while open_ and open_[-1][0] > depth:
                deep, first, cuts = open_.pop()
                yield deep, first, slot - 1, cuts
            if open_ and open_[-1][0] == depth:
                open_[-1][2].append(slot)
            else:
                open_.append((depth, first, [slot]))
            before = slot
        while open_:
            deep, first, cuts = open_.pop()
            yield deep, first, before, cuts

    def branching_tandems(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and half lengths, ``least`` or more, of all squares that the next number does not go on.

        Of each interval, only the suffixes outside its largest child are asked whether the suffix
        one depth further on, or back, is in the interval too, under another child.
        """
        asked = []
        for depth, first, last, cuts in self.intervals(least):
            begins, ends = [first, *cuts], [*[c - 1 for c in cuts], last]
            largest = max(range(len(begins)), key=lambda c: ends[c] - begins[c])
            asked += [(begins[c], ends[c], first, last, depth) for c in range(len(begins)) if c != largest]
        if not asked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, end, first, last, depth = np.array(asked, np.int64).T
        size = end - begin + 1
        child = np.repeat(np.arange(len(size)), size)
        slot = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + begin[child]
        at, depth, first, last = self.order[slot], depth[child], first[child], last[child]

        def squares(start, other, known):
            start, other, depth_, lo, hi = start[known], other[known], depth[known], first[known], last[known]
            inside = (self.place[other] >= lo) & (self.place[other] <= hi)
            start, depth_ = start[inside], depth_[inside]
            ends = self.text[start + depth_] != self.text[start + 2 * depth_]
            return start[ends], depth_[ends]

        ahead = squares(at, at + depth, np.ones(len(at), bool))
        back = squares(at - depth, at - depth, at >= depth)
        return np.concatenate([ahead[0], back[0]]), np.concatenate([ahead[1], back[1]])

    def runs(self, least_length: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of every maximal run of ``least_length`` or more, in order.

        Only squares of a certain size are looked for: a run with a shorter period has one of a
        multiple of it. Each square is rotated to the left as far as it goes, which is the start of
        its run, and squares of the same run become one.
        """
        least = least_length // 2 // 2 + 1
        at, period = self.branching_tandems(least)
        start = at.astype(np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            back = start - (1 << k)
            same = back >= 0
            same[same] = self.ranks[k][back[same]] == self.ranks[k][back[same] + period[same]]
            start = np.where(same, back, start)
        end = at + 2 * period
        long = end - start >= least_length
        start, end, period = start[long], end[long], period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        once = np.ones(len(start), bool)
        once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[once], end[once], period[once]
        for i in np.flatnonzero(period < 2 * least):
            root = self.text[start[i]:start[i] + period[i]]
            period[i] = next((q for q in range(1, least) if period[i] % q == 0
                              and (root[q:] == root[:-q]).all()), period[i])
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def runs_of(texts: list[str | None], least_length: int = LEAST_LENGTH) -> tuple[list, list]:
    """Per text its runs as (start, length, period) and the text of the words left by them.

    One suffix array holds all the texts: words are numbered anew in each, so texts never meet.
    """
    words = [(t or "").encode("utf-8").split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for doc in words for w in doc),
                       np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes + 1) - sizes - 1
    # Each text ends in a number of its own.
    coded = np.full(int((sizes + 1).sum()), len(numbers), np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    coded[np.arange(len(flat)) + doc] = flat
    coded += np.repeat(np.arange(len(words)), sizes + 1) * (len(numbers) + 1)
    start, end, period = SuffixArray.of(coded).runs(least_length)

    late = np.zeros(len(coded) + 1, np.int64)
    np.add.at(late, start + period, 1)
    np.add.at(late, end, -1)
    gone = np.cumsum(late) > 0
    owner = np.searchsorted(begins, start, side="right") - 1
    runs: list[list] = [[] for _ in words]
    for d, s, e, p in zip(owner.tolist(), start.tolist(), end.tolist(), period.tolist()):
        runs[d].append({"start": s - int(begins[d]), "length": e - s, "period": p})
    left = []
    for d, doc_words in enumerate(words):
        if runs[d]:
            dropped = gone[begins[d]:begins[d] + sizes[d]].tolist()
            doc_words = [w for w, out in zip(doc_words, dropped) if not out]
        left.append(b" ".join(doc_words).decode("utf-8"))
    return runs, left


def with_runs(df: DataFrame, text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``df`` with ``runs``, the periodic runs of its words, and ``collapsed``, the text without them.

    Words are runs of characters other than ASCII blanks, numbered from 0. A run is a stretch of
    words with smallest period q (words q apart are equal), at least ``least_length`` and 2q long,
    that neither neighbour extends. ``runs`` holds their start, length and period by start, then
    period. ``collapsed`` joins by one space the words that are in no run, or only in the first q of
    those they are in.

    A null, empty or blank text has no words: no runs and an empty ``collapsed``. Each row is worked
    on alone, so ties and repeated rows get equal results and no row is dropped; an empty table
    gives no rows. A task holds a few megabytes of text at once, or one longer text: about 4 bytes a
    word for each doubling of its longest repeat. Result columns replace input columns of the same
    name; ``text`` must not be one of them.
    """
    return with_arrow_columns(df, text, {"runs": RUNS, "collapsed": "string"},
                              lambda: lambda texts: list(runs_of(texts, least_length)))

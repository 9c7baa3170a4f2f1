"""Runs of words that repeat with a period, found by uniting suffixes from the longest shared prefix down.

A *run* is a stretch of consecutive words with a smallest period q (words q apart are the
same) that no neighbouring word extends. Runs of at least ``least`` words and ``times``
periods are found, block of documents by block:

1. Suffixes of a block are sorted within their document by doubling: ranks of 2k words are
   made from the ranks of k words. Only suffixes whose rank is shared go on. The ranks of
   each step give the longest common prefix (LCP) of neighbours.
2. A run of length L and period q has an LCP of L - q between its first place and the one a
   period later. So the suffixes that share the fewest words such an LCP may have form
   classes; a class whose largest LCP isn't ``times - 1`` times its smallest gap holds no run.
3. In the other classes, suffixes are united by decreasing LCP (as Kruskal's algorithm takes
   edges) by union-find, each class with its positions in order, the smaller moving into
   the larger. Positions that become neighbours and lie no further apart than the LCP seed a
   run, whose period is their distance and whose length is the LCP and the distance. That
   distance is the smallest period: with a smaller one, a position between them would have
   been there before. Seeds that the word before extends are not a run's first place.

Documents don't influence each other, so blocks are whole documents and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import small_batches, texts_of

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def sorted_suffixes(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes by document and words, and the ranks by their first 1, 2, 4... words.

    ``words`` are positive numbers, ``doc`` numbers the document of each word. A rank is the
    place in the order of the first suffix that shares it, from 1 on; 0 stands for the end of
    a document. Suffixes that end sooner come first.
    """
    n = len(words)
    last = np.append(doc[1:] != doc[:-1], True) if n else np.empty(0, bool)
    end = np.flatnonzero(last)[np.cumsum(last) - last] + 1 if n else np.empty(0, np.int64)

    def later(values: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        there = places + k
        inside = there < end[places]
        return np.where(inside, values[np.where(inside, there, 0)], 0)

    order = np.lexsort((words, doc))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    levels, k = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order, levels
        own = order[slots]
        first, second = rank[own], later(rank, own, k)
        inner = np.argsort(first * (n + 1) + second, kind="stable")  # n < 2^31
        own, first, second = own[inner], first[inner], second[inner]
        order = order.copy()
        order[slots] = own
        split = np.ones(len(own), bool)
        split[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new = np.ones(n, bool)
        new[slots] = split
        rank = rank.copy()
        rank[own] = slots[np.flatnonzero(split)[np.cumsum(split) - 1]] + 1
        levels.append(rank)
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the order whose suffix shares ``least`` words and more with the one before, and how many."""
    rank = levels[min(int(least).bit_length() - 1, len(levels) - 1)]
    slots = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) + 1
    one, two = order[slots - 1], order[slots]
    shared = np.zeros(len(slots), np.int64)
    n = len(doc)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        a, b = one + shared, two + shared
        inside = (a < n) & (b < n)
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        same = inside & (doc[a] == doc[one]) & (doc[b] == doc[two]) & (rank[a] == rank[b])
        shared += same << level
    keep = shared >= least
    return slots[keep], shared[keep]


def _promising(order: np.ndarray, slots: np.ndarray, shared: np.ndarray, times: int) -> np.ndarray:
    """Which of the neighbours in the order are in a class that may hold a run."""
    new = np.ones(len(slots), bool)
    new[1:] = slots[1:] != slots[:-1] + 1
    edge_class = np.cumsum(new) - 1
    place = np.concatenate((order[slots], order[slots[new] - 1]))
    member_class = np.concatenate((edge_class, np.arange(new.sum())))
    by = np.lexsort((place, member_class))
    place, member_class = place[by], member_class[by]
    gap = np.full(len(place), np.iinfo(np.int64).max >> 8)
    same = member_class[1:] == member_class[:-1]
    gap[1:][same] = (place[1:] - place[:-1])[same]
    smallest = np.minimum.reduceat(gap, np.flatnonzero(np.append(True, ~same)))
    largest = np.maximum.reduceat(shared, np.flatnonzero(new))
    return (largest >= (times - 1) * smallest)[edge_class]


def runs_of(words: np.ndarray, doc: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs of a block of documents, in order; words count through the block."""
    none = np.empty(0, np.int64)
    if len(words) < least:
        return none, none, none
    order, levels = sorted_suffixes(words, doc)
    # L >= max(least, times * q) leaves an LCP of L - q, smallest at the q where both bounds meet or just beside it
    fewest = min(max(least, times * q) - q for q in range(1, least + 1))
    slots, shared = common_prefixes(order, levels, doc, max(1, fewest))
    if not len(slots):
        return none, none, none
    keep = _promising(order, slots, shared, times)
    slots, shared = slots[keep], shared[keep]
    by = np.argsort(-shared, kind="stable")
    edges = zip(order[slots[by] - 1].tolist(), order[slots[by]].tolist(), shared[by].tolist())
    parent: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    seeds: list[tuple[int, int, int]] = []
    ratio = times - 1
    for a, b, lcp in edges:
        for x in (a, b):
            if x not in parent:
                parent[x], places[x] = x, [x]
        one, two = find(a), find(b)
        large, small = places[one], places[two]
        if len(large) < len(small):
            one, two, large, small = two, one, small, large
        parent[two] = one
        del places[two]
        reach = lcp // ratio  # the largest period that an LCP of this length allows
        slots_of = [bisect_left(large, x) for x in small]
        after = [*slots_of[1:], len(large) + 1]
        before = -1
        for x, at, next_at in zip(small, slots_of, after):
            if before < at and at and x - large[at - 1] <= reach:
                seeds.append((large[at - 1], lcp, x - large[at - 1]))
            if at < next_at and at < len(large) and large[at] - x <= reach:
                seeds.append((x, lcp, large[at] - x))
            before = at
        for x in small:
            insort(large, x)
    if not seeds:
        return none, none, none
    start, lcp, period = np.array(seeds, np.int64).T
    before = np.maximum(start - 1, 0)
    extended = (start > 0) & (doc[before] == doc[start]) & (words[before] == words[before + period])
    keep = ~extended & (lcp + period >= least)
    start, length, period = start[keep], (lcp + period)[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, their numbers (the same word, the same number), and their documents."""
    words = [_WORD.findall(t) for t in texts]
    known: dict[bytes, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known) + 1) for ws in words for w in ws), np.int64)
    return words, numbers, np.repeat(np.arange(len(words)), list(map(len, words)))


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words outside the repetitions, joined by one space: a run keeps its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    stay = np.cumsum(gone[:-1]) == 0
    return b" ".join([w for w, s in zip(words, stay.tolist()) if s])


def detect(docs: DataFrame, times: int = 4, least: int = 6, block: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, runs, top, collapsed) of each row of ``docs`` (doc_id, text).

    ``runs`` are structs (start, length, period) in words, by start, then period; ``top`` is
    the run with the greatest exact length / period, ties by start, then period, null without
    runs; ``collapsed`` is the text's words joined by one space, without those that any run
    holds after its first period.

    A null or empty text has no words, no runs and an empty collapsed text; a null doc_id
    stays. Repeated rows are judged one by one; extra columns are ignored; an empty table
    gives no rows. A block holds about ``block`` bytes of text, or one longer text.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", block):
            data, at = texts_of(batch.column("text"))
            view = memoryview(data)
            words, numbers, doc = _numbered([bytes(view[a:b]) for a, b in zip(at[:-1], at[1:])])
            start, length, period = runs_of(numbers, doc, times, least)
            size = np.fromiter(map(len, words), np.int64, len(words))
            first = np.cumsum(size) - size
            of = doc[start] if len(start) else np.empty(0, np.int64)
            cut = np.searchsorted(of, np.arange(len(words) + 1))
            start = start - first[of]
            runs, tops, texts = [], [], []
            for i, own in enumerate(words):
                part = slice(cut[i], cut[i + 1])
                found = list(zip(start[part].tolist(), length[part].tolist(), period[part].tolist()))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                tops.append(best and dict(zip(("start", "length", "period"), best)))
                texts.append(_kept(own, start[part], length[part], period[part]) if found else b" ".join(own))
            kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": size, "runs": pa.array(runs, pa.list_(kind)),
                "top": pa.array(tops, kind), "collapsed": pa.array(texts, pa.binary()).cast(pa.string()),
            })

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, top {_RUN}, collapsed string"
    )

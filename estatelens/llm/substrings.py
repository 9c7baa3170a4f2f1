"""Substring dedup: word windows that a document with a smaller doc_id has too.

1. Runs. Every window of ``length`` words is put to the word 4-gram inside it with the
   smallest name. Windows that follow each other mostly share the place of that gram; such
   a run travels as one row. Equal windows choose equal grams.
2. Shards. Rows are dealt by gram, and those whose gram only one document has are dropped.
   Grams that make up more than ``SHARE`` of all are found beforehand and chosen last, so
   that a window chooses one only inside a passage made of such grams; their rows are dealt
   evenly and all kept. Such passages are alike in all their copies, and what is alike in a
   run becomes one row by partial aggregates before it meets in a shard.
3. Index and search. The distinct runs of a shard, as words, get a compressed FM-index in
   blocks of whole grams. They are then streamed through it: backward search over its
   wavelet matrix gives the matching statistics of every place, and where those reach
   ``length``, the matching rows give the smallest doc_id that has the window.
4. Intervals of windows whose smallest doc_id is below a document's own are joined back to
   the documents, and their words removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, finish, small_batches, texts_of, whole_groups
from estatelens.llm.fm_index import FMIndex
from estatelens.llm.suffix_dedup import _range_names, least_of, names

GRAM = 4
SHARE = 1 / 20_000  # of all grams: above it a gram is frequent, so there are at most 20,000 such grams
_LOCAL = 8  # a gram counts towards the frequent ones of a block of text if it stands there so often
_BLOCK = 2 << 20
_WORDS = 1 << 16
_BYTE, _NAME = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PLACE = 64  # a row's place holds the first window and how many follow
_TOP = np.uint64(1 << 63)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a block of texts begin and end, and where each text's words start among them."""
    low, high = int(offsets[0]), int(offsets[-1])
    own = data[low:high]
    solid = (own != 32) & ((own < 9) | (own > 13))
    starts_text = np.zeros(len(own) + 1, bool)
    starts_text[offsets - low] = True
    begin = np.flatnonzero(solid & (starts_text[:-1] | ~np.concatenate(([False], solid[:-1]))))
    end = np.flatnonzero(solid & (starts_text[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return begin + low, end + low, np.searchsorted(begin, offsets - low)


def word_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words."""
    size = end - begin
    powers = np.cumprod(np.full(size.max(initial=1), _BYTE, np.uint64))
    out = np.empty(len(begin), np.uint64)
    for at in range(0, len(begin), _WORDS):
        part = size[at : at + _WORDS]
        first = np.cumsum(part) - part
        within = np.arange(part.sum()) - np.repeat(first, part)
        values = data[np.repeat(begin[at : at + _WORDS], part) + within].astype(np.uint64) + np.uint64(1)
        out[at : at + _WORDS] = finish(np.add.reduceat(values * powers[within], first))
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the word grams of a block, the text of each word, and the number of its first word."""
    begin, end, first = word_places(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(begin) < GRAM:
        return np.empty(0, np.uint64), text, first
    return names(word_names(data, begin, end), 1, GRAM, _NAME), text, first


def frequent_grams(docs: DataFrame, share: float = SHARE) -> np.ndarray:
    """Sorted halved names of the grams that make up more than ``share`` of all, at most 1 / share.

    Blocks of text report grams that stand ``_LOCAL`` times in them, so a few occurrences
    may go uncounted. Which grams are frequent decides how rows travel, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", _BLOCK):
            grams, text, _ = _grams(*texts_of(batch.column("text")))
            inside = grams[text[: len(grams)] == text[GRAM - 1 :]] if len(grams) else grams
            values, count = np.unique(inside >> np.uint64(1), return_counts=True)
            often = count >= _LOCAL
            yield pa.record_batch({
                "gram": np.append(values[often].view(np.int64), -1), "n": np.append(count[often], len(inside)),
            })

    counts = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.where("gram = -1").select(F.col("n").alias("total"))
    often = counts.where("gram >= 0").join(F.broadcast(total), F.col("n") > F.lit(share) * F.col("total"))
    return np.sort(np.array([r.gram for r in often.select("gram").collect()], np.int64)).view(np.uint64)


def runs_of_block(data: np.ndarray, offsets: np.ndarray, length: int, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, gram and name of the whole of each run; frequent grams have the top bit."""
    none = np.empty(0, np.int64)
    grams, text, first = _grams(data, offsets)
    n = len(text) - length + 1
    if n < 1:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    value = grams >> np.uint64(1)
    if len(frequent):
        slot = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        value = value | np.where(frequent[slot] == value, _TOP, np.uint64(0))
    least = least_of(value, length - GRAM + 1)
    valid = text[:n] == text[length - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (text[1:n] != text[: n - 1]) | (least[1:] != least[:-1]) | (value[: n - 1] == least[:-1])
    places = np.flatnonzero(valid)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(np.searchsorted(places, begin), len(places)))
    whole = _range_names(grams, GRAM, begin, begin + count - 1 + length)
    return text[begin], begin - first[text[begin]], count, least[begin], whole


def _runs(docs: DataFrame, length: int, frequent: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", _BLOCK):
            row, pos, count, gram, whole = runs_of_block(*texts_of(batch.column("text")), length, frequent)
            row = pa.array(row)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(row), "body": batch.column("body").take(row),
                "place": pos * _PLACE + count, "gram": gram.view(np.int64), "whole": whole.view(np.int64),
            })

    return docs.mapInArrow(run, "doc_id bigint, body bigint, place bigint, gram bigint, whole bigint")


def _shared(runs: DataFrame) -> DataFrame:
    """Runs whose gram stands in several documents, and all runs with a frequent gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted: frequent grams are negative and come first
            cut = int(np.searchsorted(batch.column("gram").to_numpy(), 0))
            if cut:
                yield batch.slice(0, cut)
            if cut < batch.num_rows:
                rare = chain([batch.slice(cut)], batches)
                break
        else:
            return
        for table in whole_groups(rare, ["gram"], 1 << 16):
            gram, doc = table.column("gram").to_numpy(), table.column("doc_id").to_numpy()
            new = np.append(True, gram[1:] != gram[:-1])
            starts = np.flatnonzero(new)
            several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
            keep = table.filter(pa.array(several[np.cumsum(new) - 1]))
            yield from keep.combine_chunks().to_batches()

    evenly = F.when(F.col("gram") < 0, F.xxhash64("doc_id", "place")).otherwise(F.col("gram"))
    return runs.repartition(evenly).sortWithinPartitions("gram").mapInArrow(run, runs.schema)


def _texts(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(gram, whole, owner, text): the words of one run of each class, and the smallest doc_id that has it."""
    asked = classes.groupBy("doc_id", "body").agg(F.collect_list(F.struct("gram", "whole", "place")).alias("asked"))
    asked = asked.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "asked")
    found = docs.join(asked, (docs.doc_id == asked._id) & (docs.body == asked._body)).dropDuplicates(["doc_id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", _BLOCK):
            data, offsets = texts_of(batch.column("text"))
            begin, end, first = word_places(data, offsets)
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            gram, whole, place = asked.flatten().flatten()
            at = first[row] + place.to_numpy() // _PLACE
            a, b = begin[at], end[at + place.to_numpy() % _PLACE + length - 2]
            view = memoryview(data)
            yield pa.record_batch({
                "gram": gram, "whole": whole, "owner": batch.column("doc_id").take(pa.array(row)),
                "text": pa.array([view[i:j] for i, j in zip(a.tolist(), b.tolist())], pa.binary()),
            })

    return found.select("doc_id", "text", "asked").mapInArrow(
        run, "gram bigint, whole bigint, owner bigint, text binary"
    )


def _matched(texts: DataFrame, length: int) -> DataFrame:
    """(gram, whole, at, n, least_id): windows of each class, and the smallest doc_id that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram"], 10_000):
            known: dict[bytes, int] = {}
            words = [_WORD.findall(t) for t in table.column("text").to_pylist()]
            flat = np.fromiter((known.setdefault(w, len(known) + 1) for ws in words for w in ws), np.int64)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            index = FMIndex(flat, sizes, length)
            least = index.least(table.column("owner").to_numpy())
            reach, row = index.matching_statistics(flat, sizes)
            window = np.flatnonzero(reach == length)
            owner = least[index.classes(length)[0][row[window]]]
            text = np.repeat(np.arange(len(sizes)), sizes)[window]
            new = np.ones(len(window), bool)
            new[1:] = (text[1:] != text[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(new)
            of = pa.array(text[begin])
            yield pa.record_batch({
                "gram": table.column("gram").take(of).combine_chunks(), "whole": table.column("whole").take(of).combine_chunks(),
                "at": window[begin] - (np.cumsum(sizes) - sizes)[text[begin]],
                "n": np.diff(np.append(begin, len(window))), "least_id": owner[begin],
            })

    dealt = texts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram bigint, whole bigint, at bigint, n bigint, least_id bigint")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"))


def repeated(docs: DataFrame, length: int = 13, share: float = SHARE) -> DataFrame:
    """(doc_id, body, pos, n, least_id): n windows from word pos on that document least_id < doc_id has too.

    ``body`` is a hash of the text. least_id is the smallest doc_id with that window.
    """
    if not GRAM <= length <= GRAM + _PLACE - 2:
        raise ValueError(f"length must lie between {GRAM} and {GRAM + _PLACE - 2}")
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = _rows(docs).where("doc_id is not null")
    frequent = frequent_grams(rows, share)
    shared = scratch.table(_shared(_runs(rows, length, frequent)), "shared")
    classes = shared.groupBy("gram", "whole").agg(F.min(F.struct("doc_id", "body", "place")).alias("one"))
    texts = scratch.table(_texts(rows, classes.select("gram", "whole", "one.*"), length), "texts")
    matched = scratch.table(_matched(texts, length), "matched")
    scratch.drop("texts")
    found = shared.join(matched, ["gram", "whole"]).where("least_id < doc_id")
    pos = F.floor(F.col("place") / _PLACE) + F.col("at")
    return found.select("doc_id", "body", pos.alias("pos"), "n", "least_id")


def remove_repeats(docs: DataFrame, length: int = 13, share: float = SHARE) -> DataFrame:
    """Every row of ``docs`` without the words that a document with a smaller doc_id has in the same window.

    Columns: doc_id, n_words, n_removed, kept (the other words, joined by one space), spans
    (array of (start, end) in words, maximal removed runs). A word goes if any of the windows
    of ``length`` words that cover it also starts in a document with a smaller doc_id; windows
    are judged on the input.

    A null or empty text has no words. A null doc_id is neither smaller nor larger than
    another: such rows lose nothing and cause no loss. Rows that repeat a doc_id don't affect
    each other. Extra columns are ignored; an empty table gives no rows.
    """
    found = repeated(docs, length, share).groupBy("doc_id", "body").agg(
        F.collect_set(F.struct("pos", "n")).alias("windows")  # a set, as repeated rows have the same windows
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "windows")
    rows = _rows(docs)
    joined = rows.join(found, (rows.doc_id == found._id) & (rows.body == found._body), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", _BLOCK):
            data, offsets = texts_of(batch.column("text"))
            view = memoryview(data)
            windows = batch.column("windows")
            has, place = windows.is_valid().to_numpy(False), windows.offsets.to_numpy()
            pos, n = (x.to_numpy() for x in windows.values.flatten())
            kept, spans, total, removed = [], [], [], []
            for i in range(batch.num_rows):
                words = _WORD.findall(view[offsets[i] : offsets[i + 1]])
                total.append(len(words))
                own: list[tuple[int, int]] = []
                if has[i]:
                    part = slice(place[i], place[i + 1])
                    covered = np.zeros(len(words) + 1, np.int64)
                    np.add.at(covered, pos[part], 1)
                    np.add.at(covered, pos[part] + n[part] + length - 1, -1)
                    gone = np.cumsum(covered) > 0  # the last one is false
                    edges = np.flatnonzero(np.diff(gone, prepend=False))
                    own = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                removed.append(total[-1] - len(words))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b" ".join(words))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })

    return joined.select("doc_id", "text", "windows").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>"
    )

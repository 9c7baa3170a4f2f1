"""Repeated byte strings: bucket refinement over the suffixes of all documents.

A suffix of ``length`` bytes is a *window*. Windows are put into buckets and
buckets are refined by the identifiers of buckets at later offsets until only
equal windows share one:

1. Initial buckets. Every window is put into the bucket of one q-gram inside
   it, the one with the smallest name. The choice depends on the window's bytes
   alone, so equal windows meet. Names are made by doubling: the name of a
   2n-gram is built from the names of the n-grams at offsets 0 and n. Windows
   that follow each other mostly share a q-gram, so a bucket holds *runs*, about
   one for 140 bytes. Runs alone in their bucket hold no repeated window.
2. First refinement. Runs of a bucket are divided by the name of their whole
   text, from the first byte of the first window to the last of the last. A
   class with two runs is settled: all its windows repeat.
3. Second refinement. Only buckets with several classes go on, and with one run
   of each class, as the updated bucket stands for all its members. Their
   windows are sorted by names of ``length`` bytes, which are doubled from
   those of the q-grams. Equal neighbours repeat.

A bucket with more than ``large`` classes is not brought together in one task.
Its runs are cut into parts of up to 16 windows at fixed places of the q-gram in
the window. The bytes that all windows of a part share, its core, make a finer
bucket, and parts are refined as runs are: those alone in their bucket end, those
whose whole text repeats are settled, and one of each class of the rest is cut
again, at last into single windows. A window in the middle of a passage or outside
it thus costs a sixteenth of a row, and only the ends of passages cost more.
Names have 64 bits; the q-gram's name and the window's name have to agree, both
taken from different mixes.

The same works on words instead of bytes: a text is then the sequence of the names
of its words, and ``length`` and ``q`` count words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, finish, texts_of, whole_groups

_BYTE, _GRAM, _WINDOW, _TEXT = (
    0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
)
_RUN = "doc_id bigint, body bigint, pos bigint, n bigint, gram bigint, whole bigint"
_PART = (
    "gram bigint, core bigint, whole bigint, doc_id bigint, body bigint, at bigint, pos bigint, n bigint, single boolean"
)


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; ASCII white space stands between them."""
    solid = np.zeros(len(text) + 2, np.int8)
    solid[1:-1] = (text != 32) & ((text < 9) | (text > 13))
    edges = np.diff(solid)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def elements(text: np.ndarray, words: bool) -> np.ndarray:
    """The bytes of a text, or the names of its words."""
    if not words:
        return text
    begin, end = word_bounds(text)
    if not len(begin):
        return np.empty(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(first, size)
    powers = np.cumprod(np.full(size.max(), _BYTE, np.uint64))
    values = text[np.repeat(begin, size) + within].astype(np.uint64) + np.uint64(1)
    return finish(np.add.reduceat(values * powers[within], first))


def names(first: np.ndarray, have: int, want: int, multiplier: int) -> np.ndarray:
    """Names of ``want`` elements from names of ``have``: each step joins the names at two offsets."""
    while have < want:
        step = min(have, want - have)
        first = finish(first[: len(first) - step] * np.uint64(multiplier) + first[step:])
        multiplier = (multiplier * 0x2545F4914F6CDD1D + 2) % (1 << 64)
        have += step
    return first


def gram_names(data: np.ndarray, q: int) -> np.ndarray:
    return names(finish((data.astype(np.uint64) + np.uint64(1)) * np.uint64(_BYTE)), 1, q, _GRAM)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every ``width`` consecutive ones."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def _range_names(grams: np.ndarray, q: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of [begin, end), each at least q long, by sparse doubling over the q-gram names.

    A range is covered by two overlapping blocks of the largest doubled length
    that fits, and named by both and its length.
    """
    out = np.zeros(len(begin), np.uint64)
    length, level, have = end - begin, grams, q
    while True:
        fits = (length >= have) & (length < 2 * have)
        joined = level[begin[fits]] * np.uint64(_TEXT) + level[end[fits] - have]
        out[fits] = finish(joined * np.uint64(_WINDOW) + length[fits].astype(np.uint64))
        if not (length >= 2 * have).any():
            return out
        level = finish(level[: len(level) - have] * np.uint64(_TEXT) + level[have:])
        have *= 2


def runs_of(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a q-gram: first window, number, q-gram name, name of the whole.

    They share the same place of it, the first in each window: a run also ends
    where its q-gram leaves the window and comes again.
    """
    grams = gram_names(data, q)
    least = least_of(grams, length - q + 1)
    left = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    begin = np.flatnonzero(np.concatenate(([True], left)))
    end = np.concatenate((begin[1:], [len(least)]))
    return begin, end - begin, least[begin], _range_names(grams, q, begin, end - 1 + length)


def _runs(docs: DataFrame, length: int, q: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column("text"))
            rows, parts = [], []
            for i in range(batch.num_rows):
                own = elements(data[at[i] : at[i + 1]], words)
                if len(own) >= length:
                    parts.append(runs_of(own, length, q))
                    rows.append(i)
            if not rows:
                continue
            row = pa.array(np.repeat(rows, [len(p[0]) for p in parts]))
            pos, n, gram, whole = (np.concatenate(x) for x in zip(*parts))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(row), "body": batch.column("body").take(row),
                "pos": pos.astype(np.int64), "n": n.astype(np.int64),
                "gram": gram.view(np.int64), "whole": whole.view(np.int64),
            })

    return docs.mapInArrow(run, _RUN)


def _texts_of_runs(docs: DataFrame, runs: DataFrame, length: int, words: bool) -> DataFrame:
    """The runs with the bytes, or the names of the words, that their windows cover."""
    asked = runs.groupBy("doc_id", "body").agg(
        F.collect_list(F.struct("gram", "pos", "n", "single")).alias("asked")
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "asked")
    found = docs.join(asked, docs.doc_id.eqNullSafe(asked._id) & (docs.body == asked._body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column("text"))
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            gram, pos, n, single = asked.flatten().flatten()
            own = [elements(data[a:b], words) for a, b in zip(at[:-1], at[1:])]
            begin = pos.to_numpy()
            end = begin + n.to_numpy() - 1 + length
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "body": batch.column("body").take(pa.array(row)),
                "gram": gram, "pos": pos, "n": n, "single": single,
                "bytes": pa.array([own[i][a:b].tobytes() for i, a, b in zip(row, begin, end)], pa.binary()),
            })

    return found.select("doc_id", "body", "text", "asked").mapInArrow(
        run, "doc_id bigint, body bigint, gram bigint, pos bigint, n bigint, single boolean, bytes binary"
    )


def _joined(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all texts and where each text begins and ends among them."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    return (data.view(np.uint64), at // 8) if words else (data, at)


def _names_of(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all ``length`` consecutive elements, other ones than those of q-grams if there are over 100."""
    return names(gram_names(data, 100), 100, length, _WINDOW) if length > 100 else gram_names(data, length)


def _window_names(column: pa.Array, length: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Names of all windows of the texts, one text after the other, and the text of each."""
    data, at = _joined(column, words)
    of_all = _names_of(data, length)
    count = np.diff(at) - length + 1
    text = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return of_all[np.arange(count.sum()) - first[text] + at[text]], text


def _same_windows(runs: DataFrame, length: int, words: bool) -> DataFrame:
    """Windows that repeat within a bucket; all runs of a bucket are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram"], 2000):
            table = table.combine_chunks()
            name, text = _window_names(table.column("bytes").chunk(0), length, words)
            gram = table.column("gram").to_numpy().view(np.uint64)[text]
            order = np.lexsort((name, gram))
            same = (name[order][1:] == name[order][:-1]) & (gram[order][1:] == gram[order][:-1])
            repeats = np.zeros(len(name), bool)
            repeats[order[1:][same]] = repeats[order[:-1][same]] = True
            repeats &= table.column("single").to_numpy()[text]
            yield _marks(table, text, repeats)

    dealt = runs.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "doc_id bigint, body bigint, pos bigint, n bigint")


def _marks(table: pa.Table, text: np.ndarray, repeats: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows that repeat, by document."""
    first = np.concatenate(([True], text[1:] != text[:-1]))
    within = np.arange(len(text)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    begin = np.flatnonzero(repeats & (first | ~np.concatenate(([False], repeats[:-1]))))
    last = np.concatenate((first[1:], [True]))
    end = np.flatnonzero(repeats & (last | ~np.concatenate((repeats[1:], [False]))))
    row = pa.array(text[begin])
    pos = table.column("pos").to_numpy()[text[begin]] + within[begin]
    return pa.record_batch({
        "doc_id": table.column("doc_id").take(row).combine_chunks(),
        "body": table.column("body").take(row).combine_chunks(),
        "pos": pos.astype(np.int64), "n": (end - begin + 1).astype(np.int64),
    })


def _parts(asked: DataFrame, length: int, q: int, width: int, words: bool) -> DataFrame:
    """The asked runs of windows, cut where the q-gram's place in the window is a multiple of ``width``.

    ``core`` names the bytes that any windows with the q-gram at these places have in common,
    ``whole`` the text from the first byte of the first window to the last of the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                data, at = _joined(part.column("bytes"), words)
                grams = gram_names(data, q)
                gram = part.column("gram").to_numpy().view(np.uint64)
                hits = np.flatnonzero(grams == np.repeat(gram, np.diff(at))[: len(grams)])
                runs = part.column("asked")
                row = np.repeat(np.arange(part.num_rows), np.diff(runs.offsets.to_numpy()))
                pos, n, single = runs.flatten().flatten()
                shift = (part.column("at").to_numpy() - at[:-1])[row]
                # all windows of a run have its q-gram at the same place of the text, the first there
                place = hits[np.searchsorted(hits, at[:-1])][row]
                far = place - (pos.to_numpy() - shift)
                near = far - n.to_numpy() + 1
                count = far // width - near // width + 1
                of = np.repeat(np.arange(len(row)), count)
                least = (far[of] // width - (np.arange(len(of)) - (np.cumsum(count) - count)[of])) * width
                far, near = np.minimum(far[of], least + width - 1), np.maximum(near[of], least)
                begin, size = place[of] - far, far - near + 1
                own = pa.array(row[of])
                yield pa.record_batch({
                    "gram": part.column("gram").take(own),
                    "core": _names_of(data, length - width + 1)[place[of] - least].view(np.int64),
                    "whole": _range_names(grams, q, begin, begin + size - 1 + length).view(np.int64),
                    "doc_id": part.column("doc_id").take(own), "body": part.column("body").take(own),
                    "at": part.column("at").take(own), "pos": (begin + shift[of]).astype(np.int64),
                    "n": size.astype(np.int64), "single": single.take(pa.array(of)),
                })

    return asked.select("gram", "doc_id", "body", "at", "bytes", "asked").mapInArrow(run, _PART)


def _widths(most: int) -> list[int]:
    """How many windows parts have at most, down to one."""
    widths = [1]
    while widths[0] * 32 <= most:
        widths.insert(0, widths[0] * 16)
    return widths


def _parted_windows(scratch: Scratch, runs: DataFrame, length: int, q: int, words: bool) -> DataFrame:
    """As _same_windows for buckets of any size: runs are cut into ever smaller parts, which are refined as runs are."""
    texts = runs.select("gram", "doc_id", "body", F.col("pos").alias("at"), "n", "single", "bytes")
    asked = texts.withColumn("asked", F.array(F.struct(F.col("at").alias("pos"), "n", "single")))
    widths, found = _widths(length - q + 1), None
    for width in widths:
        parts = scratch.table(_parts(asked, length, q, width, words), f"parts{width}")
        classes = parts.groupBy("gram", "core", "whole").agg(
            F.count("*").alias("c"), F.min(F.struct("doc_id", "body", "at", "pos", "n", "single")).alias("one")
        )
        classes = scratch.table(classes, f"classes{width}")
        twice = classes.where("c > 1").select("gram", "core", "whole")
        settled = parts.where("single").join(twice, ["gram", "core", "whole"]).select("doc_id", "body", "pos", "n")
        found = settled if found is None else found.unionByName(settled)
        if width == 1:
            return found
        mixed = scratch.table(
            classes.groupBy("gram", "core").agg(F.count("*").alias("c")).where("c > 1").drop("c"), f"mixed{width}"
        )
        ones = classes.join(mixed, ["gram", "core"]).select(
            "gram", "one.*", ((F.col("c") == 1) & F.col("one.single")).alias("alone")
        )
        ones = ones.groupBy("gram", "doc_id", "body", "at").agg(
            F.collect_list(F.struct("pos", "n", F.col("alone").alias("single"))).alias("asked")
        ).select(F.col("gram").alias("_gram"), F.col("doc_id").alias("_id"), F.col("body").alias("_body"),
                 F.col("at").alias("_at"), "asked")
        asked = texts.join(ones, (texts.gram == ones._gram) & texts.doc_id.eqNullSafe(ones._id)
                           & (texts.body == ones._body) & (texts["at"] == ones._at))


def repeated(docs: DataFrame, length: int = 400, q: int = 128, large: int = 1024, words: bool = False) -> DataFrame:
    """(doc_id, body, pos, n): n consecutive windows from byte (or word) pos on that also start elsewhere.

    ``body`` is a hash of the text. Rows with the same doc_id and text get the
    same windows, as each of them repeats the other.
    """
    if not q <= length:
        raise ValueError("q must not exceed length")
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = with_body(docs)
    runs = scratch.table(_runs(docs, length, q, words), "runs")
    buckets = runs.groupBy("gram").agg(
        F.count("*").alias("c"), (F.min("whole") != F.max("whole")).alias("mixed")
    ).where("c > 1").drop("c")
    # a table of its own: adaptive execution splits hot keys only where both sides come from plain exchanges
    buckets = scratch.table(buckets, "buckets")
    shared = scratch.table(runs.join(buckets, "gram"), "shared")
    classes = shared.where("mixed").groupBy("gram", "whole").agg(
        F.count("*").alias("c"), F.min(F.struct("doc_id", "body", "pos", "n")).alias("one")
    )
    classes = scratch.table(classes.select("gram", "whole", "one.*", (F.col("c") == 1).alias("single")), "classes")
    scratch.drop("runs")
    scratch.drop("buckets")
    where = ["doc_id", "body", "pos", "n"]
    settled = shared.where("not mixed").select(where).unionByName(
        shared.where("mixed").join(classes.where("not single").select("gram", "whole"), ["gram", "whole"]).select(where)
    )
    sizes = classes.groupBy("gram").agg((F.count("*") > large).alias("crowded"))
    texts = _texts_of_runs(docs, classes.drop("whole"), length, words).join(sizes, "gram")
    texts = scratch.table(texts, "texts")
    same = _same_windows(texts.where("not crowded").drop("crowded"), length, words)
    parted = _parted_windows(scratch, texts.where("crowded").drop("crowded"), length, q, words)
    return scratch.table(settled.unionByName(same).unionByName(parted), "windows")


def with_body(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("body"))


def spans_of(pos: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows cover."""
    order = np.argsort(pos, kind="stable")
    begin, end = pos[order], np.maximum.accumulate((pos + n - 1 + length)[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.concatenate((new[1:], [True]))]


def _whole_characters(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the characters that they cover in part."""
    lead = np.append((text & 0xC0) != 0x80, True)
    first = np.flatnonzero(lead)
    begin = first[np.searchsorted(first, begin)]
    return begin, np.maximum(begin, first[np.searchsorted(first, end, "right") - 1])


def _windows_of_texts(docs: DataFrame, length: int, q: int, large: int, words: int | None) -> DataFrame:
    """(_id, _body, windows): all repeated windows of a text, ``w`` tells those of ``words`` words from those of bytes."""
    windows = repeated(docs, length, q, large).withColumn("w", F.lit(False))
    if words:
        by_words = repeated(docs, words, max(1, words // 3), large, words=True)
        windows = windows.unionByName(by_words.withColumn("w", F.lit(True)))
    return windows.groupBy("doc_id", "body").agg(
        F.collect_set(F.struct("pos", "n", "w")).alias("windows")  # a set, as repeated rows have the same windows
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "windows")


def _without(
    text: np.ndarray, pos: np.ndarray, n: np.ndarray, in_words: np.ndarray, length: int, words: int | None
) -> str:
    """The text without the whole characters that windows of bytes cover, and without those of words."""
    stay = np.ones(len(text), bool)
    if not in_words.all():
        for a, b in zip(*_whole_characters(text, *spans_of(pos[~in_words], n[~in_words], length))):
            stay[a:b] = False
    if in_words.any():
        begin, end = word_bounds(text)
        for a, b in zip(*spans_of(pos[in_words], n[in_words], words)):
            stay[begin[a] : end[b - 1]] = False
    return text[stay].tobytes().decode()


def cut_repeats(
    docs: DataFrame, length: int = 400, q: int = 128, large: int = 1024, words: int | None = None
) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts; n_chars follows if there is one.

    As remove_repeats, but only whole characters go. With ``words``, passages of
    so many words that stand elsewhere too go as well, however short they are. A
    text of which nothing is left stays as an empty one.
    """
    found = _windows_of_texts(docs, length, q, large, words).withColumnRenamed("windows", "_windows")
    own = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_own"),
        "text", F.struct(*docs.columns).alias("_row"),
    )
    joined = own.join(found, own.doc_id.eqNullSafe(found._id) & (own._own == found._body), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("_windows")
            has, place = windows.is_valid().to_numpy(False), windows.offsets.to_numpy()
            pos, n, in_words = (x.to_numpy(False) for x in windows.values.flatten())
            data, at = texts_of(batch.column("text"))
            texts = batch.column("text").to_pylist()
            for i in np.flatnonzero(has):
                part = slice(place[i], place[i + 1])
                w = in_words[part].astype(bool)
                texts[i] = _without(data[at[i] : at[i + 1]], pos[part], n[part], w, length, words)
            row = batch.column("_row")
            out = dict(zip((f.name for f in row.type), row.flatten()))
            out["text"] = pa.array(texts, out["text"].type)
            if "n_chars" in out:
                counted = pc.utf8_length(out["text"]).cast(out["n_chars"].type)
                out["n_chars"] = pc.if_else(pa.array(has), pc.if_else(pc.is_valid(out["n_chars"]), counted, None), out["n_chars"])
            yield pa.record_batch(out)

    return joined.select("text", "_windows", "_row").mapInArrow(run, docs.schema)


def remove_repeats(
    docs: DataFrame, length: int = 400, q: int = 128, large: int = 1024, words: int | None = None
) -> DataFrame:
    """Every row of ``docs`` with the bytes that stay.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (array of
    (start, end) in bytes). A byte goes if a string of ``length`` bytes that
    covers it starts anywhere else too. A null or short text has nothing to
    remove and keeps its bytes; extra columns are ignored; repeated rows repeat
    each other. With ``words``, a column ``cut`` (string) has the text that
    cut_repeats leaves; the other columns stay those of bytes.
    """
    found = _windows_of_texts(docs, length, q, large, words)
    docs = with_body(docs)
    joined = docs.join(found, docs.doc_id.eqNullSafe(found._id) & (docs.body == found._body), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column("text"))
            windows = batch.column("windows")
            has, place = windows.is_valid().to_numpy(False), windows.offsets.to_numpy()
            pos, n, in_words = (x.to_numpy(False) for x in windows.values.flatten())
            removed, kept, spans, cut = [], [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                begin = end = np.empty(0, np.int64)
                part = slice(place[i], place[i + 1] if has[i] else place[i])
                w = in_words[part].astype(bool)
                if not w.all():
                    begin, end = spans_of(pos[part][~w], n[part][~w], length)
                if words:
                    cut.append(_without(text, pos[part], n[part], w, length, words))
                stay = np.ones(len(text), bool)
                for a, b in zip(begin, end):
                    stay[a:b] = False
                kept.append(text[stay].tobytes() if len(begin) else text.tobytes())
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end)])
            out = {
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at)),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(list(map(len, spans)), pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
            yield pa.record_batch(out | {"cut": pa.array(cut, pa.string())} if words else out)

    return joined.select("doc_id", "text", "windows").mapInArrow(
        run,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, "
        "spans array<struct<start: bigint, end: bigint>>" + (", cut string" if words else ""),
    )



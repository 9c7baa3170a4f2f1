"""Packing of documents into sequences by minimum bin slack.

Tokens are counted in Arrow batches; a document with more tokens than a sequence
is cut into pieces. What has to be packed is then a table of lengths with counts,
which has at most ``capacity`` rows whatever the size of the corpus. Bin by bin,
a bitset subset-sum program over the lengths that are left finds the fullest
combination with the longest of them. It is removed as often as the counts
allow, so that the number of steps depends on the number of lengths, not of bins.
Pieces then find their place in the plan by their number among pieces of their
length; that number is counted by salted groups, so that a length that a third of
all pieces have is no hot key.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, small_batches, texts_of
from estatelens.llm.units import UnitEncoder

# How the vocabulary's tokenizer cuts normalised texts: fixed values of its file.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class NormalisedWords:
    """Ids of units by the ``tokenizers`` library, each distinct word once.

    Words are lower-cased and cut here as the vocabulary's file says, so that a
    word is looked up in whatever case and punctuation it stands; its ids come
    from the library. Keeps at most ``most`` words.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path).model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.most = most
        self.words_of = regex.compile(_WORDS).findall
        self.ids: dict[str, bytes] = {}

    def _words(self, unit: bytes) -> list[str]:
        plain = unit.strip().lower()
        if plain.isalpha():
            return [plain.decode()]
        text = unicodedata.normalize("NFC", unit.decode())
        return self.words_of("".join(map(str.lower, text)))

    def _ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = self.bytes.pre_tokenize_str(word)[0][0]
        return array("i", [token.id for token in self.model.tokenize(word)]).tobytes()

    def __call__(self, units: list[bytes]) -> list[bytes]:
        split = list(map(self._words, units))
        wanted = {w for words in split for w in words}
        if len(self.ids) + len(wanted) > self.most:
            self.ids = {}
        ids = self.ids
        ids.update((w, self._ids(w)) for w in wanted if w not in ids)
        return [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in split]


class WholeTexts:
    """Ids of whole texts as the library gives them by default.

    Texts that hold one of the vocabulary's added tokens, such as ``<|endoftext|>``, go to the
    library as they are: it gives such a token its own id wherever it stands. All other texts
    are made of units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.units = UnitEncoder(NormalisedWords(path), fold=True)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start."""
        ids, at = self.units.texts(data, offsets)
        whole = memoryview(data)[offsets[0] : offsets[-1]]
        found = {m.start() for m in self.added.finditer(whole)} if self.added else ()
        rows = np.unique(np.searchsorted(offsets - offsets[0], sorted(found), "right") - 1) if found else ()
        for row in rows:
            text = bytes(memoryview(data)[offsets[row] : offsets[row + 1]])
            if not self.added.search(text):
                continue  # it stands across two texts
            own = np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.int32)
            ids = np.concatenate((ids[: at[row]], own, ids[at[row + 1] :]))
            at = np.concatenate((at[: row + 1], at[row + 1 :] + at[row] + len(own) - at[row + 1]))
        return ids, at


@lru_cache(maxsize=2)
def encoder(path: str) -> WholeTexts:
    """One for each worker process."""
    return WholeTexts(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(path)
        for batch in small_batches(batches, "text", 4 << 20):
            ids, at = units.texts(*texts_of(batch.column("text")))
            row, start, length, crc = [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[at[i] : at[i + 1]], np.int32(end_id)).astype("<i4")
                for first in range(0, len(own), capacity):
                    part = own[first : first + capacity]
                    row.append(i)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            start = np.array(start, np.int64)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int32())),
                "piece": pa.array((start // capacity).astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (with how often) whose sum comes closest to ``room`` without passing it.

    Bit s of a set says that sum s can be reached; a length with count c is
    added in steps of 1, 2, 4, ... copies. Long lengths come first, and the
    search ends as soon as the room can be filled to the last token.
    """
    full = (1 << (room + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, most = 1, min(left[length], room // length)
        while most:
            copies = min(copies, most)
            steps.append((length, copies, reached))
            reached |= reached << (length * copies) & full
            most -= copies
            copies *= 2
        if reached >> room & 1:
            break
    at = reached.bit_length() - 1
    out: dict[int, int] = {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + copies
            at -= length * copies
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, lengths with how often each) of the bins that take all lengths."""
    left, bins = dict(counts), []
    while left:
        longest = max(left)
        left[longest] -= 1
        if not left[longest]:
            del left[longest]
        found = fullest(left, capacity - longest)
        left[longest] = left.get(longest, 0) + 1
        found[longest] = found.get(longest, 0) + 1
        times = min(left[x] // n for x, n in found.items())
        bins.append((times, found))
        for x, n in found.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Of each length in each bin of the plan: its numbers [first, ...) among its length, and where they go."""
    rows, used, sequence = [], {}, 0
    for times, found in bins:
        offset = 0
        for length, n in sorted(found.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "n", "sequence", "offset"), table.T.copy()))


def _numbered(found: DataFrame, salts: int) -> DataFrame:
    """``number``: 0, 1, ... among the pieces of a length."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("c")).select(
        "length", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("number", F.row_number().over(within) - 1).join(counts, ["length", "salt"]).withColumn(
        "number", F.col("base") + F.col("number")
    )


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, salts: int | None = None) -> DataFrame:
    """Pieces of all documents with the sequence each goes to and its offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is the single ``end_id``. Repeated rows are packed each; a null
    doc_id is packed like any other; other columns are ignored. ``salts``: parts
    that a length's pieces are numbered in, by default the session's number of
    shuffle partitions.
    """
    spark = docs.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Scratch(spark, "packing").table(pieces(docs, path, capacity, end_id), "pieces")
    counts = dict(map(tuple, found.groupBy("length").count().collect()))  # capacity rows at most
    where = places(plan(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = where["length"] * (1 << 48) + where["first"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = np.searchsorted(bound, length * (1 << 48) + number, "right") - 1
            bin_, slot = np.divmod(number - where["first"][row], where["n"][row])
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(columns | {
                "sequence_id": where["sequence"][row] + bin_,
                "offset": where["offset"][row] + slot * length,
            })

    return _numbered(found, salts).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "number"
    ).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )

"""Product codes of vectors: integer k-means per part, with memoised grid cells.

Vectors become integers, are cut into parts, and each part position learns a codebook.
To find a part's nearest entry, the part is put into a cell of a coarse grid. What a
cell needs is kept in a memo: its entries that are not *dominated*, which means that
their smallest distance to the cell's box does not exceed the largest distance of some
other entry. Only those are evaluated exactly for the parts in the cell, so results are
those of a full search, ties included.

A round reads the written table of integers, sums parts by entry inside each task, and
adds the sums up by entry with Spark. Codebooks (``entries`` vectors for each part,
whatever the number of rows) travel with the tasks and come back to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
_BLOCK = 1 << 20  # numbers in one block of box distances


class Cells:
    """The memo of one codebook: for each cell met, the entries that may be nearest to a point in it."""

    def __init__(self, book: np.ndarray, width: int, most: int = 1 << 16):
        self.book, self.width, self.most = book, width, most
        self.known: dict[bytes, np.ndarray] = {}

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries not dominated across the box of each cell, in ascending order."""
        found = []
        step = max(1, _BLOCK // self.book.size)
        for at in range(0, len(cells), step):
            low = (cells[at : at + step] * self.width)[:, None]
            below, above = low - self.book, self.book - (low + self.width - 1)
            outside = np.maximum(np.maximum(below, above), 0)
            farthest = np.maximum(np.abs(below), np.abs(above))
            nearest = np.einsum("ijk,ijk->ij", outside, outside)
            reach = np.einsum("ijk,ijk->ij", farthest, farthest).min(1)
            found += [np.flatnonzero(row).astype(np.int32) for row in nearest <= reach[:, None]]
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the first of equally near ones, and its squared distance."""
        cells, where = np.unique(parts // self.width, axis=0, return_inverse=True)
        where = where.reshape(-1)
        keys = [cell.tobytes() for cell in cells]
        missing = [i for i, key in enumerate(keys) if key not in self.known]
        if len(self.known) + len(missing) > self.most:
            self.known, missing = {}, list(range(len(keys)))
        self.known.update(zip((keys[i] for i in missing), self._candidates(cells[missing])))
        lists = [self.known[key] for key in keys]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.concatenate(lists), np.cumsum(sizes) - sizes
        entry, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        step = max(1, _BLOCK // self.book.size)
        for at in range(0, len(parts), step):
            own, cell = parts[at : at + step], where[at : at + step]
            count = sizes[cell]
            begin = np.cumsum(count) - count
            asked = flat[np.arange(count.sum()) + np.repeat(first[cell] - begin, count)]
            gap = np.repeat(own, count, axis=0) - self.book[asked]
            squares = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(squares, begin)
            hit = np.flatnonzero(squares == np.repeat(least, count))
            entry[at : at + step] = asked[hit[np.searchsorted(hit, begin)]]
            distance[at : at + step] = least
        return entry, distance


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part position, as an array (part, entry, position within part)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Lowercase hex digest of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): vectors as integers, floor of 1024 times each component.

    Rows take no part whose vector is null, empty, holds null or non-finite components, or
    has a length that ``parts`` does not divide. Components are held to a range in which
    squared distances of whole parts fit 62 bits; with parts of 16 that is 2^28, or 262,144
    before scaling.
    """
    own = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where("x is not null").where((F.size("x") > 0) & (F.size("x") % parts == 0) & fine)
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / (F.size("x") / parts)) / 2)

    def whole(x):
        return F.floor(F.greatest(F.least(x * SCALE, most.cast("double")), -most.cast("double"))).cast("bigint")

    return own.select("vec_id", "label", F.transform("x", whole).alias("v"))


def range_of(part_length: int) -> int:
    """The largest component, as an integer, for parts of that length."""
    return isqrt((1 << 62) // part_length) // 2


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(row, part, position within part) of a column of equally long lists."""
    return column.flatten().to_numpy(False).reshape(len(column), parts, -1)


def _assigned(batch: pa.RecordBatch, memos: list[Cells]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = _matrix(batch.column("v"), len(memos))
    entry, distance = zip(*(memo.nearest(values[:, p]) for p, memo in enumerate(memos)))
    return values, np.stack(entry, 1), np.stack(distance, 1)


def _sums(data: DataFrame, book: np.ndarray, width: int) -> DataFrame:
    """(part, entry, pos, total, n): sums of the parts next to each entry; unused entries have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Cells(part, width) for part in book]
        total, count = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, entry, _ = _assigned(batch, memos)
            for p in range(len(book)):
                np.add.at(total[p], entry[:, p], values[:, p])
                count[p] += np.bincount(entry[:, p], minlength=book.shape[1])
        part, used = np.nonzero(count)
        size = book.shape[2]
        yield pa.record_batch({
            "part": np.repeat(part, size), "entry": np.repeat(used, size), "pos": np.tile(np.arange(size), len(part)),
            "total": total[part, used].ravel(), "n": np.repeat(count[part, used], size),
        })

    summed = data.select("v").mapInArrow(run, "part bigint, entry bigint, pos bigint, total bigint, n bigint")
    return summed.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def trained(data: DataFrame, parts: int, entries: int, rounds: int, width: int) -> Codebooks:
    """Codebooks of the integer table (vec_id, label, v), whose vectors share one length.

    Entries start as the parts of the vectors with the smallest vec_ids; of rows that
    repeat a vec_id the smaller vector comes first, rows without one come last.
    """
    first = data.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    book = np.array([row.v for row in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = book.copy()
        for r in _sums(data, book, width).collect():
            moved[r.part, r.entry, r.pos] = r.total // r.n
        book = moved
    return Codebooks(book)


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 64
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all usable ``vectors`` (vec_id, embedding, label), and the codebooks.

    Columns of the codes: vec_id, label, code (array of entries by part), error (sum of
    squared distances). Each round assigns every part to its nearest entry, the lowest of
    equally near ones, then moves entries to the floor of the mean of their parts; unused
    entries stay. ``width`` is the grid's cell in integer units and changes no result.

    Unusable vectors (see ``integers``) and those of another length than the first usable
    one take no part. Repeated rows and rows without vec_id are coded like any other.
    With fewer rows than ``entries`` the codebooks are smaller; an empty table gives no
    codes and no codebooks. Extra columns are ignored; a table without labels has null labels.
    """
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    scratch = Scratch(vectors.sparkSession, "codes")
    data = scratch.table(integers(vectors, parts), "integers")
    first = data.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    label = data.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {label}, code array<int>, error bigint"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    data = data.where(F.size("v") == first[0])
    books = trained(data, parts, entries, rounds, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Cells(part, width) for part in books.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            _, entry, distance = _assigned(batch, memos)
            at = np.arange(0, entry.size + 1, parts, dtype=np.int32)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id"), "label": batch.column("label"),
                "code": pa.ListArray.from_arrays(at, entry.ravel().astype(np.int32)), "error": distance.sum(1),
            })

    return scratch.table(data.mapInArrow(run, schema), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of the errors of all rows with the same label; nulls are one label."""
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint")
    errors = codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return codes.join(errors, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")

"""Token counts of sections: documents are encoded once, whole, and their tokens attributed.

Token character spans come from the lengths of the tokens' bytes; they are joined
to the sections' intervals by binary search in sorted starts. A token that reaches
over a boundary is allocated by an explicit rule:

``first``    to the section of its first character,
``largest``  to the section with most of its characters, the earlier on ties,
``split``    to all of them, in proportion to its characters there.

A token that begins or ends inside a character spans that whole character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm.bpe import encoder
from estatelens.llm.common import small_batches, texts_of

RULES = ("first", "largest", "split")


def allocate(
    first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, of these crossing) of each section [start, end).

    Tokens span [first, last), in the order of the text. Sections are sorted and
    don't overlap; what no section covers is not counted.
    """
    low = np.searchsorted(end, first, "right")
    high = np.searchsorted(start, last, "left")
    count = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(first)), count)
    section = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + low[token]
    shared = np.minimum(last[token], end[section]) - np.maximum(first[token], start[section])
    real = shared > 0
    token, section, shared = token[real], section[real], shared[real]
    whole = (last - first)[token]
    crossing = shared < whole
    if rule == "first":
        chosen = start[section] <= first[token]
        weight = chosen.astype(float)
    elif rule == "largest":
        most = np.zeros(len(first), np.int64)
        np.maximum.at(most, token, shared)
        best = shared == most[token]
        again = np.concatenate(([False], token[1:] == token[:-1]))
        seen = np.cumsum(best) - best
        opening = np.maximum.accumulate(np.where(again, 0, np.arange(len(token)))) if len(token) else token
        weight = (best & (seen == seen[opening])).astype(float)
    else:
        weight = shared / whole
    n = len(start)
    return (
        np.bincount(section, weight, n),
        np.bincount(section, crossing & (weight > 0), n).astype(np.int64),
    )


def attribute(
    docs: DataFrame, path: str, pattern: str, sections: str | None = None, rule: str = "largest"
) -> DataFrame:
    """Tokens of each section of each document.

    ``sections`` names a column of ``docs``: an array of structs with ``start``
    and ``end`` in code points, sorted and without overlaps; null or an empty
    array gives no rows. Without it the sections are the lines, each with its
    line break, and a null or empty text has one empty section.

    Columns: doc_id, section (from 0), start, end, n_tokens (a double with the
    rule ``split``), n_crossing (tokens among them that reach over a boundary).
    Repeated rows stay; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    kind = pa.float64() if rule == "split" else pa.int64()

    def counted(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        """Sections of a few texts; ``size``: the bytes of their tokens."""
        data, at = data[at[0] : at[-1]], at - at[0]
        # characters before each byte, counted from the first text
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        ends = np.cumsum(size)
        first = chars[np.minimum(ends - size + 1, len(data))] - 1
        last = chars[ends]
        origin = chars[at]
        if sections is None:
            breaks = np.flatnonzero(data == 0x0A) + 1
            # a break that ends a text starts its last, empty line
            bounds = np.sort(np.concatenate((at[:-1], breaks)), kind="stable")
            row = np.repeat(np.arange(batch.num_rows), 1 + _breaks_in(data, at))
            start = chars[bounds]
            end = np.where(np.append(row[1:] != row[:-1], True), origin[row + 1], np.append(start[1:], 0))
        else:
            column = batch.column("sections")
            row = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy())
            a, b = (x.to_numpy() for x in column.flatten().flatten())
            start, end = a + origin[row], b + origin[row]
            if (start > end).any() or (start[1:] < end[:-1]).any():
                raise ValueError("sections must be sorted, within their text, and must not overlap")
        tokens, crossing = allocate(first, last, start, end, rule)
        opening = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.empty(0, bool)
        number = np.arange(len(row)) - np.flatnonzero(opening)[np.cumsum(opening) - 1]
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(pa.array(row)),
            "section": pa.array(number, pa.int32()),
            "start": start - origin[row], "end": end - origin[row],
            "n_tokens": pa.array(tokens if rule == "split" else tokens.astype(np.int64), kind),
            "n_crossing": crossing,
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, units = encoder(path, pattern)
        size = np.fromiter(map(len, replay.tokens), np.int64, replay.end)
        for batch in small_batches(batches, "text", 4 << 20):
            data, at = texts_of(batch.column("text"))
            ids, ids_at = units.texts(data, at)
            for low in range(0, batch.num_rows, step := 64):
                part = batch.slice(low, step)
                rows = slice(low, low + part.num_rows + 1)
                yield counted(part, data, at[rows], size[ids[ids_at[rows][0] : ids_at[rows][-1]]])

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), "text"]
    if sections is not None:
        pair = lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))
        columns.append(F.transform(F.col(sections), pair).alias("sections"))
    number = "double" if rule == "split" else "bigint"
    return docs.select(*columns).mapInArrow(
        run, f"doc_id bigint, section int, start bigint, end bigint, n_tokens {number}, n_crossing bigint"
    )


def _breaks_in(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(data == 0x0A)))
    return total[at[1:]] - total[at[:-1]]


def with_sections(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the column ``sections`` from a table (doc_id, start, end), for ``attribute``."""
    own = spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("sections")
    )
    return docs.join(own, docs.doc_id == own._id, "left").drop("_id")

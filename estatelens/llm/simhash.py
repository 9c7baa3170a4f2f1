"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprints are made in Arrow batches. Pairs are searched among distinct
fingerprints only. 64 bits are split into ``blocks``; two fingerprints with at
most ``bits`` differing bits agree in at least ``blocks - bits`` of them, so each
choice of that many blocks is a key on which close pairs meet. A bucket with more
than ``large`` fingerprints is dealt anew by the same principle over finer blocks
of its free bits, which bounds every bucket by construction (at most 2^(4 bits + 1)
members), so no cap is needed. Inside a bucket the Hamming distance is verified
and a spanning forest of the links is emitted instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch, group_starts, texts_of, whole_groups
from estatelens.llm.components import components, lookup

SEED = 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash over word shingles with repeats; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _body(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("body")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, body, fp) for each row; a null or empty text has fingerprint 0, body is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column("text"))
            view = memoryview(data)
            found = np.fromiter(
                (fingerprint(bytes(view[at[i] : at[i + 1]]), words) for i in range(batch.num_rows)),
                np.uint64, batch.num_rows,
            )
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "body": batch.column("body"), "fp": found.view(np.int64),
            })

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _body("text"), "text")
    return rows.mapInArrow(run, "doc_id bigint, body bigint, fp bigint")


def _mask(sizes: list[int], chosen: tuple[int, ...], bits: list[int]) -> int:
    """The bits of the chosen blocks, where consecutive blocks take consecutive ``bits``."""
    starts = np.cumsum([0, *sizes])
    return sum(1 << bits[b] for c in chosen for b in range(starts[c], starts[c + 1]))


def _sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def block_masks(bits: int = 3, blocks: int = 6) -> list[int]:
    """One mask for each choice of blocks that a close pair may agree in."""
    sizes = _sizes(64, blocks)
    return [_mask(sizes, c, list(range(64))) for c in combinations(range(blocks), blocks - bits)]


def finer_masks(mask: int, bits: int = 3, width: int = 4) -> list[int]:
    """Masks over blocks of about ``width`` bits among those that ``mask`` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    sizes = _sizes(len(free), max(bits + 1, len(free) // width))
    return [_mask(sizes, c, free) for c in combinations(range(len(sizes)), len(sizes) - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints at most ``bits`` apart."""
    unsigned = values.view(np.uint64)  # of a negative number bitwise_count takes the absolute value
    left = np.ones(len(values), bool)
    links = []
    for seed in range(len(values)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(unsigned[rest] ^ unsigned[at]) <= bits]
            left[near] = False
            queue += near.tolist()
            links += [(int(values[at]), int(values[n])) for n in near]
    return links


def _linked(members: DataFrame, keys: list[str], bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 20000):
            values = table.column("fp").to_numpy()
            starts = group_starts(table, keys)
            links = [
                link
                for a, b in zip(starts, [*starts[1:], len(values)])
                for link in _forest(values[a:b], bits)
            ]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.record_batch({"u": pairs[:, 0], "v": pairs[:, 1]})

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "u bigint, v bigint")


def links(nodes: DataFrame, bits: int = 3, blocks: int = 6, large: int = 1024) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints ``fp`` at most ``bits`` apart."""
    masks = block_masks(bits, blocks)
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, ["t", "key"])
    near = _linked(members.where(F.col("n") <= large), ["t", "key"], bits)
    finer = None
    for t, mask in enumerate(masks):
        again = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in finer_masks(mask, bits)))
        finer = F.when(F.col("t") == t, again) if finer is None else finer.when(F.col("t") == t, again)
    crowded = members.where(F.col("n") > large).select("fp", "t", "key", F.posexplode(finer).alias("t2", "key2"))
    return near.unionByName(_linked(crowded, ["t", "key", "t2", "key2"], bits))


def _classes(nodes: DataFrame, scratch: Scratch, bits: int, blocks: int, large: int) -> DataFrame:
    """(fp, root, component_id) of all ``nodes`` (fp, first_id): the smallest fingerprint reachable, and the smallest id."""
    roots = components(links(nodes, bits, blocks, large), scratch)
    linked = scratch.table(nodes.join(roots, nodes.fp == roots.node).select("fp", "first_id", "root"), "linked")
    smallest = linked.groupBy("root").agg(F.struct(F.min("first_id").alias("id")).alias("m"), F.count("*").alias("n"))
    linked = lookup(linked, "root", smallest, linked.count()).select("fp", "root", F.col("m.id").alias("least_id"))
    # a table of its own: adaptive execution splits a hot fingerprint only where both sides come from
    # plain exchanges
    return scratch.table(nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"),
    ), "classes")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, blocks: int = 6, large: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of close fingerprints.

    Null texts, empty texts and texts without words have fingerprint 0 and are
    linked like any other. Repeated rows stay repeated; a null doc_id takes
    part and gets the smallest other doc_id of its component, or null. Columns
    other than doc_id and text are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, words).drop("body"), "fingerprints")
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    classes = _classes(nodes, scratch, bits, blocks, large)
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 3, blocks: int = 6, large: int = 1024) -> DataFrame:
    """One row of each component of close fingerprints, all columns unchanged.

    The row with the smallest doc_id stays, nulls last, then that with the
    smallest hash of its text; of rows that are equal in both, one stays. Null
    texts, empty texts and texts without words are one component with whatever
    is close to fingerprint 0.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, words), "fingerprints")
    nodes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    classes = _classes(nodes, scratch, bits, blocks, large).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce("doc_id", F.lit(0)).alias("id"), "body")
    # rows that are equal in all three are counted before the join, which may then split a hot component
    rows = scratch.table(fps.groupBy("fp", order.alias("at")).agg(F.count("*").alias("n")), "rows")
    best = rows.join(classes, "fp").groupBy("root").agg(F.min(F.struct("at", "n")).alias("best"))
    winners = scratch.table(best.select("best.at.bare", "best.at.id", "best.at.body", "best.n"), "winners")

    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").isNull().alias("bare"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), _body("text"),
    )
    keys = ["bare", "id", "body"]
    once = own.join(winners.where("n = 1"), keys, "left_semi")
    again = own.join(winners.where("n > 1"), keys, "left_semi").dropDuplicates(keys)
    return once.unionByName(again).select("row.*")

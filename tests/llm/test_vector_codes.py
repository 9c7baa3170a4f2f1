"""Vector codes against a plain full search."""

import hashlib
import random

import numpy as np
import pytest

from estatelens.llm import vector_codes
from estatelens.llm.vector_codes import Cells

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, error int, part int"


def plain(rows, entries, rounds, parts=4):
    """(vec_id, label, code, error) of all rows and the codebooks, in Python integers."""
    kept = [(i, [int(np.floor(x * 1024)) for x in v], label) for i, v, label in rows
            if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == size * parts]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else old
                        for e, old in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, [f[0] for f in found], sum(f[1] for f in found)))
    return out, books


def odd_rows(rng, n):
    base = [[rng.gauss(0, 0.1) for _ in range(8)] for _ in range(9)]
    rows = [(i * 3 % 101, [x + rng.choice((0, 0, 0.01)) for x in rng.choice(base)], rng.choice((None, 1, 2))) for i in range(n)]
    return rows + [(5, None, 1), (6, [], 1), (7, [0.1, None] * 4, 1), (8, [float("nan")] * 8, 1), (9, [float("inf")] * 8, 2),
                   (10, [0.5] * 12, 1), (11, [0.5] * 7, 1), (None, [0.5] * 8, 1), (3, [0.0] * 8, None), (3, [0.0] * 8, None)]


@pytest.mark.parametrize("entries, width", [(16, 64), (256, 7), (5, 1024)])
def test_codes_equal_full_search(spark, entries, width):
    rows = odd_rows(random.Random(entries), 120)
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    codes, books = vector_codes.compress(table, entries=entries, rounds=3, width=width)
    expected, plain_books = plain(rows, entries, 3)
    assert books.entries.tolist() == plain_books
    flat = ",".join(str(x) for part in plain_books for entry in part for x in entry)
    assert books.sha256 == hashlib.sha256(flat.encode()).hexdigest()
    found = vector_codes.with_label_errors(codes).collect()
    assert sorted((str(r.vec_id), str(r.label), r.code, r.error) for r in found) == sorted(
        (str(i), str(label), code, error) for i, label, code, error in expected
    )
    for r in found:
        assert r.label_error == sum(e for _, label, _, e in expected if label == r.label)


def test_memo_drops_only_dominated_entries():
    rng = np.random.default_rng(3)
    book = np.concatenate((rng.integers(-300, 300, (60, 3)), [[0, 0, 0], [0, 0, 0]]))
    points = np.concatenate((rng.integers(-400, 400, (500, 3)), book))
    gaps = ((points[:, None] - book) ** 2).sum(2)
    for most in (4, 1 << 16):
        memo = Cells(book, 64, most)
        for part in (points, points[::-1]):
            own = gaps if part is points else gaps[::-1]
            entry, distance = memo.nearest(part)
            assert (entry == own.argmin(1)).all() and (distance == own.min(1)).all()
    assert max(map(len, memo.known.values())) < len(book) / 2


def test_values_beyond_the_range(spark):
    big = vector_codes.range_of(2)
    rows = [(1, [1e300, -1e300] * 4, 1), (2, [1e-300] * 8, 1), (3, [-1e-300] * 8, 1)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    codes, books = vector_codes.compress(table, entries=2, rounds=1)
    assert books.entries.max() == big and books.entries.min() == -big
    assert {r.vec_id: r.code for r in codes.collect()} == {1: [0] * 4, 2: [1] * 4, 3: [1] * 4}


def test_no_usable_vectors(spark):
    table = spark.createDataFrame([(1, None, 1, "x", 1, 2)], SCHEMA)
    for empty in (table, table.where("false"), table.drop("label")):
        codes, books = vector_codes.compress(empty)
        assert codes.collect() == [] and books is None
        assert vector_codes.with_label_errors(codes).collect() == []

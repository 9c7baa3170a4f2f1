"""Substring dedup against plain windows; the index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from estatelens.llm import queries, substrings
from estatelens.llm.fm_index import Bits, FMIndex, WaveletMatrix
from tests.llm.support import MEDIUM, SMALL, docs, words  # noqa: F401  (docs is a fixture)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain(rows, length):
    """(n_words, n_removed, kept, spans) of each row."""
    own = [(i, split(t)) for i, t in rows]
    least = {}
    for i, ws in own:
        if i is not None:
            for p in range(len(ws) - length + 1):
                w = tuple(ws[p : p + length])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, ws in own:
        gone = [False] * (len(ws) + 1)
        for p in range(len(ws) - length + 1):
            if i is not None and least[tuple(ws[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        starts = [p for p in range(len(ws)) if gone[p] and not (p and gone[p - 1])]
        spans = [(p, next(q for q in range(p, len(gone)) if not gone[q])) for p in starts]
        out.append((len(ws), sum(gone), kept, spans))
    return out


def plain_statistics(texts, asked, depth):
    """Length of the longest match from each place of ``asked``, at most ``depth``."""
    strings = {t[a : a + n] for t in texts for a in range(len(t)) for n in range(1, depth + 1) if a + n <= len(t)}
    return [next((n for n in range(depth, 0, -1) if i + n <= len(t) and t[i : i + n] in strings), 0)
            for t in asked for i in range(len(t))]


def test_bits_and_wavelets():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 300):
        bits = rng.integers(0, 2, n)
        at = np.arange(n + 1)
        assert Bits(bits).ones(at).tolist() == [0, *np.cumsum(bits)]
        symbols = rng.integers(0, 7, n)
        matrix = WaveletMatrix(symbols, 7)
        for c in range(7):
            assert matrix.rank(np.full(n + 1, c), at).tolist() == [int((symbols[:i] == c).sum()) for i in at]


@pytest.mark.parametrize("depth", [1, 2, 5, 8, 13])
def test_matching_statistics(depth):
    rng = random.Random(depth)
    texts = [tuple(rng.choice((1, 2, 3)) for _ in range(rng.randrange(25))) for _ in range(30)] + [(4,) * 20, (5,)]
    asked = [tuple(rng.choice((1, 1, 2, 3, 4, 0, 5)) for _ in range(rng.randrange(30))) for _ in range(20)] + texts
    asked += [t[3:] + u[:6] for t, u in zip(texts, texts[1:])]
    flat = lambda xs: (np.array([c for t in xs for c in t], np.int64), np.array([len(t) for t in xs], np.int64))
    index = FMIndex(*flat(texts), depth)
    length, row = index.matching_statistics(*flat(asked))
    known = [tuple(c or -1 for c in t) for t in asked]
    assert length.tolist() == plain_statistics(texts, known, depth)
    joined = [c for t in texts for c in (*t, 0)]
    places = [(t, i) for t in asked for i in range(len(t))]
    for (t, i), n, r in zip(places, length.tolist(), row.tolist()):
        at = index.rows[r]
        assert tuple(joined[at : at + n]) == t[i : i + n]
    owners = np.arange(len(texts))[::-1]
    least = index.least(owners)
    for (t, i), n, r in zip(places, length.tolist(), row.tolist()):
        if n == depth:
            having = [o for o, u in zip(owners, texts) if any(u[a : a + n] == t[i : i + n] for a in range(len(u)))]
            assert least[index.classes(depth)[0][r]] == min(having)


def planted(rng, n, vocabulary):
    """Documents with shared passages, copies, hot lines and repeats of their own."""
    passages = [words(rng, rng.randrange(5, 30), vocabulary) for _ in range(6)]
    line = words(rng, 9, vocabulary)
    rows = []
    for i in range(n):
        parts = [words(rng, rng.randrange(1, 25), vocabulary) for _ in range(4)]
        parts[1] += rng.choice([" ", "\n", "\t\x0b "]) + rng.choice(passages)[rng.choice((0, 0, 4)) :]
        if i % 3 == 0:
            parts[2] += " " + line + " " + rng.choice(passages)
        if i % 11 == 0:
            parts.append("again " * rng.randrange(40))
        rows.append((rng.randrange(10 * n) if i % 13 else None, "  ".join(parts)))
    return rows + [(i, rows[5][1]) for i in range(40, 80)] + [(rows[2][0], rows[7][1]), (rows[2][0], rows[2][1])]


@pytest.mark.parametrize("length, share, vocabulary", [(13, 1 / 20_000, 400), (13, 1e-3, 50), (4, 1e-2, 400), (17, 1.0, 3), (7, 0.0, 30)])
def test_planted_passages(docs, monkeypatch, length, share, vocabulary):
    monkeypatch.setattr(substrings, "_LOCAL", 2)
    rows = planted(random.Random(length), 120, vocabulary)
    found = substrings.remove_repeats(docs(rows).repartition(7), length, share).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in found) == sorted(
        (str(i), *p) for (i, _), p in zip(rows, plain(rows, length))
    )


def test_frequent_grams_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(substrings, "_LOCAL", 1)
    rows = planted(random.Random(2), 60, 40)
    total = sum(max(0, len(split(t)) - 3) for _, t in rows)
    for share in (0.1, 0.01, 0.001):
        found = substrings.frequent_grams(substrings._rows(docs(rows)), share)
        assert len(found) <= 1 / share and (np.diff(found.astype(object)) > 0).all()
    counts = {}
    for _, t in rows:
        ws = split(t)
        for i in range(len(ws) - 3):
            counts[tuple(ws[i : i + 4])] = counts.get(tuple(ws[i : i + 4]), 0) + 1
    assert len(found) == sum(c > 0.001 * total for c in counts.values())


def test_odd_rows(docs):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (None, "x " * 20), (5, "x " * 20), (6, "x " * 14), (7, long), (9, "z " + long),
            (8, "w" * 2_000_000), (8, "é\x0b" * 30), (10, "é " * 13 + "w" * 2_000_000)]
    found = substrings.remove_repeats(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in found) == sorted(
        (str(i), *p) for (i, _), p in zip(rows, plain(rows, 13))
    )
    for few in (docs(rows).where("false"), docs(rows).where("doc_id is null")):
        assert substrings.remove_repeats(few).count() == few.count()
    with pytest.raises(ValueError):
        substrings.repeated(docs(rows), length=3)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op11_substring_dedup"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found) == sorted(
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest(), kept)
        for (i, _), (n, gone, kept, _) in zip(rows, plain(rows, 13))
    )

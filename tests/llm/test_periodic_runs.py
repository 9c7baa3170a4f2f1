"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.llm import periodic_runs, queries
from tests.llm.support import SMALL, docs, words  # noqa: F401  (docs is a fixture)


def plain_runs(words, times=4, least=6):
    """(start, length, period) by looking at every period and every place."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if length >= max(least, times * q):
                own = words[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {j for s, n, q in runs for j in range(s + q, s + n)}
    return " ".join(w for j, w in enumerate(words) if j not in gone)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def block_runs(lists, times, least):
    numbers = {w: i + 1 for i, w in enumerate(sorted({w for ws in lists for w in ws}))}
    flat = np.array([numbers[w] for ws in lists for w in ws], np.int64)
    doc = np.repeat(np.arange(len(lists)), list(map(len, lists)))
    first = np.cumsum([0, *map(len, lists)])
    out = [[] for _ in lists]
    for s, n, q in zip(*(x.tolist() for x in periodic_runs.runs_of(flat, doc, times, least))):
        out[doc[s]].append((s - int(first[doc[s]]), n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=4), st.sampled_from([(4, 6), (2, 2), (3, 5)]))
def test_runs_of_two_words(lists, rule):
    assert block_runs(lists, *rule) == [plain_runs(ws, *rule) for ws in lists]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 7)), max_size=6))
def test_runs_of_powers(parts):
    ws = list("".join(t * n for t, n in parts))
    assert block_runs([ws, ws[::-1], ws], 4, 6) == [plain_runs(x) for x in (ws, ws[::-1], ws)]


@pytest.mark.parametrize("kind", ["one word", "Fibonacci", "Thue-Morse", "random"])
def test_runs_of_long_sequences(kind):
    rng = random.Random(4)
    a, b = "a", "ab"
    for _ in range(13):
        a, b = b, b + a
    ws = {"one word": "a" * 700, "Fibonacci": b[:600], "Thue-Morse": [str(i.bit_count() % 2) for i in range(600)],
          "random": [rng.choice("ab") for _ in range(600)]}[kind]
    for rule in ((4, 6), (2, 2)):
        assert block_runs([list(ws)], *rule) == [plain_runs(list(ws), *rule)]


def test_a_very_long_text():
    text = ["x", "y", "z"] * 100_000
    assert block_runs([text, ["w"] * 50_000], 4, 6) == [[(0, 300_000, 3)], [(0, 50_000, 1)]]


def test_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 9), (4, "b\x0bb\x0cb\rb\tb\nb"), (4, "b b b b b"), (5, "é x " * 5 + "z"),
            (5, "é x " * 5 + "z"), (6, "w" * 3_000_000), (7, " w" * 5 + " " * 3_000_000 + "w")]
    found = periodic_runs.detect(docs(rows), block=1000).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found) == sorted(
        (str(i), len(split(t)), plain_runs(split(t)), plain_kept(split(t), plain_runs(split(t)))) for i, t in rows
    )
    assert all((r.top is None) == (not r.runs) for r in found)
    assert periodic_runs.detect(docs(rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.detect(docs(rows), times=1)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(found) == len(rows)
    some = 0
    for doc_id, text in rows:
        ws = plain_planted(doc_id, split(text))
        if len(ws) > 3000:
            continue
        runs, r = plain_runs(ws), found[doc_id]
        some += bool(runs)
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.asDict() == {
            "doc_id": doc_id, "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
            "exponent_milli": top[1] and 1000 * top[1] // top[2],
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(plain_kept(ws, runs).encode()).hexdigest(),
        }
    assert some > 15


def test_planted_tails_of_odd_rows(spark, docs):
    rows = [(i, t) for i in range(60) for t in (None, "", " ", "a", " a b", "\x0ba b  c\td ")] + [(None, "a b")]
    found = queries.with_tails(docs(rows)).collect()
    assert sorted((str(r.doc_id), split(r.text)) for r in found) == sorted(
        (str(i), split(t) if i is None else plain_planted(i, split(t))) for i, t in rows
    )

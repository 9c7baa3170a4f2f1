"""Passages of over 50 words, however few bytes they have."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from estatelens.llm import queries, suffix_dedup
from tests.llm.support import MEDIUM, docs, words  # noqa: F401  (docs is a fixture)
from tests.llm.test_dedup import plain_repeats


def plain_cut(texts, n=51):
    """Texts without the n-word windows that stand twice."""
    places = [[(m.start(), m.end()) for m in re.finditer("[^\\x20\\x09-\\x0d]+", t)] for t in texts]
    runs = [[t[a:b] for a, b in p] for t, p in zip(texts, places)]
    seen = Counter(tuple(r[i : i + n]) for r in runs for i in range(len(r) - n + 1))
    out = []
    for t, p, r in zip(texts, places, runs):
        gone = set()
        for i in range(len(r) - n + 1):
            if seen[tuple(r[i : i + n])] > 1:
                gone |= set(range(p[i][0], p[i + n - 1][1]))
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


@pytest.mark.parametrize("large", [1, 1024])
def test_stage_cuts_short_passages(spark, docs, large):
    rng = random.Random(8)
    texts = []
    for size in (50, 51, 55, 60, 51):
        shared = words(rng, size, 90)
        assert len(shared) < 400
        for _ in range(3):
            one, two, three, four = (words(rng, n, 10**6) for n in (60, 40, 30, 50))
            texts += [f"{one}\n{shared} é{two}", f"ß {three} {shared}\t{four} {shared} x"]
    table = docs(list(enumerate(texts)))
    stage = corpus_pipeline.without_repeats(spark, table, MEDIUM) if large > 1 else suffix_dedup.cut_repeats(
        table, words=51, large=large)
    expected = plain_cut(texts)
    assert expected[0] == texts[0] and expected[6] != texts[6]
    assert {r.doc_id: r.text for r in stage.collect()} == dict(enumerate(expected))


def test_suffix_query_returns_texts_without_short_passages(spark, docs, tmp_path):
    """Passages of over 50 words and under 400 bytes stay in the bytes of op6, and go from its last column."""
    rng = random.Random(9)
    short, fifty, long = words(rng, 51, 90), words(rng, 50, 90), words(rng, 90)
    assert len(short.encode()) < 400 < len(long.encode())
    own = [words(rng, 60, 10**6) for _ in range(8)]
    texts = [f"{own[0]} é\n{short} {own[1]}", f"{short}\t{own[2]}", f"{own[3]} {fifty}", f"{fifty} {own[4]}",
             f"{own[5]} x{long}", f"{long}y {own[6]}", own[7], ""]
    rows = [*enumerate(texts[:-1]), (7, None)]
    docs(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op6_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert [i for i, r in sorted(found.items()) if r.n_removed] == [4, 5]
    assert all(found[i].text == texts[i] for i in (0, 1, 2, 3, 6, 7))
    last = {i: r.text_without_passages for i, r in found.items()}
    stage = suffix_dedup.cut_repeats(docs(rows), words=51)
    assert last == {r.doc_id: r.text or "" for r in stage.collect()}
    assert {i: last[i] for i in (0, 1, 2, 3, 6, 7)} == {
        0: f"{own[0]} é\n {own[1]}", 1: f"\t{own[2]}", 2: texts[2], 3: texts[3], 6: own[7], 7: ""}
    assert (last[4], last[5]) == (f"{own[5]} x", f"y {own[6]}")


def test_crowded_buckets_make_few_rows(docs):
    """One passage in many documents: rows for stretches and the ends of a passage, not one for every window."""
    rng = random.Random(10)
    passage = words(rng, 110)
    assert 500 < len(passage) < 600
    texts = []
    for i in range(60):
        before, after = (words(rng, rng.randrange(80, 120), 10**6) for _ in range(2))
        shared = passage if i % 6 else passage[rng.randrange(200) :]
        texts.append(f"{before} {shared}{rng.choice(['', ' ', 'é'])}{after}" + (" " + passage[:450] if i % 7 == 0 else ""))
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]
    table = docs(rows)
    for length, q, in_words in ((400, 128, False), (51, 17, True)):
        few, one_task = (
            suffix_dedup.repeated(table, length, q, large, words=in_words).collect() for large in (1, 1024)
        )
        spread = [{(r.doc_id, r.body, r.pos + k) for r in found for k in range(r.n)} for found in (few, one_task)]
        assert spread[0] == spread[1]
        assert in_words or len(few) < len(spread[0]) / 3
    found = suffix_dedup.remove_repeats(table, large=1, words=51).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(
        (i or -1, *e) for (i, _), e in zip(rows, plain_repeats([t for _, t in rows], 400))
    )

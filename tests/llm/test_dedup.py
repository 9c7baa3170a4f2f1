"""SimHash and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from estatelens.llm import queries, simhash, suffix_dedup
from tests.llm.support import MEDIUM, SMALL, docs, words  # noqa: F401  (docs is a fixture)


def plain_fingerprint(text):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_repeats(texts, length):
    """(n_removed, n_spans, kept) of each text by looking at every window."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])))
    return out


@pytest.fixture(scope="module")
def medium(spark):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").orderBy("doc_id").collect()
    return [r.doc_id for r in rows], [r.text for r in rows]


def test_simhash_query_equals_brute_force(spark, medium):
    ids, texts = medium
    fps = [plain_fingerprint(t) for t in texts]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in
             queries.QUERIES["op5_simhash_near_dedup"](spark, MEDIUM).collect()}
    assert found == {
        i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, plain_components(fps))
    }


def test_suffix_query_equals_brute_force(spark, medium):
    ids, texts = medium
    found = {r.doc_id: r for r in queries.QUERIES["op6_suffix_array_dedup"](spark, MEDIUM).collect()}
    for i, t, (gone, spans, kept) in zip(ids, texts, plain_repeats(texts, 400)):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t.encode()), gone, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("large", [1, 1024])
def test_suffix_dedup_on_planted_passages(docs, large):
    """Passages at odd places, shared tails, periodic texts, and crowded buckets."""
    rng = random.Random(large)
    passages = [words(rng, 12) for _ in range(4)]
    texts = ["", None, "é" * 90, "ab" * 60, "ab" * 60, "ab" * 20, words(rng, 3)]
    for i in range(60):
        text = words(rng, rng.randrange(30))
        for p in rng.sample(passages, rng.randrange(3)):
            text += rng.choice(["", " ", "ö"]) + p[rng.randrange(9) :] + words(rng, rng.randrange(20))
        texts.append(text)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (9, texts[9])]
    found = suffix_dedup.remove_repeats(docs(rows), length=40, q=16, large=large).collect()
    expected = plain_repeats([t for _, t in rows], 40)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == sorted(
        (i or -1, len((t or "").encode()), *e) for (i, t), e in zip(rows, expected)
    )


def test_suffix_dedup_of_very_long_texts(docs):
    """One word without end, a short period, and two long texts that share their middle."""
    rng = random.Random(3)
    first, middle, last = (words(rng, 60_000, 10**6) for _ in range(3))
    rows = [(1, "w" * 200_000), (2, "ab" * 100_000), (3, first + middle), (4, middle + last), (5, "x" * 399 + "é")]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    sizes = {i: len(t.encode()) for i, t in rows}
    gone = {1: sizes[1], 2: sizes[2], 3: len(middle), 4: len(middle), 5: 0}
    assert {i: (r.n_bytes, r.n_removed) for i, r in found.items()} == {i: (sizes[i], gone[i]) for i in sizes}
    assert bytes(found[3].kept) == first.encode() and bytes(found[4].kept) == last.encode()
    assert [tuple(s) for s in found[4].spans] == [(0, len(middle))]


def test_empty_tables(docs):
    empty = docs([(1, "x")]).where("false")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_crowded_blocks_lose_no_link(spark):
    """Fingerprints that share most blocks are dealt anew and still all linked."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ rng.getrandbits(14) for _ in range(600)} | {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    place = {f: i for i, f in enumerate(fps)}
    for large in (2, 1024):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for r in simhash.links(nodes, large=large).collect():
            u, v = r.u % (1 << 64), r.v % (1 << 64)
            assert (u ^ v).bit_count() <= 3
            a, b = find(place[u]), find(place[v])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == plain_components(fps)


@pytest.mark.parametrize("large", [1, 1024])
def test_links_over_the_highest_bit(spark, large):
    near = [{63, 0}, {63, 30, 40}, {63, 62, 61}, {63}]
    rng = random.Random(6)
    pairs = []
    for flips in near:
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in flips)))
    far = rng.getrandbits(64)
    fps = [f for pair in pairs for f in pair] + [far, far ^ 0xFFFFFFFF00000000]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    found = {frozenset((r.u % (1 << 64), r.v % (1 << 64))) for r in simhash.links(nodes, large=large).collect()}
    assert found == set(map(frozenset, pairs))
    signed = np.array([far, far ^ 0xFFFFFFFF00000000], np.uint64).view(np.int64)
    assert simhash._forest(signed, 3) == []


def test_one_document_of_each_group_stays(docs):
    same = "one two three four five six seven eight"
    rows = [(4, same), (2, same.upper()), (2, same), (None, same), (None, None), (None, ""), (7, "other words here")]
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()) == [
        (0, ""), (2, same), (7, "other words here")
    ]


def test_one_row_stays_whatever_repeats(spark):
    """Repeated doc_ids with other texts, rows without doc_id, long texts, and columns named like the helpers."""
    rng = random.Random(12)
    texts = [words(rng, 60, 10**6) for _ in range(4)] + ["w" * 3_000_000, "long " * 500_000]
    rows = [(i, t, f"{i} {t[:9]}", 1, 2, 3) for t in texts for i in (8, 5, 5, None, 8)]
    rows += [(5, texts[0].replace("1", "2", 1), "near", 1, 2, 3)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, row string, bare int, n int, root int")
    fps = [plain_fingerprint(r[1]) if len(r[1]) < 10**6 else simhash.fingerprint(r[1].encode()) for r in rows]
    groups = {}
    for c, r in zip(plain_components(fps), rows):
        groups.setdefault(c, []).append(r)
    kept = simhash.keep_one(table).collect()
    assert len(kept) == len(groups) >= 5
    for members in groups.values():
        least = min(r[0] for r in members if r[0] is not None)
        assert sum(tuple(k) in members and k.doc_id == least for k in kept) == 1


def test_near_duplicates_of_odd_rows(docs):
    rows = [(5, None), (3, ""), (3, ""), (None, " \n"), (8, "a"), (9, "A")]
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect())
    assert found == [(0, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]


def test_queries_run_on_the_smallest_tables(spark):
    for name in ("op5_simhash_near_dedup", "op6_suffix_array_dedup"):
        assert queries.QUERIES[name](spark, SMALL).count() == 200

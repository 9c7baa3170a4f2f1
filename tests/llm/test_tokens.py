"""Tokenizing, packing and token counts against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from estatelens.llm import bpe, packing, queries, token_counts
from tests.llm.support import MEDIUM, SMALL, docs  # noqa: F401  (docs is a fixture)

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [
    None, "", "  a", " \n b", "a \n\nb", "x  y", "　 z", "don't we'll 's", " 12 34\n5", "a" * 1000,
    "日本語 テスト\nあ", "\n\nab\n c\t d ", "é é\n", "aaaa aaaaa aaaaaa", "#### !!!\n??\n", "a\x1cb \x1d c",
    " x   y", "ΑΣ ΣΑΣ. Σ", "İstanbul ẞ ǅ", "é ạ̊ ́x", "𝒳𝒴 😀 😀😀\n😀", "!!'s x''s",
    "ﬁ ½ ²٣", "한국어 각", "\x00\x7f", "a​b\xa0c\x85d", "THE The the, THE. 'The' the!", "é, É. ×, ÷. a×,",
    "<|endoftext|>", "hello <|endoftext|> world", "x<|startoftext|><|endoftext|>É.<|endoftext|", "<|ENDOFTEXT|>", "a <|endof",
    "text|> b", "a\n<|startoftext|>\n" + "é b. " * 2000,
]


@pytest.fixture(scope="module")
def byte_library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def medium(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}


def check_digests(found, texts, library):
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids), text[:50]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_query_equals_library(spark, medium, byte_library):
    check_digests(queries.QUERIES["op4_byte_level_bpe"](spark, MEDIUM).collect(), medium, byte_library)


def test_bpe_of_odd_texts(docs, byte_library):
    texts = dict(enumerate(ODD))
    check_digests(bpe.digests(docs(texts.items()), RANKS, P.PATTERN).collect(), texts, byte_library)
    encoded = bpe.encode(docs(texts.items()), RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, RANKS).collect()} == {
        i: (t or "").encode() for i, t in texts.items()
    }


def test_replay_of_random_words(byte_library):
    rng = random.Random(3)
    replay = bpe.Replay(bpe.load_ranks(RANKS))
    words = ["".join(rng.choices("aabtheé'", k=rng.randrange(1, 40))) for _ in range(3000)]
    for word, ids in zip(words, replay.encode([w.encode() for w in words])):
        assert ids.tolist() == byte_library._encode_single_piece(word), word


def test_forgetful_encoders_give_the_same_ids(medium, byte_library):
    import pyarrow as pa

    from estatelens.llm.common import texts_of
    from estatelens.llm.units import UnitEncoder

    replay = bpe.Replay(bpe.load_ranks(RANKS))
    units = UnitEncoder(bpe.WordEncoder(replay, P.PATTERN, most=1000), most=1000)
    texts = list(medium.values())
    for a in range(0, 300, 50):
        ids, at = units.texts(*texts_of(pa.array(texts[a : a + 50])))
        for i, t in enumerate(texts[a : a + 50]):
            assert ids[at[i] : at[i + 1]].tolist() == byte_library.encode_ordinary(t)


def check_packing(found, texts, library):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    total = 0
    for i, own in pieces.items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        cut = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert [(r.piece, r.start, r.length) for r in own] == [(n, n * 4096, len(c)) for n, c in enumerate(cut)]
        for r, c in zip(own, cut):
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(bins), -(-total // 4096)


def test_packing_query(spark, medium, word_library):
    found = queries.QUERIES["op3_best_fit_packing"](spark, MEDIUM).collect()
    used, least = check_packing(found, medium, word_library)
    assert used <= least + 1


def test_packing_of_odd_texts(docs, word_library):
    texts = dict(enumerate(ODD)) | {1000: "wörd, " * 9000, 1001: "wörd, " * 9000}
    check_packing(packing.pack(docs(texts.items()), WORDS, salts=3).collect(), texts, word_library)


def test_packing_of_repeated_and_nameless_rows(docs):
    rows = [(1, "same")] * 50 + [(None, "same")] * 3
    found = packing.pack(docs(rows), WORDS, capacity=5).collect()
    assert len(found) == 53 and all(r.length == 2 for r in found)
    assert len({(r.sequence_id, r.offset) for r in found}) == 53
    assert packing.pack(docs(rows).where("false"), WORDS).count() == 0


def test_plan_is_whole_and_tight():
    rng = random.Random(1)
    for capacity, n in ((64, 200), (100, 30), (7, 50)):
        counts = defaultdict(int)
        for _ in range(n):
            counts[rng.randrange(1, capacity + 1)] += rng.randrange(1, 9)
        bins = packing.plan(counts, capacity)
        packed = defaultdict(int)
        for times, found in bins:
            assert sum(x * k for x, k in found.items()) <= capacity
            for x, k in found.items():
                packed[x] += k * times
        assert packed == counts


def test_fullest_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        left = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 40)
        sums = {0}
        for x, n in left.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        found = packing.fullest(left, room)
        assert all(found[x] <= left[x] for x in found)
        assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= room)


def plain_counts(text, spans, library, rule):
    """Tokens of each span, one token and one character at a time."""
    owner = {}
    for s, (a, b) in enumerate(spans):
        owner.update((c, s) for c in range(a, b))
    place = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, at = [0.0] * len(spans), 0
    for token in library.encode_ordinary(text):
        size = len(library.decode_single_token_bytes(token))
        covered = sorted(set(place[at : at + size]))
        at += size
        shares = defaultdict(int)
        for c in covered:
            if c in owner:
                shares[owner[c]] += 1
        if rule == "split":
            for s, n in shares.items():
                counts[s] += n / len(covered)
        elif rule == "first" and covered[0] in owner:
            counts[owner[covered[0]]] += 1
        elif rule == "largest" and shares:
            counts[min(shares, key=lambda s: (-shares[s], s))] += 1
    return counts


def lines(text):
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return spans


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_of_lines(docs, byte_library, rule):
    texts = dict(enumerate(ODD)) | {100: "a\n\n\nb\n", 101: "\n", 102: "😀\n😀😀 é\n\n"}
    found = defaultdict(dict)
    for r in token_counts.attribute(docs(texts.items()), RANKS, P.PATTERN, rule=rule).collect():
        found[r.doc_id][r.section] = (r.start, r.end, r.n_tokens)
    for i, text in texts.items():
        spans = lines(text or "")
        counts = plain_counts(text or "", spans, byte_library, rule)
        assert [found[i][s][:2] for s in range(len(spans))] == spans
        assert [found[i][s][2] for s in range(len(spans))] == pytest.approx(counts)


def test_counts_of_given_sections(spark, docs, byte_library):
    texts = {1: "name: value and more words", 2: None, 3: "zzz", 4: "no sections"}
    spans = {1: [(2, 9), (9, 9), (12, 20)], 3: [(0, 3)]}
    table = spark.createDataFrame([(i, a, b) for i, s in spans.items() for a, b in s], "doc_id bigint, start int, end int")
    given = token_counts.with_sections(docs(texts.items()), table)
    for rule in token_counts.RULES:
        found = defaultdict(list)
        for r in sorted(token_counts.attribute(given, RANKS, P.PATTERN, "sections", rule).collect(), key=lambda r: r.section):
            found[r.doc_id].append(r.n_tokens)
        assert found.keys() == spans.keys()
        for i, s in spans.items():
            assert found[i] == pytest.approx(plain_counts(texts[i], s, byte_library, rule))


def test_counts_query(spark, medium, byte_library):
    found = defaultdict(int)
    for r in queries.QUERIES["op9_token_counts"](spark, MEDIUM).collect():
        found[r.doc_id] += r.n_tokens
    assert found == {i: len(byte_library.encode_ordinary(t)) for i, t in medium.items()}


def test_tokens_of_an_empty_table(docs):
    empty = docs([(1, "x")]).where("false")
    assert bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    assert token_counts.attribute(empty, RANKS, P.PATTERN).count() == 0


def test_small_tables(spark):
    for name in ("op3_best_fit_packing", "op4_byte_level_bpe", "op9_token_counts"):
        assert queries.QUERIES[name](spark, SMALL).count() >= 200

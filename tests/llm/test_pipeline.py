"""The pipeline against plain versions of its stages."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from estatelens.llm import suffix_dedup
from tests.llm.support import MEDIUM, docs  # noqa: F401  (docs is a fixture)
from tests.llm.test_dedup import plain_components, plain_fingerprint
from tests.llm.test_tokens import check_packing

SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def plain_good(text):
    words, text = words_of(text), text or ""
    n, chars = len(words), sum(map(len, words))
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {i + d for i, w in enumerate(windows) if seen[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    capitals = sum("A" <= c <= "Z" for c in text)
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or 10 * symbols > n
        or 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
        or chars < 3 * n or chars > 12 * n or 2 * capitals > chars
    )


def plain_cut(texts, length=400, n=51):
    """Texts without the bytes of repeated byte windows, whole characters only, and of repeated word windows."""
    data = [(t or "").encode() for t in texts]
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in data]
    runs = [[t[a:b] for a, b in p] for t, p in zip(data, places)]
    by_bytes = Counter(t[p : p + length] for t in data for p in range(len(t) - length + 1))
    by_words = Counter(tuple(r[i : i + n]) for r in runs for i in range(len(r) - n + 1))
    out = []
    for t, p, r in zip(data, places, runs):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if by_bytes[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for c in re.finditer(rb"[\xc0-\xff][\x80-\xbf]+", t):
            if not all(gone[c.start() : c.end()]):
                gone[c.start() : c.end()] = bytes(c.end() - c.start())
        for i in range(len(r) - n + 1):
            if by_words[tuple(r[i : i + n])] > 1:
                a, b = p[i][0], p[i + n - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(t, gone) if not g).decode())
    return out


def plain_texts(rows):
    """The texts that the whole pipeline packs, by doc_id."""
    kept = {i: t for i, t in sorted(rows) if plain_good(t)}
    ids = list(kept)
    classes = plain_components([plain_fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for n, i in enumerate(ids) if classes[n] == n}
    cut = dict(zip(kept, plain_cut(kept.values())))
    key = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    strong = re.compile(key + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""")
    return {i: strong.sub("[secret]", t) for i, t in cut.items()}


def test_pipeline_equals_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    used, least = check_packing(corpus_pipeline.run(spark, MEDIUM).collect(), plain_texts(rows), library)
    assert used <= least + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, MEDIUM).columns == docs.columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, body string, spans int"
    long = "wörd und text " * 60
    rows = [(1, None, None, None, None, "x", 1), (None, "", "de", "s", 0, None, None), (2, long, "de", "s", len(long), "x", 1),
            (2, long, "de", "s", len(long), "x", 1), (None, long, "de", "s", None, "x", 1),
            (3, "w" * 300_000, None, None, 300_000, "x", 1), (4, long * 500, None, None, None, "x", 1),
            (5, " ".join(f"w{i}é" for i in range(100_000)), None, None, None, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    stage(spark, docs, MEDIUM).collect()
    assert stage(spark, docs.where("false"), MEDIUM).count() == 0


def test_only_whole_characters_are_cut(docs):
    shared = "é" * 30
    table = docs([(1, "a" + shared + "ö"), (2, "b" + shared + "ü"), (3, None), (4, "short")])
    found = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(table, length=41, q=16).collect()}
    assert found == {1: "aö", 2: "bü", 3: None, 4: "short"}

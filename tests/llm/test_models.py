"""URL filter and nearest neighbours against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import neighbours, queries, urls
from tests.llm.support import MEDIUM

LARGE = "/root/testdata/sf0.1"
SPAM = ("ads", "spam", "casino", "adult", "pills", "bets")


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]


def plain_rule(host, path):
    fits = [r for r in queries.URL_RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_and_parts(spark):
    given = [None, "", "no scheme", "HTTP://A.NET/x?y#z", "http://net", "http://net/", "x://Example.COM/de/1",
             "http://example.com/de", "a://b://c.net/d", "http://www.example.net/en/?q", "http://xnet/", "http://x.org#/fr/",
             "http://x.org/fr/é", "http://ÄB.net/\nx", "http://a.net?x=/", "://", "http://u@example.com:80/de/"]
    rows = [(i, u, "x", 1) for i, u in enumerate(given)] + [(None, given[3], "x", 1), (3, given[3], "x", 1)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule int")
    found = urls.classify(table, queries.URL_RULES)
    judged = found.collect()
    assert len(judged) == len(rows)
    for r in judged:
        url = given[3 if r.page_id is None else r.page_id]
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urls.classify(table.where("false"), queries.URL_RULES).count() == 0


def test_accuracy_on_urls_that_were_not_learnt(spark):
    """Hosts of the test pages that no rule decides, with telling names or without."""
    found = queries.QUERIES["op8_url_filters"](spark, LARGE)
    assert found.count() == spark.read.parquet(f"{LARGE}/pages.parquet").count()
    right = {True: [], False: []}
    for r in found.where("rule is null").collect():
        spam = any(w in r.host for w in SPAM)
        right[spam].append((r.verdict == "block") == spam)
    assert len(right[True]) > 5 and np.mean(right[True]) > 0.9
    assert np.mean(right[False]) > 0.95


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([(None, 1.0), ("http://b.com/", None)], "url string, label double")
    assert [r.verdict for r in urls.classify(pages, [], none).collect()] == ["allow"]


def test_learning_from_what_rules_decide(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    sample = urls.labelled_sample(pages, queries.URL_RULES, most=60)
    assert sample.count() == 60
    held = urls.labelled_sample(pages, queries.URL_RULES).subtract(sample)
    judged = urls.classify(held.withColumn("page_id", F.lit(1)), [], sample).groupBy("verdict").count().collect()
    assert {r.verdict for r in judged} == {"allow", "block"}


def plain_nearest(rows, asked, k=5):
    """Exact neighbours by cosine of (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        score = (x * x[at]).sum(1) / (norms * norms[at])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("sf_dir", [MEDIUM, LARGE])
def test_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    exact = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    found = {}
    for r in queries.QUERIES["op10_nearest_neighbours"](spark, sf_dir).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert found.keys() == exact.keys()
    hits = sum(len({i for i, _ in exact[q]} & {i for i, _ in found[q].values()}) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, best in found.items():
        assert sorted(best) == list(range(1, len(best) + 1))
        order = [best[n] for n in sorted(best)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        for i, score in order:
            a, b = vectors[q], vectors[i]
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_neighbours_of_odd_vectors(spark):
    rng = random.Random(4)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(0, 120)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200, 260)]
    bad = [(300, None), (301, []), (302, [0.0] * 4), (303, [None, 1.0, 1.0, 1.0]), (304, [float("nan"), 1.0, 1.0, 1.0]),
           (350, [float("inf"), 1.0, 1.0, 1.0]), (None, same), (400, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad],
                                  "vec_id bigint, embedding array<float>, rank int, score double")
    asked = table.where("vec_id % 50 = 0")
    found = {}
    for r in neighbours.nearest(table, asked, least_block=20).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = plain_nearest([(i, [float(np.float32(x)) for x in v]) for i, v in rows], [0, 50, 100, 200, 250])
    assert found.keys() == exact.keys()
    for q in (0, 50, 100):
        assert [i for i, _ in found[q]] == [i for i, _ in exact[q]]
    assert neighbours.nearest(table.where("false"), asked.where("false")).count() == 0
    few = neighbours.nearest(table.where("vec_id in (200, 201, 202)"), asked.where("vec_id = 200"))
    assert sorted(r.vec_id for r in few.collect()) == [201, 202]


@pytest.mark.parametrize("times", [2, 10])
def test_neighbours_of_repeated_rows(spark, times):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    # other vectors of the same ids, close to the first query but less close than its copies
    near = [(7, [x + 0.001 * j for x in rows[0][1]]) for j in range(1, times)]
    table = spark.createDataFrame(rows * times + near, "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, table.where("vec_id % 50 = 0"), least_block=20).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 50, 100):
        order = [i for i, _ in plain_nearest(rows + near, [q], len(rows + near))[q]]
        assert found[q] == list(dict.fromkeys(order))[:5]


def test_neighbours_of_tiny_and_huge_vectors(spark):
    """Squares of such components vanish or overflow; the cosine does neither."""
    scales = [1.0, 1e-200, 1e200, 1e-308, 5e-324, 1.7e308]
    rng = random.Random(10)
    base = [[rng.choice((-1.0, 0.5, 1.0)) for _ in range(4)] for _ in range(80)]
    base += [[1.0, 1.0, 1.0, 1.0], [1.0, 2.0, 0.0, 0.0]]
    rows = [(i, [x * scales[i % 5] for x in v]) for i, v in enumerate(base)] + [(99, [1.7e308, -1.7e308, 1.7e308, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table, table.where("vec_id in (0, 1, 2, 99)"), least_block=40).orderBy("rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    largest = [(i, [x / max(map(abs, v)) for x in v]) for i, v in rows]
    exact = plain_nearest(largest, [0, 1, 2, 99])
    assert found.keys() == exact.keys()
    for q, best in found.items():
        assert [s for _, s in best] == pytest.approx([s for _, s in exact[q]], abs=1e-12)


def test_few_vectors_are_verified(spark):
    """The index reads the cosine of less than a fifth of the vectors, and still finds the nearest."""
    rows = spark.read.parquet(f"{LARGE}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = np.array([r.embedding for r in rows], float)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    index, ids = neighbours.Index(units), np.arange(len(units))
    shares, hits = [], []
    asked = np.arange(0, len(units), 50)
    for i, found in index.searched(units[asked], asked, 6, ids):
        q = asked[i]
        shares.append(len(found) / len(units))
        score = units @ units[q]
        score[q] = -2
        hits.append(np.isin(np.argsort(-score)[:5], found).mean())
    assert np.mean(shares) < 0.2 and np.mean(hits) >= 0.9


# Written down before the model was asked about them; none is in the labelled table or on the test pages.
HELD_BLOCK = (
    "lucky-casino casinogold pokerstars-bet online-pills pillshop adultcams adult-clips spam-king freespamlist "
    "betting-tips ad-tracker trackerhub adserver-pro xxx-movies cheapviagra-pills"
).split()
HELD_ALLOW = (
    "botany geology sculpture orchestra kindergarten hospital mathematics lighthouse chemistry poetry "
    "university architecture philosophy railway ceramics"
).split()


def test_accuracy_on_names_held_out(spark):
    rows = [(u, label) for u, label in urls.labelled_names(HELD_BLOCK, HELD_ALLOW)]
    assert not {n for n in HELD_BLOCK + HELD_ALLOW} & {*urls.BLOCK_NAMES, *urls.ALLOW_NAMES}
    table = spark.createDataFrame([(i, u, label) for i, (u, label) in enumerate(rows)], "page_id bigint, url string, label double")
    found = {r.page_id: r.verdict == "block" for r in urls.classify(table, []).collect()}
    right = [found[i] == bool(label) for i, (_, label) in enumerate(rows)]
    blocked = [r for r, (_, label) in zip(right, rows) if label]
    allowed = [r for r, (_, label) in zip(right, rows) if not label]
    assert np.mean(blocked) > 0.85 and np.mean(allowed) > 0.75, (np.mean(blocked), np.mean(allowed))

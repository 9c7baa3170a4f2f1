"""Quality rules as a short-circuit cascade.

A rule rejects a document by features, which are column expressions. Features
are evaluated only for documents that no earlier rule has rejected. The order is
chosen on a sample: rules with the most rejections for their cost go first. Both are
taken at the rule's place in the cascade: rejections among the documents that earlier
rules leave, and the cost of the features that no earlier step has computed, by the
characters, words and lines of those documents. The order changes what is evaluated,
never a verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``reject`` over features; ``features`` are those it needs, in the order they build on each other."""

    name: str
    reject: str
    features: tuple[str, ...] = field(default=())


def _words() -> Column:
    trimmed = F.btrim(_text(), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _windows() -> Column:
    """A 64-bit name for each 3-word window."""
    names = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    return F.slice(names, 1, F.greatest(F.size("words") - 2, F.lit(0)))


def _sorted_windows() -> Column:
    """Window names with their places in order; empty if no name occurs twice."""
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    return F.when(twice, F.sort_array(placed)).otherwise(F.slice(placed, 1, 0))


def _repeated_words() -> Column:
    """Words in windows that occur twice or more, the first occurrence included."""
    def place(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get("sorted_windows", j)["h"] == x["h"], F.lit(False))
        return F.when(same(i - 1) | same(i + 1), x["i"])

    return F.array_compact(F.transform("sorted_windows", place))


def _covered() -> Column:
    shifted = lambda by: F.transform("repeated_at", lambda p: p + by)
    return F.size(F.array_distinct(F.concat("repeated_at", shifted(1), shifted(2)))).cast("bigint")


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


FEATURES = {
    "words": _words,
    "n_words": lambda: F.size("words").cast("bigint"),
    "word_chars": lambda: F.length(F.array_join("words", "")).cast("bigint"),
    "n_symbols": lambda: (F.length(_text()) - F.length(F.regexp_replace(_text(), f"[{SYMBOLS}]+", ""))).cast("bigint"),
    "lines": _lines,
    "n_lines": lambda: F.size("lines").cast("bigint"),
    "n_dup_lines": lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
    "windows": _windows,
    "sorted_windows": _sorted_windows,
    "repeated_at": _repeated_words,
    "n_repeat_words": _covered,
    "n_capitals": lambda: (F.length(_text()) - F.length(F.regexp_replace(_text(), "[A-Z]+", ""))).cast("bigint"),
}
_REPEATS = ("words", "n_words", "windows", "sorted_windows", "repeated_at", "n_repeat_words")

BASE_RULES = (
    Rule("few words", "n_words < 50", ("words", "n_words")),
    Rule("repeated words", "100 * n_repeat_words > 50 * n_words", _REPEATS),
)
# Shares as in published heuristics for web text: symbols to words, repeated lines, mean word length.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", ("words", "n_words", "n_symbols")),
    Rule("repeated lines", "10 * n_dup_lines > 3 * n_lines", ("lines", "n_lines", "n_dup_lines")),
    Rule("short words", "word_chars < 3 * n_words", ("words", "n_words", "word_chars")),
    Rule("long words", "word_chars > 12 * n_words", ("words", "n_words", "word_chars")),
    Rule("capitals", "2 * n_capitals > word_chars", ("words", "word_chars", "n_capitals")),
)


def with_features(df: DataFrame, names: tuple[str, ...], alive: Column | None = None) -> DataFrame:
    """``df`` with the features that it lacks; null where ``alive`` is false."""
    for name in names:
        if name not in df.columns:
            value = FEATURES[name]()
            df = df.withColumn(name, value if alive is None else F.when(alive, value))
    return df


def cascade(df: DataFrame, rules: list[Rule], alive: Column) -> DataFrame:
    """``df`` with ``kept``: false where ``alive`` is, or where a rule rejects. Rules run in the given order."""
    df = df.withColumn("kept", alive)
    for rule in rules:
        df = with_features(df, rule.features, F.col("kept"))
        df = df.withColumn("kept", F.col("kept") & ~F.coalesce(F.expr(rule.reject), F.lit(False)))
    return df


# Nanoseconds for each unit of a document's text, measured on one core over 4,000 documents of a test table
# while other work ran; only their proportions matter.
COSTS = {
    "words": ("chars", 80.0), "n_words": ("documents", 1000.0), "word_chars": ("words", 100.0), "n_symbols": ("chars", 40.0),
    "lines": ("chars", 18.0), "n_lines": ("documents", 1000.0), "n_dup_lines": ("lines", 2400.0), "windows": ("words", 550.0),
    "sorted_windows": ("words", 650.0), "repeated_at": ("words", 220.0), "n_repeat_words": ("words", 40.0),
    "n_capitals": ("chars", 44.0),
}
_TEST = 50.0  # for the comparison itself, each document


def ordered(
    docs: DataFrame, rules: tuple[Rule, ...], rows: int = 200, share: float = 0.1,
    known: tuple[str, ...] = (), after: tuple[Rule, ...] = (),
) -> list[Rule]:
    """The rules by rejections for their cost on a sample, one after the other.

    The sample is the first ``rows`` of a random ``share`` of the documents, which ``take``
    finds without reading a large table; of a small one the first ``rows``. ``known`` features cost nothing any more; documents
    that rules in ``after`` reject are not counted. Equal rules keep their order.
    """
    spark = docs.sparkSession
    taken = docs.select("text").sample(share, seed=42).take(rows)
    if len(taken) < rows:
        taken = docs.select("text").take(rows)
    if not taken:
        return list(rules)
    needed = dict.fromkeys(f for r in rules + after for f in (*r.features, "words", "n_words", "lines", "n_lines"))
    sample = with_features(spark.createDataFrame(taken, "text string"), tuple(needed))
    found = sample.select(
        F.length(_text()), "n_words", "n_lines",
        *(F.coalesce(F.expr(r.reject), F.lit(False)) for r in rules + after),
    ).collect()
    units = [dict(zip(("chars", "words", "lines"), row), documents=1) for row in found]
    rejects = [dict(zip((r.name for r in rules + after), row[3:])) for row in found]
    alive = [i for i, r in enumerate(rejects) if not any(r[rule.name] for rule in after)]
    have, left, order = set(known), list(rules), []

    def gain(rule: Rule) -> float:
        costs = [COSTS[f] for f in rule.features if f not in have]
        spent = sum(_TEST + sum(ns * units[i][unit] for unit, ns in costs) for i in alive)
        return sum(rejects[i][rule.name] for i in alive) / spent if alive else 0.0

    while left:
        best = max(left, key=gain)  # the first of equal ones
        left.remove(best)
        order.append(best)
        have.update(best.features)
        alive = [i for i in alive if not rejects[i][best.name]]
    return order


def _without_clashes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's doc_id, base features, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails. Repeated rows are judged each;
    other columns are ignored.
    """
    counts = ("words", "n_words", "word_chars", "n_symbols", "lines", "n_dup_lines", *_REPEATS)
    judged = with_features(_without_clashes(docs), counts)
    failed = F.lit(False)
    for rule in BASE_RULES:
        failed = failed | F.expr(rule.reject)
    judged = judged.withColumn("base_failed", failed)
    order = ordered(_without_clashes(docs), rules, known=counts, after=BASE_RULES)
    judged = cascade(judged, order, ~F.col("base_failed"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_row"))
    order = ordered(docs.select("text"), rules)
    # A filter on a plain column would be pushed through all the steps of the cascade, which copies
    # their expressions into each other; with an identifier in it, it stays where it is.
    kept = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return cascade(whole, order, F.lit(True)).withColumn("kept", kept).where("kept").select("_row.*")

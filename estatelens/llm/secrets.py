"""Secret scan with multipart credential linking.

Strong candidates are reported by themselves: assigned values, access
identifiers and long hexadecimal runs. Weak candidates - short assigned values,
tokens of 40 characters, user names, endpoints - say little alone. They are
reported only where a complementary part stands in their scope, the stretch of
text around them: an identity or an endpoint for a secret, a secret for an
identity or an endpoint. Parts are joined with the scopes by a sweep over the
sorted intervals of each text, which meets the nearest part of each role on
either side, so a text full of parts makes no pairs of parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch

_KEY = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
    "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
_USER = "([Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn])"
_PLACE = "([Ee][Nn][Dd][Pp][Oo][Ii][Nn][Tt]|[Hh][Oo][Ss][Tt]|[Uu][Rr][Ll])"
_IS = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "([A-Za-z0-9+/_.=-]+)"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


@dataclass(frozen=True)
class Kind:
    """Matches of ``pattern`` whose ``group`` has ``least`` to ``most`` characters.

    Texts that ``probe`` doesn't match have none and are not searched.
    """

    name: str
    pattern: str
    probe: str
    group: int = 0
    least: int = 1
    most: int = 1 << 30
    role: str = ""


BASE = (
    Kind("assign", _KEY + _IS + _VALUE, _KEY + _IS + "[A-Za-z0-9+/_.=-]{12}", 2, 12, role="secret"),
    Kind("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14}", 0, 18, role="identity"),
    Kind("hex", "[0-9a-f]+", "[0-9a-f]{16}", 0, 16),
)
WEAK = (
    Kind("short_assign", _KEY + _IS + _VALUE, _KEY + _IS + "[A-Za-z0-9+/_.=-]", 2, 6, 11, "secret"),
    Kind("token40", "[A-Za-z0-9+/]{40,}", "[A-Za-z0-9+/]{40}", 0, 40, 40, "secret"),
    Kind("user", _USER + _IS + "([A-Za-z0-9_.@-]+)", _USER + _IS, 3, 3, role="identity"),
    Kind("endpoint", _PLACE + _IS + "([A-Za-z0-9_.:/?@%-]+)", _PLACE + _IS, 2, 4, role="endpoint"),
)
COMPLEMENTS = {"secret": ("identity", "endpoint"), "identity": ("secret",), "endpoint": ("secret",)}
SCOPE = 200


def _matches(kind: Kind, number: int) -> Column:
    """The kind's matches in order: text before it, its own length, length of its group."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(_text(), pattern, F.lit(0))
    value = F.regexp_extract_all(_text(), pattern, F.lit(kind.group))
    zipped = F.arrays_zip(F.split(_text(), kind.pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    # the split has one piece more than there are matches
    found = F.transform(F.slice(zipped, 1, F.greatest(F.size(zipped) - 1, F.lit(0))), lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"),
        F.length(x["match"]).alias("size"), F.length(x["value"]).alias("worth"),
    ))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,worth:int>>")
    return F.when(_text().rlike(kind.probe), found).otherwise(empty)


def _placed(scanned: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """(doc_id, body, kind, start, end, role, strong) of the matches that are long and short enough."""
    rows = scanned.where(F.size("parts") > 0).dropDuplicates(["doc_id", "body"])
    rows = rows.select("doc_id", "body", F.explode("parts").alias("p")).select("doc_id", "body", "p.*")
    before = Window.partitionBy("doc_id", "body", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    fits, role = F.lit(False), F.lit("")
    for number, kind in enumerate(kinds):
        fits = fits | ((F.col("kind") == number) & F.col("worth").between(kind.least, kind.most))
        role = F.when(F.col("kind") == number, kind.role).otherwise(role)
    return rows.where(fits).select(
        "doc_id", "body", "kind", (F.col("end") - F.col("size")).alias("start"), "end",
        role.alias("role"), (F.col("kind") < len(BASE)).alias("strong"),
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Strong parts, and weak ones outside of them with a complementary part in scope."""
    ahead = Window.partitionBy("doc_id", "body").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("doc_id", "body").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    columns = {
        "_covered": F.max(F.when(F.col("strong"), F.col("end"))).over(ahead),
        "_covers": F.min(F.when(F.col("strong"), F.col("start"))).over(back),
    }
    for role in COMPLEMENTS:
        columns[f"_{role}_end"] = F.max(F.when(F.col("role") == role, F.col("end"))).over(ahead)
        columns[f"_{role}_start"] = F.min(F.when(F.col("role") == role, F.col("start"))).over(back)
    near = F.lit(False)
    for role, others in COMPLEMENTS.items():
        for other in others:
            close = (F.col("start") - F.col(f"_{other}_end") <= scope) | (F.col(f"_{other}_start") - F.col("end") <= scope)
            near = near | ((F.col("role") == role) & F.coalesce(close, F.lit(False)))
    apart = ~F.coalesce((F.col("_covered") > F.col("start")) | (F.col("_covers") < F.col("end")), F.lit(False))
    return parts.withColumns(columns).where(F.col("strong") | (near & apart)).select(*parts.columns)


def scan(docs: DataFrame, weak: tuple[Kind, ...] = WEAK, scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, body, spans.

    ``body`` is a hash of the text, ``spans`` an array of (start, kind, end, name)
    in code points, end exclusive, sorted by start and then by the order of
    kinds; empty without findings. Spans of different kinds may overlap. A null
    text counts as empty; repeated rows stay; other columns are ignored.
    """
    kinds = BASE + tuple(weak)
    scratch = Scratch(docs.sparkSession, "secrets")
    parts = F.concat(*(_matches(kind, i) for i, kind in enumerate(kinds)))
    scanned = scratch.table(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(_text()).alias("body"), parts.alias("parts")),
        "scanned",
    )
    names = F.array(*(F.lit(k.name) for k in kinds))
    found = _linked(_placed(scanned, kinds), scope).groupBy("doc_id", "body").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", F.get(names, F.col("kind")).alias("name")))).alias("spans")
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "spans")
    rows = scanned.select("doc_id", "body")
    joined = rows.join(found, rows.doc_id.eqNullSafe(found._id) & (rows.body == found._body), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>")
    return joined.select("doc_id", "body", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of each strong kind, and the spans as text: of strong kinds, and of all."""
    found = scan(docs)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id", *(count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        as_text(base).alias("base"), as_text(F.col("spans")).alias("spans"),
    )


def mask(docs: DataFrame, with_what: str = "[secret]", **options) -> DataFrame:
    """The rows of ``docs`` with each stretch of overlapping spans replaced; n_chars follows if there is one."""
    found = scan(docs, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "body"])
    each = found.select("doc_id", "body", F.explode("spans").alias("s")).select("doc_id", "body", "s.start", "s.end")
    order = Window.partitionBy("doc_id", "body").orderBy("start", "end")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(past), F.lit(True)).cast("int"))
    each = each.withColumn("stretch", F.sum("new").over(order)).groupBy("doc_id", "body", "stretch").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    each = each.withColumn("kept_from", F.coalesce(F.lag("end").over(order), F.lit(0)))
    cuts = each.groupBy("doc_id", "body").agg(
        F.array_sort(F.collect_list(F.struct("kept_from", "start"))).alias("_cuts"), F.max("end").alias("_tail")
    ).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "_cuts", "_tail")
    own = docs.select("doc_id", F.xxhash64(_text()).alias("_own"), "text", F.struct(*docs.columns).alias("_row"))
    joined = own.join(cuts, own.doc_id.cast("bigint").eqNullSafe(cuts._id) & (own._own == cuts._body), "left")
    part = lambda c: F.substring(F.col("text"), c["kept_from"].cast("int") + 1, (c["start"] - c["kept_from"]).cast("int"))
    masked = F.concat(
        F.array_join(F.transform("_cuts", part), with_what), F.lit(with_what),
        F.substring(F.col("text"), F.col("_tail").cast("int") + 1, F.length("text")),
    )
    text = F.when(F.col("_cuts").isNotNull(), masked).otherwise(F.col("text"))
    out = joined.select("_row", text.alias("_text"))
    new = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_row")["n_chars"].isNotNull(), F.length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) for c in docs.columns))

"""Secret scan with multipart credential linking, on DataFrame functions only.

One pass over the texts finds, per kind, the lengths of the matches and of the
gaps before them (``split`` beside ``regexp_extract_all``; texts without a match
are not split). The matches become rows, and a running sum per document and
kind gives their offsets in code points.

Base kinds stand on their own. Weak kinds (an account name, an endpoint, a bare
high-entropy value) are reported only if a complementary part lies within
``SCOPE`` code points: both sides are dealt to (document, bin) cells of
``BIN`` code points, so that a cell holds a bounded number of parts however long
a text is, and an equi-join on the cell with an overlap test links them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SCOPE = 200
BIN = 1000

# Base patterns of the contract, then the weak kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""((?i:access_?key_?id|client_?id|account|username|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
# Scheme, host and path start; a run of scheme characters is entered at its start (or where the last match ended) only
# and never given back, so a run of any length is read once. Digits before the scheme's first letter are cut off afterwards.
ENDPOINT = r"(?:\G|(?<![a-z0-9+]))[0-9+]*+[a-z][a-z0-9+]*+://[A-Za-z0-9.:@_-]+"
VALUE = r"[A-Za-z0-9+/_=-]{32,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "account": ACCOUNT, "endpoint": ENDPOINT, "value": VALUE}
HINTS = {"access": "AKIA", "endpoint": "://"}  # a text without its kind's hint is not searched
LEADS = {"endpoint": "^[0-9+]*"}
BASE = ("assign", "access", "hex")
COMPLEMENTS = {
    "account": ("assign", "hex", "value"),
    "endpoint": ("assign", "access", "hex"),
    "value": ("access", "account"),
}


def _valid(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "account":
        return F.length(F.regexp_extract(match, ACCOUNT, 2)) >= 3
    if kind == "access":
        return F.length(match) >= 20
    if kind == "value":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    """Array of (gap before the match, length, valid) of the leftmost non-overlapping matches."""
    pattern = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def row(gap: Column, match: Column) -> Column:
        lead = F.length(F.regexp_extract(match, LEADS[kind], 0)) if kind in LEADS else F.lit(0)
        return F.struct((F.length(gap) + lead).cast("long").alias("gap"), (F.length(match) - lead).cast("long").alias("len"), _valid(kind, match).alias("ok"))

    found = F.size(matches) > 0
    if kind in HINTS:
        found = text.contains(HINTS[kind]) & found
    return F.when(found, F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, row))


def _cells(df: DataFrame, start: Column, end: Column) -> DataFrame:
    first, last = F.floor(F.greatest(start, F.lit(0)) / BIN), F.floor((end - 1) / BIN)
    return df.withColumn("bin", F.explode(F.sequence(first, last)))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans of each row of ``docs`` (doc_id, text, ...) as (doc_id, found).

    ``found`` is sorted by start and kind; offsets are code points, ends exclusive.

    * A null or empty text has no spans. Every row is scanned on its own, also where doc_ids repeat or are NULL.
    * Equal spans of different kinds are all reported. Other columns are not read.
    * An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = stage(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[_found(k, text).alias(k) for k in KINDS]), "matches"
    )
    rows = None
    for kind in KINDS:
        part = wide.filter(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        rows = part if rows is None else rows.union(part)
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(order)
    spans = stage(
        rows.select("row", "kind", end.alias("end"), F.col("m.len").alias("len"), F.col("m.ok").alias("ok")).filter("ok").select(
            "row", "kind", (F.col("end") - F.col("len")).alias("start"), "end"
        ),
        "spans",
    )
    pairs = F.lit(False)
    for weak, strong in COMPLEMENTS.items():
        pairs = pairs | ((F.col("kind") == weak) & F.col("kind2").isin(*strong))
    weak = _cells(spans.filter(F.col("kind").isin(*COMPLEMENTS)), F.col("start") - scope, F.col("end") + scope)
    others = _cells(spans, F.col("start"), F.col("end")).select(
        "row", "bin", F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2")
    )
    near = (F.col("start2") < F.col("end") + scope) & (F.col("start") - scope < F.col("end2"))
    apart = (F.col("start2") >= F.col("end")) | (F.col("start") >= F.col("end2"))
    linked = weak.join(others, ["row", "bin"]).filter(pairs & near & apart).select("row", "kind", "start", "end").distinct()
    kept = spans.filter(F.col("kind").isin(*BASE)).union(linked)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>")
    return wide.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", empty).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def summary(found: DataFrame) -> DataFrame:
    """Digest columns of a result of ``find_secrets``."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )

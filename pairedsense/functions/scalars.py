"""Column -> Column functions: clocks, ids, labels, bins, decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hourly-rate limits of the severity classes, lowest first.
SEVERITY_LIMITS = ((5.0, "normal"), (15.0, "mild"), (30.0, "moderate"))
SEVERITY_TOP = "severe"

# Modulus and multipliers of the integer mixer (any engine with 64-bit integers can evaluate it).
MIX_MODULUS = 2147483647
MIX_FACTORS = (73244475, 295559667)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clock_to_seconds(clock: Column | str) -> Column:
    """``hh:mm:ss[.f]`` to seconds; hours before noon belong to the following day."""
    parts = F.split(as_column(clock), ":")
    hours = F.element_at(parts, 1).cast("double")
    minutes = F.element_at(parts, 2).cast("double")
    seconds = F.element_at(parts, 3).cast("double")
    day = F.when(hours < 12, F.lit(86400.0)).otherwise(F.lit(0.0))
    return hours * 3600.0 + minutes * 60.0 + seconds + day


def relative_to(value: Column | str, origin: Column | str) -> Column:
    return as_column(value) - as_column(origin)


def stable_id(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined with ``|``."""
    texts = [as_column(p).cast("string") for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 16)


def experiment_key(**parts: object) -> str:
    """16 hex digits naming a configuration, whatever the order of its parts."""
    text = json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def experiment_key_column(**parts: Column | str) -> Column:
    """The same idea per row: SHA-256 of the JSON of the parts in name order."""
    fields = [as_column(parts[name]).alias(name) for name in sorted(parts)]
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def safe_name(text: Column | str) -> Column:
    blanks = F.regexp_replace(F.trim(as_column(text)), " ", "_")
    return F.substring(F.regexp_replace(blanks, r"[^A-Za-z0-9_\-.]", ""), 1, 180)


def label_from_keywords(text: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """1 on any positive keyword, else 0 on any negative one, else NULL."""
    name = F.lower(as_column(text))

    def holds(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.contains(name, F.lit(word.lower()))
        return found

    return F.when(holds(positive), F.lit(1)).when(holds(negative), F.lit(0)).otherwise(F.lit(None).cast("int"))


def patient_from_path(
    path: Column | str,
    mode: str = "parent",
    regex: str | None = None,
    separator: str = "_",
    fallback: Column | None = None,
) -> Column:
    """Patient id out of a file path; a regular expression wins over the mode when it matches."""
    path = as_column(path)
    steps = F.split(path, "/")
    depth = F.size(steps)
    if mode == "parent":
        found = F.when(depth >= 2, F.get(steps, depth - 2))
    elif mode == "grandparent":
        found = F.when(depth >= 3, F.get(steps, depth - 3))
    elif mode == "filename_prefix":
        stem = F.regexp_replace(F.get(steps, depth - 1), r"\.[^.]*$", "")
        found = F.get(F.split(stem, f"\\Q{separator}\\E"), F.lit(0))
    else:
        found = F.lit(None).cast("string")
    if regex:
        group = 1 if "(" in regex.replace("\\(", "").replace("(?:", "") else 0
        matched = F.regexp_extract(path, regex, group)
        found = F.coalesce(F.nullif(matched, F.lit("")), found)
    return F.coalesce(found, fallback) if fallback is not None else found


def severity_bin(rate: Column | str) -> Column:
    rate = as_column(rate)
    out = None
    for limit, name in SEVERITY_LIMITS:
        out = F.when(rate < limit, F.lit(name)) if out is None else out.when(rate < limit, F.lit(name))
    return out.otherwise(F.lit(SEVERITY_TOP))


def sigmoid_clip(score: Column | str, bound: float = 30.0) -> Column:
    clipped = F.greatest(F.least(as_column(score), F.lit(bound)), F.lit(-bound))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def predict(probability: Column | str, threshold: float = 0.5) -> Column:
    return (as_column(probability) >= F.lit(threshold)).cast("int")


def reroot(path: Column | str, marker: str, root: str) -> Column:
    """Move what follows the folder ``marker`` below another root; other paths stay."""
    return F.regexp_replace(as_column(path), rf"^.*?/{marker}/", root.rstrip("/") + "/")


def overlaps(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str, tol: float = 1e-9) -> Column:
    """Strict overlap of two intervals, shrunk by ``tol`` on both sides."""
    a0, a1, b0, b1 = (as_column(x) for x in (a0, a1, b0, b1))
    return (a0 < b1 - F.lit(tol)) & (a1 > b0 + F.lit(tol))


def mix_steps(value: Column | str) -> list[Callable[[Column], Column]]:
    """The steps of the integer mixer onto [0, 2^31-1), each a function of the column before.

    Every step uses its input twice, so the steps belong into separate
    projections (``with_mixed``) rather than into one nested expression.
    Products stay below 2^60: ANSI arithmetic never overflows.
    """
    modulus = F.lit(MIX_MODULUS).cast("long")
    start = as_column(value).cast("long")
    steps: list[Callable[[Column], Column]] = [lambda _: F.pmod(start, modulus)]
    for factor in MIX_FACTORS:
        steps.append(lambda x, f=factor: (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(f).cast("long")) % modulus)
    steps.append(lambda x: x.bitwiseXOR(F.shiftright(x, 15)) % modulus)
    return steps


def with_mixed(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """Add the mixed value of a column, one projection per step."""
    for step in mix_steps(value):
        df = df.withColumn(name, step(F.col(name) if name in df.columns else F.lit(0)))
    return df


def text_hash(seed: int | str, *parts: Column | str) -> Column:
    """Hex digest of seed and key: an order and a draw that do not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_column(p).cast("string") for p in parts]))


def text_draw(seed: int | str, *parts: Column | str) -> Column:
    """Uniform draw in [0, 1) from the first 8 hex digits of ``text_hash``."""
    number = F.conv(F.substring(text_hash(seed, *parts), 1, 8), 16, 10).cast("double")
    return number / F.lit(4294967296.0)


def r6(value: Column | str) -> Column:
    """Emit form of seconds and sums: six places, no negative zero."""
    return F.round(as_column(value), 6) + F.lit(0.0)


def r9(value: Column | str) -> Column:
    return F.round(as_column(value), 9) + F.lit(0.0)

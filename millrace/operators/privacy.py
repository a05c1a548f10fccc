"""Masking of personal data by shape and cue, as regular expressions in the JVM.

The passes run one after another on the masked text, so a mask can be a cue. A match that
needs a cue is one with a cue in the characters before it, written as a bounded
look-behind. Defined results: null texts stay null with no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed, text


def _cued(pattern: str, cues: tuple[str, ...], window: int) -> str:
    behind = "|".join(f"(?i:{cue})(?s:.){{0,{window - len(cue)}}}" for cue in cues)
    return f"(?={pattern})(?<={behind}){pattern}"  # the cheap look ahead first


def passes(shapes=fixed.SHAPES, cued=fixed.CUED_SHAPES, window: int = fixed.CUE_WINDOW, name: str = fixed.NAME_CUE) -> list[tuple[str, str, str]]:
    """kind, pattern and replacement of every pass."""
    out = [(kind, pattern, f"[{kind}_REDACTED]") for kind, pattern in shapes]
    out += [(kind, _cued(pattern, cues, window), f"[{kind}_REDACTED]") for kind, pattern, cues in cued]
    return [*out, ("NAME", name, "$1[NAME_REDACTED]")]


def mask(body: Column, steps: list[tuple[str, str, str]] | None = None) -> Column:
    for _, pattern, replacement in steps or passes():
        body = F.regexp_replace(body, pattern, replacement)
    return body


def scan(df: DataFrame, body: str = "text", steps: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Adds masked, findings (map of kind to count), found and quarantined (matches per word of the
    original text at or above the limit)."""
    current, counts, staged = F.col(body), [], df
    for n, (kind, pattern, replacement) in enumerate(steps or passes()):
        staged = staged.withColumn(f"_m{n}", F.regexp_replace(current, pattern, replacement))
        counts.append((kind, F.regexp_count(current, F.lit(pattern))))
        current = F.col(f"_m{n}")
    by_kind: dict[str, Column] = {}
    for kind, count in counts:
        by_kind[kind] = by_kind[kind] + count if kind in by_kind else count
    pairs = [F.struct(F.lit(kind).alias("key"), F.coalesce(n, F.lit(0)).alias("value")) for kind, n in by_kind.items()]
    findings = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda _, n: n > 0)
    total = sum((F.coalesce(n, F.lit(0)) for n in by_kind.values()), F.lit(0))
    dense = total / F.greatest(text.word_count(F.col(body)), F.lit(1)) >= fixed.QUARANTINE_DENSITY
    return staged.select(*[df[c] for c in df.columns], current.alias("masked"), findings.alias("findings"), total.alias("found"), dense.alias("quarantined"))

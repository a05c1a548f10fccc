"""Scalar text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed

#: White space with no-break and other Unicode blanks, and the C0 separators.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs without white space; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def lines(text: Column) -> Column:
    r"""Lines as "\n" separates them, an empty last piece left out; carriage returns belong to the line end."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n", -1))


#: Letters of scripts without blanks, each a word of its own in the Unicode variant of shingles.
SPACELESS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]\p{M}*)"


def canonical(text: Column, unicode: bool = False) -> Column:
    """Lower case, blanks to one, other signs to a blank, ends trimmed, in this order. Letters and
    digits are a-z and 0-9; with `unicode` those of every script."""
    other = r"[^\p{L}\p{M}\p{N} ]+" if unicode else "[^a-z0-9 ]+"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "), other, " "))


def fingerprint(text: Column, unicode: bool = False) -> Column:
    return F.sha2(canonical(text, unicode), 256)


def checksum(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def shingles(text: Column, size: int = fixed.SHINGLE_WORDS, unicode: bool = False) -> Column:
    """Distinct word windows of the canonical text; a shorter text is one shingle, an empty one has none."""
    plain = canonical(text, unicode)
    plain = F.regexp_replace(plain, SPACELESS, " $1 ") if unicode else plain

    def windows(tokens: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
        short = F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(tokens, " ")))
        return F.when(F.size(tokens) < size, short).otherwise(F.array_distinct(each))

    return let(F.filter(F.split(plain, " +"), lambda w: w != ""), windows)


def jaccard(a: Column, b: Column) -> Column:
    share = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def minhash(items: Column, permutations: int = 128) -> Column:
    """Signature of a set of strings: the least seeded hash per permutation."""
    return let(items, lambda own: F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda seed: F.array_min(F.transform(own, lambda x: F.xxhash64(x, seed)))))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def replace_matches(text: Column, pattern: str | Column, to: Callable[[Column], Column]) -> Column:
    """Each match of `pattern` replaced by a Column function of it: the pieces between the
    matches are interleaved with the transformed matches, without leaving the JVM."""
    rule = F.lit(pattern) if isinstance(pattern, str) else pattern

    def replaced(body: Column) -> Column:
        found = F.transform(F.regexp_extract_all(body, rule, F.lit(0)), lambda m: to(m))
        joined = F.zip_with(F.split(body, rule, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        return F.when(F.regexp_like(body, rule), F.array_join(joined, "")).otherwise(body)

    return let(text, replaced)


def sentences(text: Column, abbreviations: Sequence[str] = fixed.ABBREVIATIONS) -> Column:
    """Pieces behind . ! or ? and white space, known abbreviations kept together."""
    names = "|".join(a.replace(".", r"\.") for a in abbreviations)
    guarded = F.regexp_replace(text, rf"\b({names})\.", "$1\x01")
    pieces = F.split(F.regexp_replace(guarded, r"([.!?])\s+", "$1\x02"), "\x02", -1)
    return F.filter(F.transform(pieces, lambda p: F.trim(F.replace(p, F.lit("\x01"), F.lit(".")))), lambda p: p != "")


def query_tokens(text: Column, most: int = fixed.QUERY_TOKENS) -> Column:
    """Lower-case tokens of letters and digits longer than one sign."""
    return F.slice(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1), 1, most)


def host(url: Column) -> Column:
    """Host of a URL in any spelling: without scheme, www., port, path and letter case."""
    bare = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:(?=//))?(?://)?(?:www\.)?([^/:?#]+)", 1)
    return F.when(bare != "", bare)


def loose_json(raw: Column) -> Column:
    """The JSON object in a reply: the text without a code fence, else its outermost braces; null if neither parses."""
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))

"""Personal data in free text: candidates, features, boosted trees, typed placeholders.

High-recall generators propose overlapping spans of five kinds: addresses with @ or spoken,
runs of digits and of digit words, codes of letters and digits, capitalised words of two to four
parts (initials, hyphens, apostrophes, diacritics, particles) or small-letter and Devanagari words
behind a word that introduces a name, and chains of numbers, place words and capitalised words.
Features describe the form of each span and the classes (pii_words.py) of the words inside it and
around it; boosted trees (trained by pii_train.py on composed sentences, see there) score the
spans, a threshold per kind, calibrated on sentences of frames kept out of training, accepts them,
and of overlapping ones the surest stays. Masking replaces each accepted span by [KIND] and leaves
every other character as it was.

Defined results: null, empty and blank texts have no item and stay as they are; an item
that stands twice in a text is masked twice and reported with both positions; equal
scores prefer the longer, then the earlier span.
"""

from __future__ import annotations

import functools
import json
import math
import pkgutil
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import pii_words as words

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

_WORD = re.compile(r"[^\W_][\w\u0900-\u0963'’/-]*")
_MASKS = words.masks()
_CLASS = {name: 1 << bit for bit, name in enumerate(words.CLASSES)}
_MAIL = re.compile(r"[A-Za-z0-9](?<![\w.+@-].)(?:[\w.+-]*\w)?\s?(?:@|\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:(?:\.|\[dot\]|\(dot\)|\{dot\})[A-Za-z0-9-]+)*(?![\w@])")
_SAID_MAIL = re.compile(r"[A-Za-z0-9](?<![\w.].)(?=(?P<rest>\w*(?: (?:dot|underscore|dash|hyphen|plus|titik) \w+)* at \w+(?: (?:dash|hyphen) \w+)*(?: (?:dot|titik) \w+)+)(?!\w)(?! at \w+ (?:dot|titik) ))", re.I)
# numbers begin with a plain class, which the matcher finds fast; what must not stand before is looked back for
_DIGITS = re.compile(r"[+(\d](?<![\w.,/+@-].)(?:(?<=\+)\d{1,3}[ .-]?|(?<=\d)\d*[ .-]?)?(?:\(?\d{1,5}\)[ .-]?)?\d{1,18}(?:[ .-]\d{1,12}){0,5}(?![\w@]|[,.]\d)")
_SINGLE_DIGITS = re.compile(r"\d(?<![\w.,/+-].)(?: \d){2,}(?:, ?\d(?: \d){2,})*(?![\w,]?\d)")
_CODE = re.compile(r"[A-Za-z]{1,6}\d{4,12}[A-Za-z]{0,2}")
_DASHED = re.compile(r"[A-Z]{1,6}(?:[-/][A-Z0-9]{1,10}){1,4}")
_LONG = re.compile(r"\d[\d ().-]{5,}\d")
_DATE = re.compile(r"\d{4}-\d\d-\d\d\Z|\d\d-\d\d-\d{4}\Z|\d{4} \d{1,2}\Z|(?:19|20)\d\d[ -](?:19|20)\d\d\Z")
_CAPITAL = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_PARTICLES = "de|da|del|dela|della|di|dos|la|le|bin|binti|van|von|der|den|al|el|ibn|ul"
_CAPITALS = re.compile(rf"[{_CAPITAL}](?<![\w'’.@-].)[\w'’-]*\.?(?: (?:(?:{_PARTICLES}) ){{0,2}}[{_CAPITAL}][\w'’-]*\.?)+")
_PARTICLE_SET = frozenset(_PARTICLES.split("|"))
_NUMBER_START = re.compile(r"\d(?<![\w.,/+-].)\d{0,4}[A-Za-z]{0,2}(?:[/-]\w{1,4})*,? (?=[^\W\d_])")
_ABBREVIATED = frozenset("no st sta sto brgy jl jln h opp apt rd gg kel kec kab blk bldg nr ave".split())
_ADDRESS_GAPS = frozenset([" ", ", ", ",", " - ", ", - ", " (", "-"])
_LOWER_IN_ADDRESS = frozenset("near opp opposite behind beside of the and no block sector phase floor cross main road street lane temple church market mosque school gate".split())
_INTRODUCES, _DIGIT = 1 << len(words.CLASSES), 2 << len(words.CLASSES)
_BEFORE_IS = _CLASS["naming"] | _CLASS["relative"] | _CLASS["role"]
_UNIT_OR_PLACE = _CLASS["unit"] | _CLASS["place"]
_OPENERS = frozenset(".!?:;\"'“‘(।")


class Candidate(NamedTuple):
    kind: str
    start: int
    stop: int
    generator: int


class Words:
    """The words of a text: where they stand, in small letters, and their classes."""

    def __init__(self, text: str) -> None:
        small = text.lower()
        if len(small) != len(text):  # some letters have no single small one
            small = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        spans = list(map(re.Match.span, _WORD.finditer(text)))
        self.starts, self.ends = zip(*spans) if spans else ((), ())
        self.low = [small[a:b] for a, b in spans]
        for k, word in enumerate(self.low):
            if word[-1] in "'’/-_":
                self.low[k] = word.rstrip("'’/-_")
        self.masks = [_MASKS.get(w, 0) for w in self.low]


def _numbers(text: str) -> Iterator[Candidate]:
    for which, pattern in ((0, _DIGITS), (1, _SINGLE_DIGITS)):
        for m in pattern.finditer(text):
            start, value = m.start(), m[0]
            if value[0] == "(" and ")" not in value:
                start, value = start + 1, value[1:]
            digits = len(value) if value.isdigit() else sum(map(str.isdigit, value))
            if digits < 7 or _DATE.match(value):
                continue
            if digits <= 15:
                yield Candidate("PHONE", start, m.end(), which)
            if 8 <= digits <= 18 and not which and value[0] not in "+(" and "." not in value:
                yield Candidate("ID_NUMBER", start, m.end(), 2)


def _codes(text: str, own: Words) -> Iterator[Candidate]:
    for k, word in enumerate(own.low):
        if not word.isalpha() and word[0].isalpha() and len(word) > 5 and sum(map(str.isdigit, word)) >= 4:
            start, stop = own.starts[k], own.ends[k]
            if text[start - 1 : start] not in ("@", "_", ".") and text[stop : stop + 1] not in ("@", "_"):
                if _CODE.fullmatch(text, start, stop):
                    yield Candidate("ID_NUMBER", start, stop, 0)
                elif _DASHED.fullmatch(text, start, stop):
                    yield Candidate("ID_NUMBER", start, stop, 1)


def _spoken(text: str, own: Words) -> Iterator[Candidate]:
    """Runs of seven or more words for digits."""
    run: list[int] = []
    for k in [*(k for k, m in enumerate(own.masks) if m & _DIGIT), -1]:
        if run and k == run[-1] + 1 and not text[own.ends[k - 1] : own.starts[k]].strip(" ,-"):
            run.append(k)
            continue
        if len(run) >= 7:
            yield Candidate("PHONE", own.starts[run[0]], own.ends[run[-1]], 2)
        run = [k]


def _addresses(text: str, own: Words) -> Iterator[Candidate]:
    starts, ends, low, masks = own.starts, own.ends, own.low, own.masks
    begins = [k for k, m in enumerate(masks) if m & _UNIT_OR_PLACE and text[starts[k]].isupper() or low[k] == "h"]
    begins += [bisect_left(starts, m.start()) for m in _NUMBER_START.finditer(text)]
    end = 0
    for first in sorted(begins):
        if starts[first] < end:
            continue
        stops, seen, k = [], masks[first], first
        while k - first < 17 and k + 1 < len(starts):
            gap, nxt = text[ends[k] : starts[k + 1]], text[starts[k + 1]]
            if gap not in _ADDRESS_GAPS and not (gap in (". ", ".") and low[k] in _ABBREVIATED):
                break
            k += 1
            named = nxt.isupper() or nxt.isdigit()
            if not named and low[k] not in _LOWER_IN_ADDRESS:
                break
            seen |= masks[k]
            if k - first > 1 and seen & _UNIT_OR_PLACE and (named or masks[k] & _UNIT_OR_PLACE):
                behind = text[ends[k] : ends[k] + 2]
                if behind[:1] != " " or low[k].isdigit() or not behind[1:].isupper():
                    stops.append(ends[k])
        if stops:
            end = stops[-1]
            for stop in stops[-6:]:
                yield Candidate("ADDRESS", starts[first], stop, 0)


def _named(parts: list[tuple[int, int, int]]) -> Iterator[Candidate]:
    """Names of two to four parts within a run; a part is its start, end and 1 for a word, 0 for an initial, -1 for a particle."""
    for a in range(len(parts) - 1):
        if parts[a][2] < 0:
            continue
        size = whole = 0
        for start, stop, kind in parts[a:]:
            size, whole = size + (kind >= 0), whole + (kind > 0)
            if size > 4:
                break
            if size > 1 and kind > 0:
                yield Candidate("NAME", parts[a][0], stop, 0)


def _capitalised(text: str) -> Iterator[Candidate]:
    function, titles = words.FUNCTION, words.TITLES
    for m in _CAPITALS.finditer(text):
        at, value = m.start(), m[0]
        opens = not at or text[at - 1] == "\n" or text[at - 2 : at].strip()[-1:] in _OPENERS or value.isupper()
        run: list[tuple[int, int, int]] = []
        for part in value.split(" "):
            stop, dotted = at + len(part), part[-1] == "."
            bare = part[:-1] if dotted else part
            low = bare.lower()
            initial = dotted and len(bare) == 1
            particle = low in _PARTICLE_SET and part == low
            common = low in function and (opens or part == low or part.isupper() and len(part) > 1)  # a word that begins a sentence, or one inside a heading
            fits = initial or particle or not (common or low in titles or not (bare.isalpha() or bare.replace("-", "").replace("'", "").replace("’", "").isalpha()))
            if fits:
                run.append((at, stop if initial else at + len(bare), 0 if initial else -1 if particle else 1))
            if not fits or dotted and not initial:
                if len(run) > 1:
                    yield from _named(run)
                run = []
            opens = dotted and not initial
            at = stop + 1
        if len(run) > 1:
            yield from _named(run)


def _introduced(text: str, own: Words) -> Iterator[Candidate]:
    """Two or three words in small letters, or of a script without capitals, behind a word that introduces a name."""
    starts, ends, low = own.starts, own.ends, own.low
    for k, m in enumerate(own.masks):
        if not m & _INTRODUCES or low[k] == "is" and not (k and own.masks[k - 1] & _BEFORE_IS):
            continue
        j = k + 1
        while j < len(low) and low[j] in words.TITLES:
            j += 1
        last = j
        while last < len(low) and last < j + 3:
            letter, gap = text[starts[last]], text[ends[last - 1] : starts[last]]
            if letter.isupper() or not letter.isalpha() or low[last] in words.FUNCTION or (gap != " " if last > j else len(gap) > 3 or "\n" in gap):
                break
            last += 1
        for stop in range(j + 2, last + 1):
            yield Candidate("NAME", starts[j], ends[stop - 1], 1)


def propose(text: str) -> tuple[list[Candidate], Words]:
    """Overlapping spans proposed by the generators, and the words of the text."""
    own = Words(text)
    every = 0
    for m in own.masks:
        every |= m
    out: dict[Candidate, None] = {}
    if "@" in text or "[at]" in text or "(at)" in text or "{at}" in text:
        out.update((Candidate("EMAIL", *m.span(), 0), None) for m in _MAIL.finditer(text))
    if every & _CLASS["dictated"] and "at" in own.low:
        out.update((Candidate("EMAIL", m.start(), m.end("rest"), 1), None) for m in _SAID_MAIL.finditer(text))
    if _LONG.search(text):
        out.update(dict.fromkeys(_numbers(text)))
    out.update(dict.fromkeys(_codes(text, own)))
    if every & _DIGIT:
        out.update(dict.fromkeys(_spoken(text, own)))
    if every & _UNIT_OR_PLACE:
        out.update(dict.fromkeys(_addresses(text, own)))
    out.update(dict.fromkeys(_capitalised(text)))
    if every & _INTRODUCES:
        out.update(dict.fromkeys(_introduced(text, own)))
    return list(out), own


def candidates(text: str) -> list[Candidate]:
    return propose(text)[0]


_SHAPE = (
    "kind generator length words digits letters plus bracket groups longest_group first_group last_group hyphens dots slashes commas capitals all_lower all_upper few_digits starts_zero toll_free "
    "tld pan_like town_tail ends_in_number first_is_digit mixed field line_start table_row colon_before comma_before quote_before bracket_before dot_before before_glued blank_after comma_after dot_after "
    "colon_after bracket_after end_after next_upper next_digit next_lower capital_before capital_after"
).split()
_PLACES = ("at_1", "at_2", "at_3_6", "then_1", "then_2_4", "inside", "first", "last")
FEATURES = [*_SHAPE, *(f"{where}_{name}" for where in _PLACES for name in words.CLASSES)]
_GROUPS = re.compile(r"\d+")
_TLD, _PAN, _TOWN = re.compile(r"(?:\.| dot )[A-Za-z]{2,}\Z"), re.compile(r"[A-Za-z]{5}\d{4}[A-Za-z]\Z"), re.compile(r", [A-Z][a-z]+(?: City)?(?:,? (?:- )?\d{3} ?\d{2,3})?\Z")


def _shape(kind: str, value: str) -> tuple:
    """What the span itself looks like."""
    if kind == "NAME":
        upper = value.isupper()
        return (0, len(value) - value.count(" "), 0, 0, 0, 0, 0, 0, value.count("-"), value.count("."), 0, 0, sum(map(str.isupper, value)), value.islower(), upper, 0, 0, 0, 0, 0, 0, 0, 0, not upper and any(w.isupper() and len(w) > 1 for w in value.split()))
    groups = _GROUPS.findall(value)
    lengths = [len(g) for g in groups] or [0]
    joined = "".join(groups)
    upper = sum(map(str.isupper, value))
    free = joined[:4] in ("1800", "1860", "0800") or joined[:3] in ("800", "888", "877")
    return (
        len(joined), sum(map(str.isalpha, value)), value[0] == "+", "(" in value, len(groups), max(lengths), lengths[0], lengths[-1], value.count("-"), value.count("."), value.count("/"), value.count(","), upper, upper == 0,
        value.isupper(), joined != "" and len(set(joined)) <= 2, joined[:1] == "0", free, bool(_TLD.search(value)), bool(_PAN.match(value)), bool(_TOWN.search(value)), value[-1].isdigit(), value[0].isdigit(), 0,
    )


def features(text: str, found: list[Candidate], phone_field: bool, own: Words | None = None) -> tuple[list[tuple], list[tuple[int, ...]]]:
    """Shape of each span, and the classes of the words around and inside it."""
    own = own or Words(text)
    starts, masks = own.starts, [0, 0, 0, 0, 0, 0, *own.masks, 0, 0, 0, 0]  # six places before the first word, four behind the last
    shapes, seen, size = [], [], len(text)
    for kind, start, stop, generator in found:
        i, j = bisect_left(starts, start), bisect_left(starts, stop)
        near = start - 1
        while near >= 0 and text[near] == " ":
            near -= 1
        mark = text[near] if near >= 0 else "\n"
        tail = text[stop] if stop < size else "\n"
        nxt = text[starts[j]] if j < len(starts) and starts[j] - stop < 12 else ""
        line = text.rfind("\n", 0, start) + 1
        shapes.append(
            (
                KINDS.index(kind), generator, stop - start, j - i, *_shape(kind, text[start:stop]), phone_field, mark == "\n", text[line : line + 1] == "|",
                mark == ":", mark == ",", mark in "\"'“‘", mark == "(", mark in ".!?", near == start - 1 and mark != "\n", tail == " ", tail == ",", tail in ".!?", tail in ":;", tail == ")", tail == "\n",
                nxt.isupper(), nxt.isdigit(), nxt.islower(), i > 0 and near == start - 2 and own.ends[i - 1] == near + 1 and text[starts[i - 1]].isupper(), tail == " " and nxt.isupper() and starts[j] == stop + 1,
            )
        )
        whole = 0
        for m in masks[i + 6 : j + 6]:
            whole |= m
        # words from i - 1 down to i - 6, then those from j on
        seen.append((masks[i + 5], masks[i + 4], masks[i + 3] | masks[i + 2] | masks[i + 1] | masks[i], masks[j + 6], masks[j + 7] | masks[j + 8] | masks[j + 9], whole, masks[i + 6], masks[j + 5]))
    return shapes, seen


def matrix(shapes: list[tuple], seen: list[tuple[int, ...]]) -> np.ndarray:
    bits = np.array(seen, np.uint32).reshape(len(seen), len(_PLACES), 1)
    spread = np.unpackbits(bits.view(np.uint8), axis=2, bitorder="little")[:, :, : len(words.CLASSES)]
    return np.concatenate([np.array(shapes, np.float32), spread.reshape(len(seen), -1).astype(np.float32)], 1)


class Trees:
    """Sum of regression trees over the features, as arrays. A leaf is its own left and right, so that
    every row walks as many steps as the deepest tree has."""

    def __init__(self, model: dict) -> None:
        self.bias, self.thresholds, self.trees = model["bias"], model["thresholds"], []
        for feature, cut, left, right, value in model["trees"]:
            own = np.arange(len(feature))
            leaf = np.array(feature) < 0
            ways = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], 1).astype(np.int32).ravel()
            depth = [0] * len(feature)
            for k in range(len(feature)):
                if not leaf[k]:
                    depth[left[k]] = depth[right[k]] = depth[k] + 1
            self.trees.append((np.where(leaf, 0, feature).astype(np.int32), np.array(cut, np.float32), ways, np.array(value), max(depth)))
        gains = np.array([value.max() for *_, value, _ in self.trees])
        self.rest = gains.sum() - np.cumsum(gains)  # the most that the trees behind each one can add

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of each row, 0 for those that cannot reach the least threshold any more."""
        least = min(self.thresholds.values(), default=0.0)
        floor = math.log(least / (1 - least)) if least else -math.inf
        out, left = np.zeros(len(x)), np.arange(len(x))
        flat, width = np.ascontiguousarray(x).ravel(), x.shape[1]
        total, base = np.full(len(x), self.bias), left * width
        for n, (feature, cut, ways, value, depth) in enumerate(self.trees):
            node = np.zeros(len(base), np.int32)
            for _ in range(depth):
                node = ways[2 * node + (flat[base + feature[node]] <= cut[node])]
            total += value[node]
            if n % 8 == 7:
                open_ = total + self.rest[n] >= floor
                left, total, base = left[open_], total[open_], base[open_]
        out[left] = 1 / (1 + np.exp(-total))
        return out


@functools.lru_cache(maxsize=1)
def model() -> Trees:
    return Trees(json.loads(pkgutil.get_data("millrace.llm", "pii_model.json")))


def select(found: list[Candidate], probability: np.ndarray, thresholds: dict[str, float]) -> list[Candidate]:
    """Of the spans above their kind's threshold the surest without overlap, in text order."""
    ranked = sorted((-(round(float(p), 3)), c.start - c.stop, c.start, c) for c, p in zip(found, probability) if p >= thresholds[c.kind])
    kept: list[Candidate] = []
    for *_, c in ranked:
        if all(c.stop <= k.start or c.start >= k.stop for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: c.start)


def find(texts: list[str | None], phone_field: bool = False) -> list[list[Candidate]]:
    """Accepted items of each text."""
    proposed, shapes, seen = [], [], []
    for t in texts:
        found, own = propose(t) if t else ([], None)
        proposed.append(found)
        if found:
            for whole, part in zip((shapes, seen), features(t, found, phone_field, own)):
                whole += part
    if not shapes:
        return [[] for _ in texts]
    out, at, trees = [], 0, model()
    scores = np.concatenate([trees.probability(matrix(shapes[k : k + 20_000], seen[k : k + 20_000])) for k in range(0, len(shapes), 20_000)])
    for found in proposed:
        out.append(select(found, scores[at : at + len(found)], trees.thresholds) if found else [])
        at += len(found)
    return out


def mask(text: str | None, items: list[Candidate]) -> str | None:
    for kind, start, stop, _ in reversed(items):
        text = f"{text[:start]}[{kind}]{text[stop:]}"
    return text


def personal_data(df: DataFrame, key: str, text: str, phone_field: str | None = None) -> DataFrame:
    """key, masked (the text with placeholders) and items (kind, value, start_pos) of every row;
    `phone_field` names a boolean column that tells whether the text is a telephone field."""
    kind = df.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("value", pa.string()), ("start_pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts, field = part.column(1).to_pylist(), part.column(2).to_pylist()
                found: list[list[Candidate]] = [[] for _ in texts]
                for which in (False, True):
                    own = [k for k, f in enumerate(field) if bool(f) is which]
                    for k, items in zip(own, find([texts[k] for k in own], which)):
                        found[k] = items
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([mask(t, items) for t, items in zip(texts, found)], pa.string()),
                        pa.array([[(c.kind, t[c.start : c.stop], c.start) for c in items] for t, items in zip(texts, found)], pa.list_(item)),
                    ],
                    ["key", "masked", "items"],
                )

    flag = F.col(phone_field) if phone_field else F.lit(False)
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"), flag.alias("field"))
    return picked.mapInArrow(run, f"key {kind}, masked string, items array<struct<kind:string,value:string,start_pos:int>>").withColumnRenamed("key", key)

"""Language of texts and of their segments.

Script ranges narrow the candidates of every word: Devanagari, Thai and kana words have their
language by script; Han words are Chinese or Japanese by the characters that only one of the two
writes, and in a text of some length without kana Chinese. Latin words get a score per language:
known ones from labelled samples and short lists of common words, unknown ones in small letters from
their letter sequences (one to four letters, fitted on the same words); capitalised words inside
sentences score nothing. Viterbi over the words' scores with a switching penalty then labels spans;
it runs over many texts in lockstep, and equal neighbouring words are one step. The confidence is
the logistic of a segment's lead, its slope fitted on samples that the scores had not seen.

Languages outside LANGUAGES are not told from the nearest of them, except by script: words of other
scripts score nothing. Defined results: texts without a scored word (null, empty, blank, numbers only) have no
segment and language null with confidence 0; ties go to the first language of LANGUAGES.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANGUAGES = ("en", "id", "fil", "jv", "hi", "th", "ja", "zh")
_LATIN = 4  # the first four are written in Latin letters
_TOKEN = re.compile("(?<![@+_])(?<![a-z][.])[A-Za-zÀ-ɏ]++(?:['’-][A-Za-zÀ-ɏ]++)*+(?![@+_]|[.\\[][a-z])|[ऀ-ॣ०-ॿ]+|[ก-๛]+|[぀-ヿ一-鿿々]+")  # no parts of addresses
_KANA = re.compile("[぀-ヿ]")
_REACH = 2.5
#: Bound of the labelled sample that is fitted on.
MAX_SAMPLES = 5000

#: Common words of each language, beside those of the samples.
COMMON = {
    "en": """the of and to in is was for with that this it you your i my we our they he she not are be have has had will would can could
        should do does did but or if when what which who how why where there here from at by as an on about into over after before than
        then more most very just please thank thanks want need know think call talk speak said say get make take give tell ask send use
        read write old new good first last year years month day days money price cost pay paid payment much many nothing something again
        slowly never always already also only because until while during between under people family father mother human being around
        explain name number address card policy phone hello yes help what's it's don't wasn't isn't been being having where these those such
        own same few both each every any some other another away off out up down against because through without within along across
        live stay near play run walk eat drink sleep house home school water food city country world day night morning children friends""",
    "id": """yang dan di ke dari untuk dengan pada adalah ini itu tidak ada saya anda kami kita mereka dia akan sudah belum telah bisa dapat
        harus boleh mau ingin perlu jika kalau karena agar supaya tetapi atau juga hanya lebih sangat sekali saja lagi masih sedang
        sampai oleh dalam antara setelah sebelum ketika apa apakah siapa mana kapan mengapa bagaimana berapa bulan tahun hari tanggal
        tolong terima kasih selamat siang pagi malam tanya bicara langsung soal cepat kirim alamat nama nomor bayar rumah orang uang
        biaya syarat cara kepada teman baca masuk tentang tinggal atas minta kembali para setiap semua banyak beberapa seperti bahwa
        menjadi membuat melihat datang pergi makan minum anak ibu bapak kota negara dunia sekolah jalan air besar kecil baru lama
        mereka kemarin besok sekarang nanti pernah sering hampir bukan jangan tanpa melalui terhadap hingga maupun serta""",
    "fil": """ang ng sa na mga ay at si ni kay para po opo hindi ako ko mo ka ikaw siya niya kami namin tayo natin kayo ninyo sila nila ito
        iyan iyon dito doon may mayroon wala kung kapag dahil pero ngunit o din rin lang lamang na pa ba naman nga daw raw yata sana
        sanang gusto puwede pwede kaya kayang dapat kailangan ano sino kailan saan bakit paano magkano ilan araw buwan taon ngayon bukas
        kahapon salamat magandang umaga hapon gabi tungkol tao bayad noong yung susunod ninyong pong nang bago habang ayon pamilya kaibigan
        naming nating aming ating kanilang kanyang iyong lahat bawat maraming marami ilang ibang isang dalawang siyang silang mga
        bahay bata nanay tatay lungsod bansa mundo paaralan tubig pagkain kumain pumunta dumating gumawa sabi sinabi talaga lagi muna
        walang kapag upang sapagkat kaya subalit saka hanggang mula patungo palagi minsan madalas malaki maliit bagong""",
    "jv": """aku kowe panjenengan kula sampeyan dheweke iki iku kuwi punika menika ora mboten dudu wis sampun durung dereng arep badhe bakal
        isih taksih lagi nembe karo kaliyan lan utawa nanging amarga amargi yen menawi supados supaya saka saking menyang dhateng ing
        wonten ana apa menapa sapa sinten piye kados pripun pinten pira kudu kedah bisa saged iso omah omahku griya griyanipun bojo
        ibu bapak anak sing ingkang kang rong telu papat limang dina dinten wulan taun mangke saiki samenika wingi sesuk
        nomer cedhak ning neng karo kalih marang dhewe kabeh akeh sethithik gedhe cilik anyar lawas bocah wong wong-wong desa kutha banyu
        mangan ngombe turu lunga teka mulih gawe ndelok krungu omong-omong panganan sekolah dalan esuk awan sore bengi dhek mau mengko maneh ning tulung nyuwun pangapunten matur nuwun ngendika matur mbayar dhuwit arta
        kagem kanggo dening malih maneh ngantos nganti sadurunge sasampunipun babagan carane""",
}


#: Longest letter sequence of unknown words, their weight against known words, and the most they can say.
_MOST_LETTERS, _LETTER_WEIGHT, _LETTER_REACH = 4, 0.12, 1.2
#: Stands behind a Han word of a text that has no kana in so many Han signs or more.
_NO_KANA, _HAN_SIGNS = "\x00", 12
_HAN = re.compile("[一-鿿]")


def _grams(word: str) -> list[str]:
    """Letter sequences of a word, its ends marked."""
    ends = f"^{word}$"
    return [ends[k : k + n] for n in range(2, _MOST_LETTERS + 1) for k in range(len(ends) - n + 1)]


@functools.lru_cache(maxsize=30_000)
def _written(sign: str, charset: str) -> bool:
    try:
        sign.encode(charset)
    except UnicodeEncodeError:
        return False
    return True


class Segment(NamedTuple):
    language: str
    start: int
    stop: int
    words: int  # words that speak for the language
    confidence: float


class Scorer:
    """Score of every known word per language."""

    def __init__(self, samples: Iterable[tuple[str, str]]) -> None:
        counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES[:_LATIN]}
        named: dict[str, set] = defaultdict(set)  # words in capitals inside sentences, by language
        for lang, text in samples:
            if lang not in counts or not text:
                continue
            tokens = _TOKEN.findall(text)
            for k, token in enumerate(tokens):
                if token.islower():
                    counts[lang][token] += 1
                elif k == 0:
                    counts[lang][token.lower()] += 0.5
                else:
                    named[token.lower()].add(lang)
        for lang, words in COMMON.items():
            for word in set(words.split()):
                counts[lang][word] += 3
        neutral = {word for word, langs in named.items() if len(langs) > 2}
        self._fit_letters(counts)
        totals = {lang: sum(c.values()) for lang, c in counts.items()}
        size = len(set().union(*counts.values()))
        self.slope = 0.5
        self.scores: dict[str, tuple[float, ...]] = {}
        for word in set().union(*counts.values()):
            if word in neutral or len(word) < 2 and word not in ("i", "a", "o"):
                continue
            share = [(counts[lang][word] + 0.1) / (totals[lang] + 0.1 * size) for lang in LANGUAGES[:_LATIN]]
            mean = math.exp(sum(map(math.log, share)) / _LATIN)
            row = [max(-_REACH, min(_REACH, math.log(x / mean))) for x in share]
            if max(row) >= 0.3:
                self.scores[word] = (*row, *[-_REACH] * (len(LANGUAGES) - _LATIN))

    def _fit_letters(self, counts: dict[str, Counter]) -> None:
        """Log shares of the letter sequences of each language's different words."""
        grams = {lang: Counter(g for word in c for g in _grams(word)) for lang, c in counts.items()}
        sizes = {lang: [sum(n for g, n in c.items() if len(g) == k) for k in range(_MOST_LETTERS + 1)] for lang, c in grams.items()}
        self.letters: dict[str, tuple[float, ...]] = {}
        for gram in set().union(*grams.values()):
            share = [math.log((grams[lang][gram] + 0.2) / (sizes[lang][len(gram)] + 50)) for lang in LANGUAGES[:_LATIN]]
            mean = sum(share) / _LATIN
            self.letters[gram] = tuple(x - mean for x in share)

    def spelt(self, word: str) -> tuple[float, ...] | None:
        """Score of an unknown word by its letters; None if they speak for no language."""
        found = [self.letters[g] for g in _grams(word) if g in self.letters]
        if len(word) < 4 or not found:
            return None
        total = [_LETTER_WEIGHT * sum(x[k] for x in found) for k in range(_LATIN)]
        mean = sum(total) / _LATIN
        row = [max(-_LETTER_REACH, min(_LETTER_REACH, x - mean)) for x in total]
        return (*row, *[-_REACH] * (len(LANGUAGES) - _LATIN)) if max(row) >= 0.3 else None

    def of(self, token: str) -> tuple[float, ...] | None:
        first = token[0]
        if first < "ऀ":
            return self.scores.get(token) or self.scores.get(token.lower()) or (self.spelt(token) if token.islower() else None)
        own = [-_REACH] * len(LANGUAGES)
        if first < "ঀ":
            own[4] = _REACH
        elif first < "຀":
            own[5] = _REACH
        elif _KANA.search(token):
            own[6] = _REACH
        elif token[-1] == _NO_KANA:
            own[7] = _REACH
        else:
            han = token.rstrip(_NO_KANA)
            japanese, chinese = (sum(_written(c, one) and not _written(c, other) for c in han) for one, other in (("shift_jis", "gb2312"), ("gb2312", "shift_jis")))
            if japanese != chinese:
                own[6 if japanese > chinese else 7], own[7 if japanese > chinese else 6] = _REACH, -0.5
            elif len(han) > 2:
                own[7], own[6] = _REACH, -0.5
            else:  # one or two Han signs: Chinese, or a word inside Japanese
                own[7], own[6] = 0.6, 0.3
        weight = min(4, 1 + len(token) // 6) if first >= "฀" else 1
        return tuple(x * weight for x in own)


class Labeller:
    """Viterbi over batches of texts; `penalty` is the cost of a change of language."""

    def __init__(self, scorer: Scorer, penalty: float = 6.0) -> None:
        self.scorer, self.penalty = scorer, penalty
        self.known: dict[str, int] = {}
        self.rows: list[tuple[float, ...]] = [(0.0,) * len(LANGUAGES)]
        self.index: dict[tuple[float, ...], int] = {}

    def _code(self, token: str) -> int:
        code = self.known.get(token)
        if code is None:
            row = self.scorer.of(token)
            if row is None:
                code = 0
            elif row in self.index:
                code = self.index[row]
            else:
                code = self.index[row] = len(self.rows)
                self.rows.append(row)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[token] = code
        return code

    def label(self, texts: list[str | None]) -> list[list[Segment]]:
        steps: list[tuple[list[int], list[int], list[int], list[int]]] = []
        known = self.known
        for text in texts:
            codes, times, begin, end = [], [], [], []
            last = 0
            chinese = bool(text) and not text.isascii() and not _KANA.search(text) and len(_HAN.findall(text)) >= _HAN_SIGNS
            for match in _TOKEN.finditer(text) if text else ():
                token = match[0]
                if chinese and "一" <= token[0] <= "鿿":
                    token += _NO_KANA
                code = known.get(token, -1)
                if code < 0:
                    code = self._code(token)
                if code:
                    if code == last:
                        times[-1] += 1
                        end[-1] = match.end()
                    else:
                        codes.append(code)
                        times.append(1)
                        begin.append(match.start())
                        end.append(match.end())
                        last = code
            steps.append((codes, times, begin, end))
        out: list[list[Segment]] = [[] for _ in texts]
        table = np.array(self.rows)
        order = sorted((k for k, s in enumerate(steps) if s[0]), key=lambda k: len(steps[k][0]))
        at = 0
        while at < len(order):
            longest = len(steps[order[at]][0])
            stop = at
            while stop < len(order) and (len(steps[order[stop]][0]) <= longest * 1.3 + 4):
                if (stop - at + 1) * len(steps[order[stop]][0]) > 400_000 and stop > at:
                    break
                stop += 1
            self._lockstep([steps[k] for k in order[at:stop]], order[at:stop], table, out)
            at = stop
        return out

    def _lockstep(self, steps: list, where: list[int], table: np.ndarray, out: list[list[Segment]]) -> None:
        n, most, k = len(steps), len(steps[-1][0]), len(LANGUAGES)
        lengths = np.array([len(s[0]) for s in steps])
        codes, times = np.zeros((most, n), np.int64), np.zeros((most, n))
        for j, (c, t, _, _) in enumerate(steps):
            codes[: len(c), j], times[: len(c), j] = c, t
        score, back = np.zeros((n, k)), np.zeros((most, n), np.int8)  # the best earlier state, for those that switch
        switch = np.zeros((most, n, k), bool)
        for t in range(most):
            if t:
                top = score.argmax(1)
                best = score[np.arange(n), top] - self.penalty
                back[t] = top
                switch[t] = best[:, None] > score
                score = np.maximum(score, best[:, None])
            score = score + table[codes[t]] * times[t][:, None]
        state = score.argmax(1)
        path = np.zeros((most, n), np.int8)
        columns = np.arange(n)
        for t in range(most - 1, -1, -1):
            path[t] = state
            if t:
                state = np.where(switch[t][columns, state], back[t], state)
        for j, (c, t, begin, end) in enumerate(steps):
            own = path[: lengths[j], j]
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:]):
                gains = (table[c[a:b]] * np.array(t[a:b])[:, None]).sum(0)
                language = int(own[a])
                other = np.max(np.delete(gains, language))
                words = sum(m for x, m in zip(c[a:b], t[a:b]) if table[x, language] > 0.3)
                confidence = 1 / (1 + math.exp(-max(-30.0, min(30.0, (gains[language] - other) * self.scorer.slope))))
                out[where[j]].append(Segment(LANGUAGES[language], begin[a], end[b - 1], words, round(confidence, 4)))


def fit(samples: DataFrame) -> Scorer:
    """Scores from labelled samples (lang, text), of which at most MAX_SAMPLES rows are taken, as many of
    each language as there are or as their share of the bound."""
    share = MAX_SAMPLES // len(LANGUAGES)
    ranked = samples.where(F.col("lang").isin(*LANGUAGES)).select("lang", "text", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")).alias("n"))
    return fitted([(r[0], r[1]) for r in ranked.where(F.col("n") <= share).select("lang", "text").collect()])


def fitted(rows: list[tuple[str, str]]) -> Scorer:
    """Scores from all rows, with the slope of the confidence from halves that the scores had not seen."""
    rows = sorted((lang, text) for lang, text in rows if text)
    leads, right = [], []
    for half in (0, 1):
        labeller = Labeller(Scorer(rows[half::2]))
        held = rows[1 - half :: 2]
        cuts = [" ".join(text.split()[:n]) for n in (2, 3, 5) for _, text in held]
        for (lang, _), segments in zip(held * 3, labeller.label(cuts)):
            for s in segments:
                leads.append(math.log(max(s.confidence, 1e-9) / max(1 - s.confidence, 1e-4)) / labeller.scorer.slope)
                right.append(s.language == lang)
    scorer, slope = Scorer(rows), 0.5
    x, y = np.array(leads), np.array(right, float)
    for _ in range(30 if len(x) > 20 else 0):  # Newton on the logistic loss, with a weak pull to the start
        p = 1 / (1 + np.exp(-np.clip(slope * x, -30, 30)))
        slope = float(np.clip(slope + (((y - p) * x).sum() - (slope - 0.5)) / ((p * (1 - p) * x * x).sum() + 1), 0.05, 2.0))
    scorer.slope = slope
    return scorer


def whole(segments: list[Segment]) -> tuple[str | None, float]:
    """Language of the text: the one most words speak for, and its share weighted by confidence."""
    mass: dict[str, float] = {}
    for s in segments:
        mass[s.language] = mass.get(s.language, 0) + s.words * s.confidence
    if not mass:
        return None, 0.0
    best = max(mass, key=lambda lang: (mass[lang], -LANGUAGES.index(lang)))
    sure = max(s.confidence for s in segments if s.language == best)
    return best, round(sure * mass[best] / max(sum(mass.values()), 1e-9), 4)


def present(segments: list[Segment], least: int = 3) -> list[str]:
    """Languages with a segment of the size of a full sentence."""
    return sorted({s.language for s in segments if s.words >= least or s.language in LANGUAGES[_LATIN:] and s.stop - s.start >= 12}, key=LANGUAGES.index)


_SLICE = 2_000_000


def languages(df: DataFrame, key: str, text: str, scorer: Scorer, penalty: float = 6.0) -> DataFrame:
    """key, detected (language), confidence, n_words (runs without white space), present (languages with
    a full sentence) and segments (language, start_pos, end_pos, confidence) of every row."""
    kind = df.schema[key].dataType.simpleString()
    segment = pa.struct([("language", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(scorer, penalty)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found, group, size = [], [], 0
            for body in texts:
                group.append(body)
                size += len(body or "")
                if size > _SLICE:
                    found += labeller.label(group)
                    group, size = [], 0
            found += labeller.label(group)
            main = [whole(s) for s in found]
            columns = [
                batch.column(0),
                pa.array([m[0] for m in main], pa.string()),
                pa.array([m[1] for m in main], pa.float64()),
                pa.array([len(body.split()) if body else 0 for body in texts], pa.int32()),
                pa.array([present(s) for s in found], pa.list_(pa.string())),
                pa.array([[(s.language, s.start, s.stop, s.confidence) for s in row] for row in found], pa.list_(segment)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "detected", "confidence", "n_words", "present", "segments"])

    schema = f"key {kind}, detected string, confidence double, n_words int, present array<string>, segments array<struct<language:string,start_pos:int,end_pos:int,confidence:double>>"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)

"""Sentence units across languages and scripts.

Terminator lattice: every run of terminators is a node with two readings, "ends" and "goes
on"; the token before, the text after and the brackets around give each reading its cost.
The nodes of a line are weighed together: the cheapest path through them is taken, on which
an end before a lone abbreviation costs extra. A line end always ends a unit.

Spaceless scripts: every run of Chinese or Japanese letters is segmented by the cheapest path
through a word lattice, and each gap behind a word, with or without a blank, is scored by the
kind of the word before (final particle, closing word, particle or verb that wants more) and
of what opens behind it. The dictionary is a hand-made list of function words, openers and
closing words (`_KINDS`), not a general one: where a mark is lost between two words that it
does not hold, the gap stays inside the unit. In Thai a blank between two Thai letters ends.

Defined results: null, empty and blank texts have no unit; rows are handled one by one,
so repeated rows give repeated units and the order of rows does not matter.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_THAI = "ก-ฮะ-ฺเ-๎"
_STOP = ".!?…。！？｡।॥"
_PLAIN = f"[\"“‘「『(（\n{_STOP}][{_STOP}]*"
_THAI_GAP = f"(?<=[{_THAI}])[^\\S\n]+(?=[{_THAI}])"
_NODES = re.compile(_PLAIN)
_NODES_THAI = re.compile(f"{_PLAIN}|{_THAI_GAP}")
_IN_THAI, _IN_CJK = re.compile("[ก-๎]"), re.compile("[぀-鿿]")
_PARTNER = {"“": "”", '"': '"', "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）"}
_STOPS = frozenset(_STOP)
_FIRST = frozenset("\"“‘「『(（\n" + _STOP)
_FULL = frozenset("。！？｡।॥")
_CLOSERS = frozenset("\"'”’»)]」』）】")
_BREAKS = frozenset("([\"'“‘「（,;:")
LOOK_BACK = 1000
_NUMBERING = re.compile(r"[\W_]*(?:\d{1,4}|[ivxlIVXL]{1,5}|[A-Za-z])\Z")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
_NAME_LIKE = re.compile(r"[a-z]-[a-z]|[a-z]{1,2}[A-Z]")

#: Abbreviations that stand before what they belong to; never the end of a sentence.
LEADING = frozenset(
    "mr mrs ms dr prof gen col capt lt maj sgt cpl cmdr adm rev hon gov sen rep pres supt messrs mx fr sra srta dra smt shri sri st mt ft gng bpk jl vol fig figs pp sec secs art e.g i.e vs cf rs h.no brgy pt ph hj kh ir drs g gg "
    "डॉ रु प्रा श्री सुश्री ดร น.ส พ.ศ".split()
)
#: Abbreviations that only a number follows.
NUMBERED = frozenset("no nos blg p para cl sub col eq ch approx ca c".split())
#: Abbreviations that may also be the last word; the case of what follows decides.
TRAILING = frozenset(
    "etc ltd inc co corp llc tbk dll dsb dst atbp jr sr approx bros pvt plc esq a.m p.m n.u n.h n.g dept est govt min max hrs yrs "
    "लि इत्यादि".split()
)
#: Words of spaceless scripts with which a sentence goes on behind a quotation.
_CARRY_ON = frozenset("と という って の を は が に など 是 随后 然后 的 之后 并 这 这句话 等 又 再".split())
_CARRY_ON_SPACED = re.compile("(?:और|कहकर|ऐसा|यह|के|का|की|को|से|पर|तो|एवं|बोला|बोली|बोले|कहा|पूछा)(?![\u0900-\u097f])")
#: The dictionary of the word lattice, by what a word is where it stands before a gap and behind it.
_KINDS = {
    # final particles and polite endings
    "final": "です ます ました ません でした ましょう でしょう ください ですか ますか ましたか ませんか でしたか でしょうか ましょうか ませんでした 吗 呢 吧 真的吗 是吗 好吗",
    # a question or remark of its own before a blank
    "maybe": "か 本当に 本当 真的",
    # words after which a clause is complete
    "closing": "申请 电话 档案 问题 除外 服务点 成员 送到 索取 空档 费用 元 任何人 拒绝 保单 保费 合同 条款 账户 资料 文件 材料 手续 医院 窗口 分公司 网点 期限 金额 利息 "
    "密码 签名 发票 收据 证明 身份证 银行卡 言った 答えた 聞いた 述べた 时间 地址 日期 原因 结果 情况 办法 责任 范围 完毕 生效 失效 为止 以内 以上 以下 之内 之后 之前 受益人 被保险人",
    # what wants something behind it, and what does but may also open a clause
    "wanting": "的 地 得 在 是 和 与 或 把 被 向 对 给 从 到 为 以 及 并 而 不 也 都 就 还 要 会 能 可 将 已 每 最 该 此 这 那 个 只 才 又 再 很 更 听 据 了 着 过 于 由 跟 比 让 使 "
    "が の を に は へ で も や から まで より など として について による という",
    "verb": "联系 挂断 关闭 告诉 担心 处理 知道 说明 解释 明白 询问 了解 提供 提交 填写 支付 赔付 购买 办理 写道 问 说 关于 通过 根据 按照 随后 然后 以及 并且 或者 还是 而且 不是 就是 不要 必须 可以 需要 应当",
    # what carries a clause on behind a final
    "carry": "と って ので のに けど けれど けれども し ね よ わ さ とき こと もの ため ほど くらい 随后 然后 的 之后 并 这 这句话 等 又 再 、",
    # what opens a clause anywhere, and what does so behind a closing word only
    "opener": "如果 为什么 他说 她说 但是 可是 真的吗 怎么办 しかし けれども それでは",
    "perhaps": "请 真的 业务员 客户 我们 他们 因为 所以 本当に 本当 彼 彼女 彼は 彼女は また そして もし なお ただし この その 証券 証券番号 暗証 暗証番号 解約 書類 手術 受取人 保険料 这份 这个",
    # words that only keep their letters together
    "plain": "邀请 请求 请假 聘请 请问 证券 番号 支店 か月 か所 か国 ところ 等待期 单元 元旦 元年 多元 了解 问题 吗啡 酒吧 吧台",
}
_KIND = {kind: frozenset(words.split()) for kind, words in _KINDS.items()}
_LEXICON = _CARRY_ON.union(*_KIND.values())
_LONGEST = max(map(len, _LEXICON))
_BEFORE = {"wanting": -4, "verb": -4, "final": 4, "closing": 2, "maybe": 1}
#: Ends of a clause only where a blank follows; elsewhere their object does.
_DONE_WORDS = frozenset("了 过 啦 啊 呀 呗 嘛".split())
_BEHIND = {"carry": -5, "wanting": -4, "opener": 2, "perhaps": 1}
_RUN = re.compile("[぀-ヿ㐀-鿿々]+")
_DONE = re.compile(r"(?<=了)[\d.,]+[%％]")
#: Costs: of a reading that the text rules out, and of an end that leaves an abbreviation alone.
_RULED_OUT, _ALONE = 9, 4


def _spaceless(char: str) -> bool:
    return "぀" <= char <= "鿿" or "豈" <= char <= "﫿" or "฀" <= char <= "๿"


@functools.lru_cache(maxsize=100_000)
def _words(run: str) -> tuple[int, ...]:
    """Ends of the words on the cheapest path through the word lattice of a run: a word of the
    dictionary costs 1, an unknown character 2, the longer of two words wins."""
    best: list[tuple[int, int]] = [(0, 0)] * (len(run) + 1)
    for i in range(len(run) - 1, -1, -1):
        choice = (best[i + 1][0] + 2, -(i + 1))
        for j in range(i + 1, min(len(run), i + _LONGEST) + 1):
            if run[i:j] in _LEXICON:
                choice = min(choice, (best[j][0] + 1, -j))
        best[i] = choice
    ends, at = [], 0
    while at < len(run):
        at = -best[at][1]
        ends.append(at)
    return tuple(ends)


def _words_of(run: str) -> list[str]:
    ends = _words(run)
    return [run[a:b] for a, b in zip((0, *ends), ends)]


def _first_word(text: str, at: int) -> str:
    window = text[at : at + 2 * _LONGEST]
    return window[: _words(window)[0]] if window else ""


def _score(word: str, scores: dict[str, int]) -> int | None:
    return next((score for kind, score in scores.items() if word in _KIND[kind]), None)


@functools.lru_cache(maxsize=100_000)
def _inner_gaps(run: str) -> tuple[tuple[int, ...], int | None, int | None]:
    """Gaps inside a run that end a unit, and the scores of its last and first word."""
    ends, found, start = _words(run), [], 0
    words = []
    for end in ends:
        words.append(run[start:end])
        start = end
    for left, right, at in zip(words, words[1:], ends):
        before = _score(left, _BEFORE) or 0
        if before >= 0:
            behind = _score(right, _BEHIND)
            if behind is None:
                behind = -4 if "぀" <= right <= "ゟ" else -2  # unknown hiragana carries a word on
            if before + behind >= 2:
                found.append(at)
    return tuple(found), _score(words[-1], _BEFORE), _score(words[0], _BEHIND)


def _lost_marks(text: str) -> list[tuple[int, int]]:
    """End of the word before and start of the text behind every gap that ends a unit without a mark."""
    found = []
    runs = list(_RUN.finditer(text))
    for k, run in enumerate(runs):
        at, stop = run.span()
        inner, before, _ = _inner_gaps(run[0])
        found += [(at + gap, at + gap) for gap in inner]
        after = stop
        while after < len(text) and text[after].isspace() and text[after] != "\n":
            after += 1
        if after < len(text):
            blank = after > stop
            behind = None
            if "A" <= text[after] <= "Z" or not blank and text[after] in "“「『":
                behind = 0
            elif blank and k + 1 < len(runs) and runs[k + 1].start() == after:
                behind = _inner_gaps(runs[k + 1][0])[2] or 0
            if blank and behind is not None and _words_of(run[0])[-1] in _DONE_WORDS:
                before = 1
            if behind is not None and (before or 0) + behind + blank >= 2:
                found.append((stop, after))
    for done in _DONE.finditer(text):
        after = done.end()
        follows = text[after : after + 1]
        if "A" <= follows <= "Z" or follows == "“" or (run := _RUN.match(text, after)) and (_inner_gaps(run[0])[2] or 0) > 0:
            found.append((after, after))
    return found


def _cheapest(nodes: list[tuple[int, int, int, int]]) -> list[int]:
    """Where units start on the cheapest path through the terminators of a line. A node is the place
    behind it, the costs of "ends" and of "goes on", and what an end at the node before costs; if this
    one is an end as well, that costs it twice."""
    ends, on = 0, 1_000_000  # the line's start is an end
    back: list[tuple[bool, bool]] = []  # per reading of this node, whether the one before ends
    for _, end_cost, on_cost, lone in nodes:
        back.append((ends + 2 * lone <= on, ends + lone <= on))
        ends, on = min(ends + 2 * lone, on) + end_cost, min(ends + lone, on) + on_cost
    ended, starts = ends <= on, []
    for (after, *_), (behind_end, behind_on) in zip(reversed(nodes), reversed(back)):
        if ended:
            starts.append(after)
        ended = behind_end if ended else behind_on
    return starts[::-1]


def _word_before(text: str, line: int, start: int) -> str:
    """The token before a mark; one of more than LOOK_BACK characters is judged by its last ones."""
    least = max(line, start - LOOK_BACK)
    at = start
    while at > least and text[at - 1] not in _BREAKS and not text[at - 1].isspace():
        at -= 1
    return text[at:start]


def _doubt(text: str, line: int, start: int, stop: int, closed: bool) -> int:
    """Cost of the reading that `_ends` rejects: less behind what may be an abbreviation."""
    if closed or text[start:stop] != ".":
        return _RULED_OUT
    word = _word_before(text, line, start)
    return 2 if word.lower() in TRAILING or _INITIALS.match(word) or len(word) == 1 and word.isupper() else _RULED_OUT


def _path(text: str, line: int, nodes: list[tuple[int, bool, int, int, bool]]) -> list[int]:
    """Where units start behind the marks of a line: place behind, whether the mark alone ends a unit,
    start, stop and `closed` of each node."""
    begins = [_visible(text, line), *(node[0] for node in nodes)]
    ways = []
    for begin, (after, ends, start, stop, closed) in zip(begins, nodes):
        lone = _ALONE if text[begin:start].lower() in TRAILING else 0
        doubt = _doubt(text, line, start, stop, closed)
        ways.append((after, 0, doubt, lone) if ends else (after, doubt, 0, lone))
    return _cheapest(ways)


def _visible(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace() and text[at] != "\n":
        at += 1
    return at


def _ends(text: str, line: int, start: int, stop: int, after: int, closed: bool) -> bool:
    """Whether the terminators text[start:stop] end a sentence; text[after] is the next visible
    character, `closed` tells that a bracket or quotation mark stands between."""
    marks, following = text[start:stop], text[after]
    spaced = after > stop and text[after - 1].isspace()
    if closed:
        if following.islower():
            return bool(_NAME_LIKE.match(text, after)) and spaced
        if _spaceless(following):
            return _first_word(text, after) not in _CARRY_ON
        if following in ",;:、，-–—" or _CARRY_ON_SPACED.match(text, after):
            return False
        if marks[-1] in "!?！？。।":
            return True
    if marks[0] in _FULL or marks[-1] in _FULL:
        return following not in "，、,;"
    if "…" in marks and _spaceless(following):
        return _first_word(text, after) not in _CARRY_ON
    if "…" in marks or "..." in marks or ".." in marks:
        return not following.islower() and (spaced or following.isupper()) and following not in ",;:)"
    if "!" in marks or "?" in marks:
        return (spaced and following not in ",;:") or following.isupper() or _spaceless(following)
    # a single full stop
    word = _word_before(text, line, start)
    head, dot, tail = word.rpartition(".")
    if dot and not _INITIALS.match(word) and word.lower() not in LEADING and len(head) > 1 and not tail.isdigit():
        word = tail  # the blank after the sentence before is missing
    bare = word.lower().strip("[]*_“‘\"'(")
    if not spaced and not closed:
        if not following.isupper() or not (text[after + 1 : after + 2].islower() or text[after + 1 : after + 2] in (" ", "-")):
            return bool(word) and following in "“‘\"" and not _abbreviated(bare)
        return len(bare) > 1 and "@" not in word and "/" not in word and "www" not in bare and not _abbreviated(bare)
    if not bare:
        return False
    if _NUMBERING.match(text, line, start):
        return False
    if bare in LEADING:
        return False
    if bare in NUMBERED:
        return not following.isdigit() and following.isupper() and bare != "approx"
    if len(word) == 1 and word.isupper():
        return False
    if bare in TRAILING:
        return following.isupper() or not (following.isalpha() or following in ",;:)")
    if _INITIALS.match(word):
        return (word[0].islower() and not following.islower()) or bool(re.match(r"(?:The|A|An|In|It|This|If|No|We|He|She|They)\b", text[after : after + 6]))
    if "ऀ" <= word[-1] <= "ॿ" and len(word) <= 3:
        return False
    return following not in ",;:)"


def _abbreviated(bare: str) -> bool:
    return bare in LEADING or bare in TRAILING or bare in NUMBERED or "." in bare and bool(_INITIALS.match(bare))


def sentence_starts(text: str | None) -> list[int]:
    """Position of the first visible character of every sentence unit, in order."""
    if not text:
        return []
    starts: list[int] = []
    size, line = len(text), 0
    isspace = str.isspace

    def visible(at: int) -> int:
        while at < size and isspace(text[at]) and text[at] != "\n":
            at += 1
        return at

    at = visible(0)
    if at < size and text[at] != "\n":
        starts.append(at)
    nodes = _NODES if text.isascii() or not _IN_THAI.search(text) else _NODES_THAI
    found = map(re.Match.span, nodes.finditer(text))
    if not text.isascii() and _IN_CJK.search(text) and (lost := _lost_marks(text)):
        found = sorted([*found, *((a - 1, b) for a, b in lost)])
    skip = 0
    # the marks of the line, and whether one is an abbreviation that an end would leave alone: only then
    # do they depend on each other, else the cheapest path is the cheaper reading of each
    ways: list[tuple[int, bool, int, int, bool]] = []
    lone = False
    for start, stop in found:
        if start < skip:
            continue
        first = text[start]
        if first == "\n":
            if ways:
                starts += _path(text, line, ways) if lone else [way[0] for way in ways if way[1]]
                ways, lone = [], False
            line = start + 1
            at = visible(line)
            if at < size and text[at] != "\n":
                starts.append(at)
            continue
        if first not in _FIRST:
            ways.append((stop, True, start, stop, True))
            continue
        closed = False
        if first in _PARTNER:
            if first == "‘" and start and text[start - 1].isalnum():
                continue
            eol = text.find("\n", start)
            stop = text.find(_PARTNER[first], start + 1, eol if eol >= 0 else size) + 1
            if not stop:
                continue  # never closed in this line
            skip = stop
            inner = stop - 1
            while inner > start and (text[inner - 1] in _CLOSERS or isspace(text[inner - 1])):
                inner -= 1
            if inner <= start + 1 or text[inner - 1] not in _STOPS:
                continue
            closed, end = True, inner
            start = end
            while text[start - 1] in _STOPS:
                start -= 1
        else:
            end = stop
            if stop < size and first == "." and stop == start + 1 and (text[stop].isdigit() or text[stop].islower()):
                continue
        after = stop
        while after < size and text[after] in _CLOSERS:
            if text[after] in "\"'" and after + 1 < size and text[after + 1].isalnum():
                break
            after += 1
            closed = True
        after = visible(after)
        if after < size and text[after] != "\n":
            begin = ways[-1][0] if ways else starts[-1]
            lone = lone or start - begin < 12 and text[begin:start].lower() in TRAILING
            ways.append((after, _ends(text, line, start, end, after, closed), start, end, closed))
    return starts + (_path(text, line, ways) if lone else [way[0] for way in ways if way[1]])


def split_sentences(text: str | None) -> list[str]:
    """The units themselves, without the white space around them."""
    starts = sentence_starts(text)
    return [text[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(text)])] if starts else []


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", content: bool = True) -> DataFrame:
    """One row per sentence unit: key, ordinal, start_pos, end_pos and, with `content`, sentence."""
    kind = df.schema[key].dataType

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            row, ordinal, begin, end, said = [], [], [], [], []
            for k, body in enumerate(texts):
                starts = sentence_starts(body)
                row += [k] * len(starts)
                ordinal += range(len(starts))
                begin += starts
                if content:
                    for a, b in zip(starts, [*starts[1:], len(body or "")]):
                        unit = body[a:b].rstrip()
                        end.append(a + len(unit))
                        said.append(unit)
            columns = [keys.take(pa.array(row, pa.int32())), pa.array(ordinal, pa.int32()), pa.array(begin, pa.int32())]
            names = ["key", "ordinal", "start_pos"]
            if content:
                columns += [pa.array(end, pa.int32()), pa.array(said, pa.string())]
                names += ["end_pos", "sentence"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind.simpleString()}, ordinal int, start_pos int" + (", end_pos int, sentence string" if content else "")
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    return picked.mapInArrow(units, schema).withColumnRenamed("key", key)

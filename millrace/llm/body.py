"""Title and main body of pages whose text mixes the article with what surrounds it.

The page's lines are put into a tree of blocks by what their shape implies, without regard to
their words. A full paragraph (two sentences or more), a list item or a table row is a block of
text; a short line right above one is a heading and opens a section, which closes whatever is open;
a short line above anything else is a leaf of a menu or a teaser. Two such leaves in a row open a
menu, which closes the section: text behind it is hidden until a heading or two blocks of text in a
row open the next section. A lone sentence belongs to the section if it follows its text, else it is
the excerpt of a teaser. Lines before the title are hidden. A line is visible if its block and all
that hold it are. The visible blocks are emitted with their spacing, lists together and table cells
aligned.

Signs in the words (COMPLETE: whole lines, OPENING: how a line begins, INSIDE: what it contains; in
seven languages) are a further feature: a line with a sign is a hidden leaf that opens no menu, as
article text may stand on either side of it; the heading of an aside opens an aside, and "read more"
closes it. With `signs=False` the shape alone decides.

Defined results: null, empty and blank texts have an empty body; a page without any
section keeps its first paragraph; a null title is taken from the first heading.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentences import sentence_starts

#: Whole lines that are links of a page's frame, lower case.
COMPLETE = frozenset(
    x.strip()
    for x in """claims | learn | log in | login | sign in | home | contact | contact us | plans | products | careers | renew online | help centre | help center |
        hospitals near you | terms of use | terms and conditions | privacy | privacy policy | cookie policy | site map | sitemap | back to top | advertisement |
        accept all | reject | manage choices | menu | search | share | print | next | previous | faq | support | news | blog |
        beranda | hubungi kami | simulasi | masuk | promo | cabang | karier | produk | iklan | syarat dan ketentuan | kebijakan privasi | peta situs | setuju | tolak |
        mga produkto | makipag-ugnayan | simula | mag-login | mga sangay | mag-claim | patalastas | patakaran sa pribasiya | mga tuntunin | mapa ng site |
        योजनाएँ | मुखपृष्ठ | अस्पताल खोजें | लॉग इन | संपर्क | दावा | गोपनीयता नीति | नियम और शर्तें | साइट मानचित्र | विज्ञापन |
        เคลมประกัน | ค้นหาสาขา | เกี่ยวกับเรา | เข้าสู่ระบบ | ติดต่อเรา | หน้าแรก | ผลิตภัณฑ์ | ข้อกำหนดการใช้งาน | นโยบายความเป็นส่วนตัว | แผนผังเว็บไซต์ | โฆษณา |
        产品 | 首页 | 关于我们 | 网点查询 | 联系我们 | 登录 | 理赔 | 广告 | 隐私政策 | 使用条款 | 网站地图 |
        サイトマップ | 利用規約 | 個人情報の取り扱い | お問い合わせ | ホーム | ログイン | 会社概要 | 商品一覧 | 広告 | 店舗検索""".split("|")
)
#: Links that close a teaser, and headings of a block of teasers; lower case.
MORE = frozenset("read more|continue reading »|continue reading|(more)|more »|selengkapnya|magbasa pa|और पढ़ें|อ่านเพิ่มเติม|阅读全文|続きを読む".split("|"))
ASIDE = frozenset(
    "popular now|in this section|related pages|you may also like|related articles|artikel lainnya|artikel terkait|iba pang artikulo|अन्य लेख|บทความอื่น|更多文章|関連記事|その他の記事|おすすめ記事".split("|")
)
_DATE = r"(?:\d{4}-\d\d-\d\d|\d{1,2}/\d{1,2}/\d{4}|\d{1,2} \w+ \d{4}|\w+ \d{1,2}, \d{4})"
#: How such lines begin.
OPENING = re.compile(
    r"""(?: we\ use\ cookies | this\ site\ (?:stores|uses) | accept\ all\b | liked\ it\?\ pass | print\ ·\ save | share\ this\ (?:page|article) | subscribe\ to\ | sign\ up\ for\
    | talk\ to\ an\ advis | get\ a\ (?:free\ )?quote | also\ on\ [^:]+: | © | \(c\)\ \d{4} | copyright\b | posted\ in\ | rated\ [\d.]+\ out\ of | call\ free\b | reviewed\ (?:on\ )?\d | updated\ (?:on\ )?\d
    | reviewed\ by\ | last\ (?:updated|reviewed)\b | deal\ of\ (?:the\ )?day | ad\ · | reply\ to\ [^:]+: | quiz: | live\ chat: | by\ the\ .+\ (?:desk|team)\b | most\ read\b | read\ next: | read\ also: | related: | tags:
    | sponsored: | the\ information\ on\ this\ page | follow\ us\b | download\ (?:our|the)\ app
    | setuju\ \| | ajukan\ sekarang | artikel\ terkait: | bagikan\ halaman | diperbarui\ \d | baca\ juga: | oleh\ tim\ redaksi | kami\ memakai\ kuki | balas\ [^:]+: | promo\ [^:]+: | tag: | tentang\ (?:kami|\S+\ \S+)$
    | kumuha\ ng\ quote | basahin\ din: | ibahagi\ ang\ pahina | gumagamit\ kami\ ng\ cookies | tanggapin\ lahat | isinulat\ ng\ pangkat | mga\ tag: | tungkol\ sa\ \S+\ \S+$
    | यह\ पृष्ठ | यह\ भी\ पढ़ें | हम\ बेहतर\ अनुभव | सब\ स्वीकार | प्रायोजित | टैग
    | แบ่งปันหน้า | ขอใบเสนอราคา | เว็บไซต์นี้ใช้คุกกี้ | อ่านต่อ: | ยอมรับทั้งหมด | โดยกองบรรณาธิการ | แท็ก: | สนับสนุนโดย
    | 把本页分享 | 本网站使用 | 立即获取 | 相关阅读 | 全部接受 | 标签 | 赞助
    | このページを | 当サイト | 関連: | 関連記事: | タグ: | すべて同意 | 見積 | about\ (?:us|\S+\ \S+)$ )""",
    re.X,
)
#: What such lines contain.
INSIDE = re.compile(
    rf"""(?: partners\ process\ device\ data | people\ found\ this | orang\ terbantu | ang\ natulungan\ ng | \bis\ a\ brand\ of\ | all\ rights\ reserved | hak\ cipta | nakalaan\ ang\ lahat | सर्वाधिकार | สงวนลิขสิทธิ์ | 版权所有
    | \bmin(?:ute)?\ read$ | menit\ baca$ | minutong\ basahin$ | संपादकीय\ टीम | 编辑部 | 編集部 | อ่าน\ \d+\ นาที | berizin\ dan\ diawasi | से\ अभी\ कोटेशन | के\ बारे\ में$ | को\ उपयोगी
    | \d+\ likes$ | ^\S+\ wrote: | \ content\ team$ | \d+\ comments$ | (?:^|,?\ )(?:on\ )?{_DATE}:\  | แสดงความคิดเห็น | ^[a-z]+(?:评论|さんの) | 条评论 | 人觉得有用 | ^[a-z]+,\ {_DATE} )""",
    re.X,
)
_CRUMBS = re.compile(r"\s+(?:\||·|>|»|/|›|•)\s+")
_SPACE = re.compile(r"\s+")
_ITEM = re.compile(r"[-–•‣▪]\s+\S")
_TERMINAL = re.compile(r"[.!?…。！？।॥][\"'”’»)\]」』）]*\Z")
_ASIAN = re.compile("[ก-๎぀-ヿ一-鿿]")


class Line(NamedTuple):
    kind: str  # blank, frame, more, aside, table, item, text, short
    sentences: int


def classify(line: str, signs: bool = True) -> Line:
    """Implied tag of one line, seen alone; short lines recur and are remembered."""
    return _short(line, signs) if len(line) < 90 else _classify(line, signs)


@functools.lru_cache(maxsize=200_000)
def _short(line: str, signs: bool) -> Line:
    return _classify(line, signs)


def _classify(line: str, signs: bool) -> Line:
    flat = _SPACE.sub(" ", line).strip()
    if not flat:
        return Line("blank", 0)
    if flat[0] == "|":
        return Line("table", 0)
    low = flat.lower()
    bare = low[2:] if low[:2] == "* " else low
    if signs and bare in MORE:
        return Line("more", 0)
    if signs and bare in ASIDE:
        return Line("aside", 0)
    if signs and (bare in COMPLETE or OPENING.match(bare) or INSIDE.search(bare)) or flat[0] in "←→«»" or flat[-1] in "→»←":
        return Line("frame", 0)
    parts = _CRUMBS.split(flat)
    if len(parts) > 1 and max(len(p.split()) for p in parts) <= 9 and not _TERMINAL.search(flat) and not _ITEM.match(flat):
        return Line("frame", 0)
    if flat[:2] == "* " and len(flat.split()) <= 6 and not _TERMINAL.search(flat):
        return Line("frame", 0)
    if _ITEM.match(flat):
        return Line("item", 0)
    if flat[0] == "#":
        return Line("short", 0)
    words, asian = len(flat.split()), len(_ASIAN.findall(flat))
    ended = bool(_TERMINAL.search(flat))
    if ended or words > 14 or asian > 26 + 14 * ("฀" <= flat[0] <= "๿"):
        units = len(sentence_starts(line))
        return Line("text", max(units, words // 40, asian // 110))
    thai = len(re.findall("[ก-๎]", flat))
    if thai > 22:
        return Line("text", max(1, len(sentence_starts(line))))
    return Line("short", 0)


class Block:
    """A node of the layout tree. Its lines are visible if it and all that hold it are."""

    def __init__(self, tag: str, parent: Block | None = None) -> None:
        self.tag, self.parent = tag, parent
        self.shown = tag not in ("aside", "teaser", "menu") and (parent is None or parent.shown)

    def within(self, *tags: str) -> Block | None:
        """The nearest block of one of these tags that holds it, itself included."""
        block: Block | None = self
        while block is not None and block.tag not in tags:
            block = block.parent
        return block

    def closed(self, *tags: str) -> Block:
        """What stays open if the outermost block of these tags is closed, with all it holds."""
        left = self
        while (block := left.within(*tags)) is not None and block.parent is not None:
            left = block.parent
        return left


def _flat(line: str) -> str:
    return _SPACE.sub(" ", line).strip()


def _full(line: str, seen: Line) -> bool:
    """Whether the line is a paragraph of its own: two sentences, and not just two cries."""
    return seen.kind == "text" and seen.sentences > 1 and line.lstrip()[:1] != "©" and (len(line.split()) >= 7 or len(_ASIAN.findall(line)) >= 20)


def _title(lines: list[str], tags: list[str], order: list[int], title: str | None) -> int | None:
    wanted = _flat(title).lower() if title else None
    if not wanted:
        return next((k for k in order if tags[k] == "short"), None)
    same = [k for k in order if len(lines[k]) < len(wanted) * 2 + 40 and _flat(lines[k]).strip("# ").lower() == wanted]
    return next((k for k in same if tags[k] in ("short", "text")), same[0] if same else None)


def visible(lines: list[str], title: str | None, signs: bool = True) -> tuple[list[bool], list[str]]:
    """Which lines belong to title or main body, and the tag of each line."""
    seen = [classify(line, signs) for line in lines]
    tags = [s.kind for s in seen]
    show = [False] * len(lines)
    order = [k for k, s in enumerate(seen) if s.kind != "blank"]
    blocks = {k for k in order if tags[k] in ("table", "item") or _full(lines[k], seen[k])}
    head = _title(lines, tags, order, title)
    if head is not None:
        show[head], tags[head] = True, "title"
    root = Block("page")
    article = Block("article", root)
    here, leaves = root, 0
    for n, k in enumerate(order):
        kind = tags[k]
        before = order[n - 1] if n else None
        # a line with a sign in its words doesn't come between a heading and its text
        after = next((order[j] for j in range(n + 1, len(order)) if tags[order[j]] != "frame"), None)
        if kind == "title":
            here, leaves = article, 0
            continue
        if kind == "aside":
            here = Block("aside", here.closed("aside", "teaser"))
        elif kind == "more":
            here = here.closed("aside", "teaser")  # the link ends the teasers
        elif kind == "short" and after in blocks:
            here = Block("section", article)
            tags[k] = "heading"
        elif kind == "short":
            leaves += 1
            here = Block("teaser", here.closed("teaser")) if leaves < 2 else Block("menu", root) if not here.within("aside") else here
            tags[k] = "teaser"
            continue
        elif k in blocks:
            here = here.closed("teaser")
            if here.within("article") is None and not here.within("aside") and after in blocks:
                here = Block("section", article)  # text on text needs no heading
        elif kind == "text":
            if here.tag == "teaser" or before is None or not show[before] or tags[before] == "title":
                tags[k] = "excerpt"
                here, leaves = here.closed("teaser"), leaves + 1
                continue
        if kind in ("short", "text", "table", "item"):
            show[k] = here.within("article") is not None and here.shown
            leaves = 0 if show[k] else leaves
    if not any(s for k, s in enumerate(show) if tags[k] in ("text", "table", "item", "heading")):
        # nothing opened a section: the first headline with its sentence is the article
        for n, k in enumerate(order):
            if tags[k] == "excerpt":
                show[k], tags[k] = True, "text"
                if n and tags[order[n - 1]] == "teaser":
                    show[order[n - 1]], tags[order[n - 1]] = True, "heading"
                break
    return show, tags


def render(lines: list[str], show: list[bool], tags: list[str]) -> str:
    """The visible blocks: a blank line between blocks, lists together, table cells aligned."""
    blocks: list[tuple[str, list[str]]] = []
    for line, shown, tag in zip(lines, show, tags):
        if shown:
            kind = tag if tag in ("table", "item") else "p"
            if kind != "p" and blocks and blocks[-1][0] == kind:
                blocks[-1][1].append(_SPACE.sub(" ", line).strip())
            else:
                blocks.append((kind, [_SPACE.sub(" ", line).strip()]))
    out = []
    for kind, rows in blocks:
        if kind == "table":
            cells = [[c.strip() for c in row.strip("|").split("|")] for row in rows]
            widths = [max((len(r[k]) for r in cells if k < len(r) and set(r[k]) - set("-: ")), default=3) for k in range(max(map(len, cells)))]
            rows = ["| " + " | ".join(c.ljust(w) if set(c) - set("-: ") or not c else "-" * w for c, w in zip(r, widths)) + " |" for r in cells]
        out.append("\n".join(rows))
    return "\n\n".join(out)


def main_bodies(df: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", signs: bool = True) -> DataFrame:
    """key, page_title, body (rendered) and hidden (numbers of the non-blank lines left out) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies, hidden = [], [], []
            for body, named in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (body or "").split("\n")
                show, tags = visible(lines, named, signs)
                head = next((k for k, tag in enumerate(tags) if tag == "title"), None)
                heads.append(lines[head].strip() if head is not None else named)
                bodies.append(render(lines, [s and tag != "title" for s, tag in zip(show, tags)], tags))
                hidden.append([k for k, s in enumerate(show) if not s and tags[k] != "blank"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(heads, pa.string()), pa.array(bodies, pa.string()), pa.array(hidden, pa.list_(pa.int32()))],
                ["key", "page_title", "body", "hidden"],
            )

    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title"))
    return picked.mapInArrow(run, f"key {kind}, page_title string, body string, hidden array<int>").withColumnRenamed("key", key)

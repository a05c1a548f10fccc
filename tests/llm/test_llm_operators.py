"""Operators for training text against brute force, exact round trips and held-out accuracy."""

import base64
import datetime as dt
import json
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import body, language, lines, neardup, packing, pii, pii_train, quantiles, queries, sentences, split, tokens
from millrace.llm.bpe import encoder


# ---------------------------------------------------------------- p1


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(line.lower().split()))


def test_repeated_lines_match_brute_force(spark):
    r = random.Random(2)
    rows = []
    for k in range(200):
        body_ = [r.choice([f"Notice {r.randint(1, 9)} of site", "Share  this PAGE", "# heading", "| cell |", "", f"own {k}-x", "by line"]) for _ in range(8)]
        rows.append((k, r.choice(["a", "b", None]), "\n".join(body_), "extra"))
    rows += [(500, "a", None, "x"), (501, "a", "", "x"), (502, None, " \n ", "x"), (0, *rows[0][1:])]
    docs = defaultdict(set)
    for k, s, t, _ in rows:
        for line in (t or "").split("\n"):
            if normal(line) and normal(line)[0] not in "#|":
                docs[s, normal(line)].add(k)
    want = sorted((k, n) for k, s, t, _ in rows for n, line in enumerate((t or "").split("\n")) if len(docs.get((s, normal(line)), ())) >= 5)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, key string").repartition(5)
    assert sorted(map(tuple, lines.repeated_lines(df).collect())) == want
    cleaned = {x["doc_id"]: x for x in lines.without_repeated_lines(df).collect()}
    gone = set(want)
    for k, _, t, _ in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)
        assert cleaned[k]["text"] == kept and cleaned[k]["key"] in ("extra", "x")


def test_tree_forgets_without_losing_documents(spark, monkeypatch):
    tree = lines.TemplateTree(5, capacity=3)
    new = [tree.add("s", [f"t{k % 4}", "x"], k)[1] for k in range(40)]
    assert sum(new) >= 20


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert lines.repeated_lines(empty).count() == 0 and lines.without_repeated_lines(empty).count() == 0


# ---------------------------------------------------------------- p2

TEXTS = {
    "paragraphs": "\n\n".join(" ".join(f"Word{k} is here." for k in range(40)) for _ in range(12)),
    "one_sentence": " ".join(f"w{k}" for k in range(3000)),
    "spaceless": "这是一个很长的句子，" * 900,
    "thai": "ก" * 9000,
    "long_words": " ".join("x" * 900 for _ in range(60)),
    "one_word": "y" * 20000,
    "lines": "\n".join(f"line {k} of the list" for k in range(900)),
}


@pytest.mark.parametrize("name", TEXTS)
def test_pieces_keep_limits_and_cover_the_text(name):
    t, limits = TEXTS[name], split.Limits()
    pieces = split.split_text(t, limits)
    assert pieces[0].start == 0 and len(pieces) > 1
    for before, piece in zip([None, *pieces], pieces):
        content = t[piece.start : piece.stop]
        assert len(content) <= limits.chars and len(content.split()) <= limits.words
        if before:
            assert t[before.stop : piece.body].strip() == ""  # nothing between two pieces is lost
            repeated = t[piece.start : before.stop]
            if name in ("spaceless", "thai", "one_word", "long_words"):
                assert len(repeated) in (200, 199, 198) or len(repeated) == len(t[before.start : before.stop])
            else:
                assert repeated.split() == t[before.start : before.stop].split()[-40:]
    assert t[pieces[-1].stop :].strip() == ""


def test_cuts_fall_between_sentences():
    t = TEXTS["paragraphs"]
    assert all(t[p.stop - 1] == "." for p in split.split_text(t))
    assert sum(t[p.stop : p.stop + 2] == "\n\n" for p in split.split_text(t)[:-1]) >= len(split.split_text(t)) - 2


def test_small_empty_and_null_items(spark):
    rows = [("a", 1, None), ("a", 2, ""), ("b", 3, "short text"), ("b", 3, "short text"), ("c", 4, TEXTS["lines"])]
    got = split.pieces(spark.createDataFrame(rows, "tbl string, content long, t string"), ["tbl", "content"][:1], "t").collect()
    assert [x["content"] for x in got[:4]] == ["", "", "short text", "short text"]
    assert max(x["words"] for x in got) <= 400 and got[-1]["item_words"] == 4500


# ---------------------------------------------------------------- p3


def test_summaries_stay_within_a_percent(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), dt.date(2026, 1, 1 + r.randrange(3)), r.choice([r.lognormvariate(6, 1), 100.0])) for _ in range(30000)]
    rows += [("hot", dt.date(2026, 1, 1), None), ("hot", dt.date(2026, 1, 1), float("nan")), ("inf", dt.date(2026, 1, 2), float("inf")), ("none", dt.date(2026, 1, 2), None)]
    df = spark.createDataFrame(rows, "p string, day date, v double").repartition(7)
    daily = quantiles.summarize(df, {"p": F.col("p"), "day": F.col("day")}, {"v": F.col("v")})
    whole = quantiles.merge(daily, ["p", "metric"], 0.0025)
    for summaries, key in ((daily, lambda x: (x["p"], x["day"])), (whole, lambda x: x["p"])):
        for x in quantiles.read_off(summaries, {"p50": 0.5, "p99": 0.99}).collect():
            own = sorted(v for p, d, v in rows if v is not None and v == v and (p, d if isinstance(key(x), tuple) else None) == (x["p"], x["day"] if isinstance(key(x), tuple) else None))
            assert len(own) == x["n"] and x["rank_error"] <= 0.01
            for name, f in (("p50", 0.5), ("p99", 0.99)):
                want = max(1, int(np.ceil(f * len(own))))
                low, high = np.searchsorted(own, x[name], "left") + 1, np.searchsorted(own, x[name], "right")
                assert max(low - want, want - high, 0) <= 0.01 * len(own)
    assert "none" not in {x["p"] for x in whole.collect()}
    assert quantiles.summarize(df.limit(0), {"p": F.col("p")}, {"v": F.col("v")}).count() == 0


def test_merging_is_exact_for_uncompressed_summaries():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 50, n).astype(float) for n in (1, 40, 300, 0, 7)]
    merged = quantiles.Summary.merged([quantiles.Summary.of(p) for p in parts])
    everything = np.sort(np.concatenate(parts))
    assert merged.n == len(everything) and all(merged.at(f)[1] <= 4 for f in (0.01, 0.5, 0.99))
    packed = quantiles.Summary.unpack(merged.pack())
    assert (packed.values == merged.values).all() and packed.n == merged.n


def test_merging_thousands_of_parts_is_linear_and_stays_bounded():
    r = np.random.default_rng(3)
    parts = [quantiles.Summary.of(r.lognormal(6, 1, 200)).compressed(0.00125) for _ in range(4000)]
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        merged = quantiles.Summary.merged(parts[:n])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.05
    assert (np.diff(merged.low) >= 0).all() and (np.diff(merged.high) >= 0).all() and (merged.low <= merged.high).all()
    level = [quantiles.Summary.merged(parts[k : k + quantiles.FAN]).compressed(0.003) for k in range(0, 4000, quantiles.FAN)]
    whole = quantiles.Summary.merged(level).compressed(0.005)
    assert len(whole.values) < 1500 and max(whole.at(q)[1] for q in (0.01, 0.5, 0.9, 0.99)) <= 0.005 * whole.n


def test_levels_of_the_merge(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    df = spark.range(40_000).select((F.col("id") % 7919).cast("double").alias("v")).repartition(30)
    found = quantiles.read_off(quantiles.summarize(df, {"all": F.lit("x")}, {"v": F.col("v")}), {"p50": 0.5}).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 1 and found[0]["n"] == 40_000 and abs(found[0]["p50"] - 3960) <= 80 and found[0]["rank_error"] <= 0.005


# ---------------------------------------------------------------- p4


def test_trees_find_items_in_frames_they_have_not_seen():
    made = pii_train.passages(77, 700, pii_train.FINAL, pii_train.FALSE_HELD)
    for kind, (recall, precision) in pii_train.quality(made, pii.model(), pii.model().thresholds).items():
        assert recall > 0.87 and precision > 0.9, (kind, recall, precision)
    assert pii.model().trees and json.loads(Path(pii.__file__).with_name("pii_model.json").read_text())["features"] == pii.FEATURES


def test_no_frame_of_training_stands_in_the_tables(spark):
    d = "/root/testdata/sf0.001"
    columns = (("records", "content"), ("call_turns", "caller"), ("documents", "text"), ("sample_leads", "phone"))
    text = " ".join("\n".join(r[0] for t, c in columns for r in spark.read.parquet(f"{d}/{t}.parquet").select(c).distinct().collect() if r[0]).split(" "))
    composer = pii_train.Composer(1)
    for frame in pii_train.TRAIN + pii_train.FALSE + pii_train.HELD + pii_train.FINAL + pii_train.FALSE_HELD:
        for chosen in {composer.chosen(frame) for _ in range(6)}:
            literal = re.sub(r"\{\w\}", "", chosen)
            if sum(map(str.isalpha, literal)) >= 10 and max(re.split(r"\{\w\}", chosen), key=len).strip() in text:
                pattern = re.sub(r"\\\{(\w)\\\}", lambda m: r"[^\W\d_]+" if m[1] in "wT" else r"[^\n.?!:;]{1,60}?", re.escape(chosen))
                assert not re.search(pattern, text), chosen


def test_items_in_unlike_wording():
    said = {
        "Kindly revert to Anjali Deshmukh at x@y.example; her residence is 14B Baker Court, Pune 411001.": {"Anjali Deshmukh", "x@y.example", "14B Baker Court, Pune 411001"},
        "Patient José García-Márquez, SSN 123-45-6789, phone 555-0134": {"José García-Márquez", "123-45-6789", "555-0134"},
        "मेरा नाम राहुल वर्मा है": {"राहुल वर्मा"},
        "Our agent Mary O'Brien lives at 221B Baker St, London.": {"Mary O'Brien", "221B Baker St, London"},
    }
    for text, wanted in said.items():
        assert {text[c.start : c.stop] for c in pii.find([text])[0]} == wanted, text


def test_masking_leaves_the_rest(spark):
    cases = [
        ("Customer: Asha Rao, phone +91 98765 43210, wants a call on Zed Care.", "Customer: [NAME], phone [PHONE], wants a call on Zed Care."),
        ("Table 4 lists 4291 8829 1204 households.", "Table 4 lists 4291 8829 1204 households."),
        ("Head office of Zed Ltd.: 67, Mila Road, Kesmora.", "Head office of Zed Ltd.: 67, Mila Road, Kesmora."),
        ("You can mail me at zeje dot zama at lupo dot example please.", "You can mail me at [EMAIL] please."),
        (None, None), ("", ""), ("   ", "   "),
    ]
    rows = [(k, t, False, "x") for k, (t, _) in enumerate(cases)] + [(90, "same as above", True, "x"), (91, "0000000000", True, "x"), (92, "via Mrs Asha Rao: 71040-12029", True, "x")]
    df = spark.createDataFrame(rows, "key long, body string, field boolean, masked string")
    got = {x["key"]: x["masked"] for x in pii.personal_data(df, "key", "body", "field").collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
    assert (got[90], got[91], got[92]) == ("same as above", "0000000000", "via Mrs [NAME]: [PHONE]")


# ---------------------------------------------------------------- p5


def shingles(t):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return frozenset(zip(w, w[1:], w[2:]))


@pytest.mark.parametrize("hot", [neardup.HOT, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    r = random.Random(11)
    vocabulary, rows = [f"v{k}" for k in range(300)], []
    for k in range(80):
        base = [r.choice(vocabulary) for _ in range(r.randint(10, 90))]
        for n in range(r.randint(1, 5)):
            edited = list(base)
            for _ in range(r.randint(0, 4)):
                edited[r.randrange(len(edited))] = r.choice(vocabulary)
            rows.append((f"r{k}_{n}", " ".join(edited)))
    rows += [("n", None), ("e", ""), ("s", "a b"), ("s2", "a b"), ("c1", "x y z"), ("c2", "X, y; z!")] + [("dup", rows[0][1])] * 2
    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    links = neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string").repartition(6), "id", "content", sketch_bits=10)
    got = [tuple(x) for x in neardup.record_pairs(links).collect()]
    assert set(got) == want and len(got) == len(want)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for x in neardup.record_groups(links).collect():
        groups[x["group_id"]].add(x["id"])
    wanted = defaultdict(set)
    for k in keys:
        wanted[root(k)].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_large_groups_of_copies_are_a_star(spark):
    rows = [(f"k{n:03}", "one two three four") for n in range(130)] + [("other", "one two three four five")]
    links = neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string"), "id", "content", threshold=(2, 3))
    got = {tuple(x) for x in neardup.record_pairs(links).collect()}
    assert got == {("k000", f"k{n:03}") for n in range(1, 130)} | {("k000", "other")}
    assert {x["group_id"] for x in neardup.record_groups(links).collect()} == {neardup.record_groups(links).first()["group_id"]}


def test_pairs_and_membership_give_back_every_link(spark):
    words = " ".join(f"w{k}" for k in range(12))
    texts = {f"k{n:03}": words for n in range(150)} | {f"n{n}": f"{words} more{n}" for n in range(3)} | {"m0": words.upper(), "m1": words.upper(), "far": "a b c d"}
    links = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "id string, content string"), "id", "content")
    same = defaultdict(list)
    for x in links.members.collect():
        same[x["content"]].append(x["key"])
    of = {key: sorted(keys) for keys in same.values() for key in keys}
    back = set()
    for a, b in links_of(neardup.record_pairs(links)):
        back |= {(min(x, y), max(x, y)) for x in of[a] for y in of[b] if x != y}
    assert back == set(links_of(neardup.record_pairs(links, expand_copies=None))) and len(back) == 155 * 154 // 2


def links_of(df):
    return [tuple(x) for x in df.collect()]


def test_sets_of_one_template_meet_on_what_is_rare():
    template = [f"t{k}" for k in range(40)]
    own = [" ".join([*template[:20], *(f"u{k}x{j}" for j in range(18)), *template[20:]]) for k in range(3000)]
    row, codes = neardup.sequences(own, 3)
    sketch = np.bincount((codes & np.uint64((1 << 20) - 1)).astype(np.int64), minlength=1 << 20)
    often = sketch[(codes & np.uint64((1 << 20) - 1)).astype(np.int64)]
    prefix = np.bincount(row)[0] - int(np.ceil(0.75 * np.bincount(row)[0])) + 1
    assert all(np.sort(often[row == k])[prefix - 1] < 100 for k in range(0, 3000, 300))


def test_all_pairs_of_a_large_set_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    words = " ".join(f"w{k}" for k in range(12))
    rows = [(f"k{n:03}", words) for n in range(70)] + [(f"m{n:03}", words.replace(" ", " " * (n + 2), 1)) for n in range(60)]
    rows += [("x1", f"{words} more"), ("x2", f"{words} more"), ("far", "one two three")]
    spark.createDataFrame(rows, "record_id string, content string").write.parquet(f"{tmp_path}/records.parquet")
    keys = sorted(k for k, _ in rows if k != "far")
    want = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    assert sorted(map(tuple, queries.queries()["p5_found"](spark, str(tmp_path)).collect())) == want


def test_links_count_records(spark):
    words = " ".join(f"w{k}" for k in range(12))
    rows = [(f"k{n}", words) for n in range(3)] + [("m", words.upper()), ("m", words.upper())] + [(f"x{n}", f"{words} more") for n in range(2)]
    rows += [("p", "a b c d"), ("q", "a  b c d"), ("far", "one two three"), ("none", None)]
    links = neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string"), "id", "content")
    got = {x["id"]: x["links"] for x in neardup.record_groups(links).collect()}
    assert got == {"k0": 5, "k1": 5, "k2": 5, "m": 5, "x0": 5, "x1": 5, "p": 1, "q": 1, "far": 0, "none": 0}
    paired = [k for pair in neardup.record_pairs(links, expand_copies=None).collect() for k in pair]
    assert all(paired.count(k) == n for k, n in got.items())


def test_only_equal_texts_are_collapsed(spark):
    rows = [(f"k{n}", "one two three four") for n in range(4)] + [("m0", "one  two three four"), ("m1", "One two three four"), ("other", "one two three four five")]
    links = neardup.near_duplicates(spark.createDataFrame(rows, "id string, content string"), "id", "content", threshold=(2, 3))
    got = sorted(map(tuple, neardup.record_pairs(links, expand_copies=2).collect()))
    assert got == sorted([("k0", f"k{n}") for n in (1, 2, 3)] + [(a, b) for i, a in enumerate(["k0", "m0", "m1", "other"]) for b in ["k0", "m0", "m1", "other"][i + 1 :]])


# ---------------------------------------------------------------- p6

PAGE = """Claims > Help centre > Home
* Contact
We use cookies to improve your visit. By staying on this page you accept our policy.
Limits of Zed Care
Share this page: mail · chat · copy link
16. Rules for Mila Bridge
Doors open at 10 a.m. Latecomers wait outside. Keep bills and slips.
- Menu of Zed riders
| Plan | Cover |
|---|---|
| Zed | Rs 1 |

Related pages
Questions about Mila Rider
Read more
How Zed handles room rent
Members wait nine months before room rent is paid.
© 2024 Zed Life. All rights reserved."""


def test_main_body(spark):
    df = spark.createDataFrame([(1, PAGE, "Limits of Zed Care"), (2, None, None), (3, "", "T"), (4, "Only one sentence here.", None)], "doc_id long, text string, title string")
    got = {x["doc_id"]: x for x in body.main_bodies(df).collect()}
    assert got[1]["hidden"] == [0, 1, 2, 4, 12, 13, 14, 15, 16, 17]
    assert got[1]["page_title"] == "Limits of Zed Care"
    assert got[1]["body"].split("\n\n") == ["16. Rules for Mila Bridge", "Doors open at 10 a.m. Latecomers wait outside. Keep bills and slips.", "- Menu of Zed riders", "| Plan | Cover |\n| ---- | ----- |\n| Zed  | Rs 1  |"]
    assert got[2]["body"] == got[3]["body"] == "" and got[4]["body"] == "Only one sentence here."


def test_structure_alone_finds_most_of_what_surrounds_an_article(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("source_type = 'web_page' AND text IS NOT NULL").select("text", "title").collect()]
    both = only = found = 0
    for text, title in pages:
        page = text.split("\n")
        with_signs, without = (body.visible(page, title, signs)[0] for signs in (True, False))
        hidden = [{k for k, line in enumerate(page) if line.strip() and not shown[k]} for shown in (with_signs, without)]
        both, only, found = both + len(hidden[0] & hidden[1]), only + len(hidden[0]), found + len(hidden[1])
    assert both / only > 0.9 and both / found > 0.97


def test_structure_of_a_page_in_other_words():
    page = """Startseite
Themen
Wetter
Der Berg ruft
Der Vulkan hat am Montag Asche gespuckt. Die Behörden haben zwei Dörfer geräumt.
Hintergrund
- Letzter Ausbruch vor zwölf Jahren
- Höhe 2.900 Meter
Mehr dazu
Wanderer in Not
Rezepte für den Herbst
Impressum""".split("\n")
    shown = body.visible(page, "Der Berg ruft", signs=False)[0]
    assert [k for k, s in enumerate(shown) if s] == [3, 4, 5, 6, 7]


def test_lines_inherit_the_visibility_of_their_block():
    page = ["Limits of Zed Care", "Doors open at ten. Latecomers wait outside.", "Related pages", "Zed pays for rooms. Zed pays for beds.", "- Rooms of Zed", "| Beds | Zed |", "Rules for Mila Bridge", "Keep bills and slips. The desk may ask.", "- Menu of Zed riders"]
    assert body.visible(page, page[0])[0] == [True, True, False, False, False, False, True, True, True]
    page[4] = "Read more"  # ends the aside
    assert body.visible(page, page[0])[0] == [True, True, False, False, False, True, True, True, True]


# ---------------------------------------------------------------- p7


def test_held_out_samples_are_recognised(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").select("lang", "text").collect()]
    rows.sort()
    fitted, held = rows[::2], rows[1::2]
    labeller = language.Labeller(language.Scorer(fitted))
    right = sum(language.whole(s)[0] == lang for (lang, _), s in zip(held, labeller.label([t for _, t in held])))
    assert right / len(held) > 0.98


UNLIKE = {
    "en": "The river froze early this winter.|Our teacher read a poem about the sea.|Nobody saw the thief leave the museum.|She grows tomatoes on her balcony.|The train was late because of heavy snow.|He plays the violin in a small orchestra.|We walked along the beach until sunset.|Dinosaurs lived millions of years ago.|The baker sells fresh bread every morning.|Two boys kicked a ball across the street.|My grandmother told us stories about the war.|The engine makes a strange noise when it starts.",
    "id": "Gunung Merapi memuntahkan awan panas sejauh lima kilometer kemarin sore.|Anak-anak bermain layang-layang di lapangan dekat sungai.|Ibu memasak rendang untuk pesta pernikahan kakak.|Kereta api berangkat pukul tujuh pagi dari stasiun.|Pemerintah membangun jembatan baru di atas sungai itu.|Nelayan menangkap ikan sejak subuh hingga siang.|Buku itu ditulis oleh seorang guru dari desa kecil.|Hujan deras membuat jalan raya tergenang air.|Dia belajar bahasa Jepang selama tiga tahun.|Kucing hitam itu tidur di bawah meja makan.|Para petani memanen padi pada bulan April.|Mereka menonton pertandingan sepak bola bersama teman-teman.",
    "fil": "Naglalaro ang mga bata sa tabi ng ilog tuwing hapon.|Nagluto si nanay ng masarap na adobo para sa hapunan.|Malakas ang ulan kagabi kaya binaha ang kalsada.|Sumakay kami ng dyip papuntang palengke.|Isinulat ng guro ang tula sa pisara.|Maagang gumising ang magsasaka upang mag-ani ng palay.|Kumakanta siya habang naglalaba ng mga damit.|Mahilig magbasa ng nobela ang kapatid kong babae.|Nahulog ang mangga mula sa mataas na puno.|Umuwi ang mangingisda na maraming huli.|Pinanood namin ang paglubog ng araw sa dalampasigan.|Bumili ng bagong sapatos ang tatay niya.",
    "jv": "Bocah-bocah padha dolanan layangan ing sawah.|Simbah crita babagan jaman perang biyen.|Udan deres mau bengi marakake kali banjir.|Ibu masak jangan lodeh kanggo bapak.|Kucinge turu ing ngisor meja nganti sore.|Wong tani lagi ndhaut winih pari ing sawah.|Adhiku seneng nggambar wit lan kembang.|Sapine mangan suket ing pinggir kali.|Aku arep lunga menyang kutha sesuk esuk.|Gunung iku katon dhuwur banget saka kene.|Pakdhe tuku wedhus loro ing pasar kewan.|Kancaku ora bisa teka amarga lara weteng.",
    "hi": "बच्चे नदी के किनारे पतंग उड़ा रहे थे।|माँ ने शादी के लिए मिठाई बनाई।|कल रात बहुत तेज़ बारिश हुई।|किसान सुबह खेत में काम करता है।",
    "th": "เด็กๆเล่นว่าวอยู่ริมแม่น้ำ|แม่ทำแกงเขียวหวานให้ครอบครัว|เมื่อคืนฝนตกหนักมาก|ชาวนาเกี่ยวข้าวตั้งแต่เช้า",
    "ja": "子どもたちは川辺で凧を揚げていました。|母は夕食にカレーを作りました。|昨夜は大雨が降った。|東京大学|駅前の図書館で本を借りた。",
    "zh": "孩子们在河边放风筝。|妈妈做了一桌好菜。|昨天晚上下了一场大雨。|他在图书馆借了两本书。|農民從早上開始收割稻米，孩子們在旁邊玩耍。",
}


def test_sentences_of_other_fields_are_recognised(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").select("lang", "text").collect())
    scorer = language.fitted(rows)
    labeller = language.Labeller(scorer)
    right = total = 0
    for lang, said in UNLIKE.items():
        for segments in labeller.label(said.split("|")):
            right, total = right + (language.whole(segments)[0] == lang), total + 1
    assert right / total >= 0.95 and 0.05 <= scorer.slope <= 2.0
    assert labeller.label(["Это русский текст.", "write to maruh.dalam@rumah.example"])[0] == []


def test_fit_takes_every_language(spark):
    rows = spark.createDataFrame([(lang, f"{word} {k}") for lang, word in (("en", "house"), ("zh", "房子"), ("th", "บ้าน")) for k in range(1500)], "lang string, text string")
    assert language.fit(rows).scores["house"]


def test_segments_of_mixed_texts(spark):
    scorer = language.Scorer([])
    en, fil, hi, ja, zh = "The members of this plan wait for the claims desk.", "Hindi ko pa po kayang magbayad ngayon para sa inyo.", "यह योजना अस्पताल का खर्च देती है।", "保険料は前年より上がりました。", "如果保单丢失请联系服务点。"
    df = spark.createDataFrame([(1, f"{en} {fil}"), (2, f"{en}\n{hi}"), (3, ja), (4, zh), (5, None), (6, ""), (7, "12 34"), (8, f"{ja}{zh}")], "key long, text string")
    got = {x["key"]: x for x in language.languages(df, "key", "text", scorer).collect()}
    assert {k: set(got[k]["present"]) for k in got} == {1: {"en", "fil"}, 2: {"en", "hi"}, 3: {"ja"}, 4: {"zh"}, 5: set(), 6: set(), 7: set(), 8: {"ja", "zh"}}
    assert (got[5]["detected"], got[5]["confidence"]) == (None, 0.0) and got[7]["segments"] == []
    first, second = got[1]["segments"]
    assert (first["language"], second["language"]) == ("en", "fil") and abs(second["start_pos"] - len(en)) < 12 and second["confidence"] > 0.9


def test_lockstep_equals_plain_viterbi():
    labeller = language.Labeller(language.Scorer([]))
    text = "the members wait hindi ko pa po kayang yang dan untuk the desk of the plan"
    scores = [labeller.scorer.of(t) or (0,) * 8 for t in language._TOKEN.findall(text)]
    best = [(list(scores[0]), None)]
    for s in scores[1:]:
        last = best[-1][0]
        top = max(last) - labeller.penalty
        best.append(([max(v, top) + e for v, e in zip(last, s)], None))
    segments = labeller.label([text, "x"] * 3)
    assert segments[0] == segments[2] == segments[4]
    gained = sum(sum((labeller.scorer.of(t) or (0,) * 8)[language.LANGUAGES.index(g.language)] for t in language._TOKEN.findall(text[g.start : g.stop])) for g in segments[0])
    assert abs(gained - labeller.penalty * (len(segments[0]) - 1) - max(best[-1][0])) < 1e-6


# ---------------------------------------------------------------- p8, p9


def test_encoding_equals_the_public_encoder(spark):
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    truth = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "  a\n\n b\x1c c\x85　x", "'s it's  ", " \n", "<|endoftext|> x", "a" * 700, "é ö 😀👨‍👩‍👧 ok\t\tz\r\n", "ไทย 中文 हिन्दी ａ①", "x" * 30000 + " y", None]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode(df).collect()}
    assert all(got[k] == truth.encode_ordinary(t or "") for k, t in enumerate(texts))
    counts = {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(df).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_encoder_survives_a_full_cache():
    bpe = encoder()
    small = type(bpe).__new__(type(bpe))
    small.__dict__.update(bpe.__dict__, cache_size=5, runs={}, pieces={})
    texts = [f"Unusual{k} words{k * 7} in text {k}" for k in range(60)]
    assert [small.encode([t])[0] for t in texts] == bpe.encode(texts)


def test_packing_is_whole_and_tight(spark):
    r = random.Random(8)
    sizes = [min(int(r.lognormvariate(5.8, 1)), 9000) for _ in range(3000)] + [0] * 30 + [2048] * 5 + [100] * 900 + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long")
    got = packing.pack(df, "doc_id", "n", 2048).collect()
    filled, parts, places = defaultdict(int), defaultdict(list), set()
    for x in got:
        filled[x["container"]] += x["length"]
        parts[x["doc_id"]].append((x["piece_no"], x["start"], x["length"]))
        assert (x["container"], x["position"]) not in places
        places.add((x["container"], x["position"]))
    assert max(filled.values()) <= 2048
    for k, n in enumerate(sizes):
        own = sorted(parts[k])
        assert sum(length for *_, length in own) == (n or 0) and [s for _, s, _ in own] == [2048 * j for j in range(len(own))]
        assert len(own) == (1 if not n or n <= 2048 else -(-n // 2048))
    assert len(filled) <= np.ceil(sum(n or 0 for n in sizes) / 2048) * 1.01 + 1
    assert packing.pack(df.limit(0), "doc_id", "n", 2048).count() == 0
    only_empty = packing.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n long"), "doc_id", "n", 2048).collect()
    assert sorted((x["container"], x["position"], x["length"]) for x in only_empty) == [(0, 0, 0), (0, 1, 0)]


# ---------------------------------------------------------------- p10

SENTENCES = [
    "Holders pay Rs. 469,043 for X Plus, i.e. 21.8% more than in 2016.|Version 2.0.4 is out [64].|Older cards work.",
    "Mr. Jokrini signed; Ms. Tru signed for the group.|K. R. Hesaso of Bralipet chaired.",
    "“Call us back.”|Nothing else was said.|“Is it covered?” is what callers ask.",
    "He said: “Wait. Do not pay. Call us.” and hung up.|(It was 2023.)|It now covers more.",
    "Wait... the form is not it.|It costs Rs 3,731...|Nobody pays that.|The rate fell to .24 of it… and stayed.",
    "Doors open at 8 a.m.|Latecomers wait.|It closes at 9 p.m. on weekdays.|The bill went to Zed Ltd.|Nobody paid it.",
    "Keep bills, etc.|The desk may ask.|The form asks for D.O.B., blood group, etc., before cover.|The U.S. parent owns it.",
    "X is for Zed Rider.|e-cards come later.|See www.zed.example/p.80 for it.|Was it vol. 11 or No. 9?|Prof. Gu could not say, approx. 5.8 million.",
    "24. Mga tuntunin ng Zed|",
    "Ia berkata, \"Tunggu. Jangan bayar dulu.\" lalu menutup telepon di Jl. Ge No. 85.|Biaya naik.|Lampirkan KTP, dll. sebelum cair.",
    "उसने कहा, “रुकिए। अभी भुगतान न करें।” और फ़ाइल बंद कर दी।|Zed प्रा. लि. ने दर घटाई।|डॉ. Zed के अनुसार रु. 700 लगते हैं।",
    "「書類は届きました。」とZed担当者は答えました。|本当に？|Zedは払います。",
    "他说：“等等。先别付款。”然后挂断了电话。|真的吗？！|Zed最多赔158,000元。|Zed（原Ta计划。现已停售）仍可续保……|客户不必担心。",
    "สาขา Zed ปิดรับคำร้องของ Ta ในวันหยุด|เบี้ยประกันของ Zed เพิ่มขึ้นร้อยละ 25.3 เมื่อเทียบกับปีก่อน",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_sentence_boundaries(marked):
    parts = [p for p in marked.split("|") if p]
    joiner = "" if re.search("[。？]", marked) else " "
    assert sentences.split_sentences(joiner.join(parts)) == parts


@pytest.mark.parametrize(
    "marked",
    [
        "請求を受け付けました|受取人は家族です|手術費用は払いますが上限があります",
        "支店で手続きができます|来月から新しい商品を販売します",
        "您收到保单了吗|联系网点可以办理变更",
        "客户已经提交了全部资料|如果丢失请重新填写",
        "我们会尽快处理您的申请|请等待通知",
        "他向我们说明为什么需要等待三个月",
        "待機期間は29か月で、事故には適用されません",
    ],
)
def test_lost_marks_between_any_words(marked):
    assert sentences.split_sentences(marked.replace("|", "")) == marked.split("|")


@pytest.mark.parametrize(
    "marked",
    [
        "他昨天来过|老师不在家|所以他走了",
        "今日は天気がいいです|明日は雨が降るでしょう。",
        "Gen. Smith met Capt. Jones.|They left.",
        f"See www.{'x' * 60}.example/p.80 for it.|Nobody did.",
    ],
)
def test_boundaries_in_texts_of_other_fields(marked):
    joiner = "" if "今日" in marked else " "
    assert sentences.split_sentences(marked.replace("|", joiner)) == marked.split("|")


def test_marks_of_a_line_are_weighed_together():
    for parts in (["Zed Pvt. Ltd. pays it.", "Older cards work."], ["It is out.", "Min. 5 members join."], ["The bill went to Zed Ltd.", "Nobody paid it."]):
        assert sentences.split_sentences(" ".join(parts)) == parts
    # cheaper on its own, an end at the first node leaves an abbreviation alone
    assert sentences._cheapest([(5, 0, 2, 0), (9, 2, 0, 4), (20, 0, 9, 0)]) == [20]
    assert sentences._cheapest([(5, 0, 2, 0), (9, 2, 0, 0), (20, 0, 9, 0)]) == [5, 20]


def test_lines_blanks_and_missing_blanks(spark):
    assert sentences.sentence_starts("  One.\n\n \r\nTwo.Three is here. \n") == [2, 11, 15]
    assert sentences.sentence_starts("It ended as well.Fig. 4 and pp. 2-9 show it.") == [0, 17]
    assert sentences.sentence_starts(None) == sentences.sentence_starts("") == sentences.sentence_starts(" \n ") == []
    df = spark.createDataFrame([(1, "A b.\nC d."), (2, None), (3, "  "), (1, "A b.\nC d.")], "doc_id long, text string")
    got = sorted(map(tuple, sentences.sentences(df).collect()))
    assert got == [(1, 0, 0, 4, "A b."), (1, 0, 0, 4, "A b."), (1, 1, 5, 9, "C d."), (1, 1, 5, 9, "C d.")]


# ---------------------------------------------------------------- queries


def test_queries_over_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    wanted = {"p1_found": ["doc_id", "line_no"], "p2_found": ["tbl", "row_id"], "p4_found": ["tbl", "row_id", "kind", "value"], "p5_found": ["record_a", "record_b"], "p6_found": ["doc_id", "line_no"], "p7_found": ["tbl", "row_id", "lang"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "start_pos"]}
    for name, columns in wanted.items():
        assert queries.queries()[name](spark, d).columns == columns
    assert queries.p9_containers(spark, d).groupBy("container").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert queries.p3_percentiles(spark, d).where("rank_error > 0.01").count() == 0

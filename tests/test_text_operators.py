"""Text, quality, cleaning, privacy and normal forms on literal cases."""

import re

from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.operators import clean, normalize, privacy, quality


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_word_count_knows_unicode_blanks(spark):
    assert one(spark, "a b　c  d\x1ce", text.word_count) == len("a b　c  d\x1ce".split()) == 5
    assert one(spark, None, text.word_count) == 0
    assert one(spark, " \n ", text.word_count) == 0


def test_lines_of_every_line_end(spark):
    assert one(spark, "a\r\nb\rc\n\nd\n", text.lines) == ["a", "b", "c", "", "d"]
    assert one(spark, "", text.lines) == []
    assert one(spark, None, text.lines) == []


def test_canonical_and_shingles(spark):
    assert one(spark, "  Größe - B! ", text.canonical) == "gr e   b"
    assert one(spark, "a b c d", text.shingles) == ["a b c d"]
    assert one(spark, "", text.shingles) == []
    assert sorted(one(spark, "a b c d e f a b c d e", text.shingles)) == sorted({"a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"})


def test_sentences_keep_abbreviations(spark):
    assert one(spark, "Pay Rs. 5 now. Dr. A said e.g. this! Yes?", text.sentences) == ["Pay Rs. 5 now.", "Dr. A said e.g. this!", "Yes?"]


def test_host_spellings(spark):
    for url in ("https://www.Site.example/a?b", "site.example:80/x", "HTTP://site.example", "//site.example/#x"):
        assert one(spark, url, text.host) == "site.example"
    assert one(spark, "", text.host) is None


def test_usability_reasons_in_order(spark):
    good = "word " * 200
    assert one(spark, good, quality.usability) is None
    assert one(spark, None, quality.usability) == "empty"
    assert one(spark, "404 error " + good, quality.usability) == "error page: 404 error"
    assert one(spark, "few words", quality.usability) == "only 2 words"
    assert one(spark, "menu\nlogin\n" + good, quality.usability) == "mostly navigation"


def test_answerable(spark):
    assert one(spark, "Cover starts after thirty days and lasts a full year long.", quality.answerable)
    assert not one(spark, "Intro ..... 3\nScope ..... 9", quality.answerable)
    assert not one(spark, "12 34% 56.7 | 8", quality.answerable)
    assert one(spark, "Claims settle within days", quality.answerable)
    assert not one(spark, "a b c", quality.answerable)
    assert not one(spark, "x ISBN y doi: z ISSN w and a few more words here now", quality.answerable)


def test_clean_documents(spark):
    rows = [
        ("web_page", "Home\nPlans\nAbout\nCover explained\nThe plan covers hospital stays of any length.\nthe plan covers hospital stays of any length.\n| a | b |\n© 2024 X", "The plan covers hospital stays of any length.\n| a | b |"),
        ("pdf", "One\nTwo\nThree\nA line that ends here.", "One\nTwo\nThree\nA line that ends here."),
        ("web_page", None, ""),
    ]
    df = spark.createDataFrame([(t, b) for t, b, _ in rows], "source_type string, text string")
    got = clean.clean_documents(df).collect()
    assert [r["clean_text"] for r in got] == [w for _, _, w in rows]
    assert got[0]["lines_in"] == 8 and got[2]["lines_in"] == 0


def test_nav_runs_match_a_loop(spark):
    lines = ["a", "b", "Text ends.", "c", "d", "e", "", "f", "g", "| t |", "h", "i", "j", "k"]

    def loop(lines):
        out, run = [], []
        for x in [*lines, None]:
            if x is not None and x.strip() and not x.startswith("|") and not re.search("[.!?:;]$", x):
                run.append(x)
                continue
            out += run if len(run) < fixed.NAV_RUN else []
            run = []
            if x is not None:
                out.append(x)
        return out

    assert one(spark, "\n".join(lines), lambda c: clean.drop_nav_runs(text.lines(c))) == loop(lines)


def test_repeated_lines_and_trim(spark):
    docs = [(k, f"Shared notice\nown line number {k}\nShared notice") for k in range(3)] + [(3, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    repeated = clean.repeated_lines(df, "doc_id", "text")
    assert [tuple(r) for r in repeated.collect()] == [("Shared notice", 3)]
    got = dict(clean.trim_repeated(df, "doc_id", "text", repeated).collect())
    assert got == {0: "own line number 0", 1: "own line number 1", 2: "own line number 2", 3: "", 4: ""}
    assert dict(clean.trim_repeated(df, "doc_id", "text", repeated, small=0).collect()) == got


def test_privacy(spark):
    cases = [
        ("mail a.b@c.example or +91 98765 43210", "mail [EMAIL_REDACTED] or [PHONE_REDACTED]"),
        ("PAN ABCDE1234F", "PAN [PAN_REDACTED]"),
        ("table 1234 5678 9012 rows", "table 1234 5678 9012 rows"),
        ("Aadhaar is 1234 5678 9012", "Aadhaar is [AADHAAR_REDACTED]"),
        ("call 98765 43210", "call [PHONE_REDACTED]"),
        ("premium 98765 43210", "premium 98765 43210"),
        ("phone" + "x" * 66 + "98765 43210", "phone" + "x" * 66 + "98765 43210"),
        ("Insured: Mr Asha Rao lives here", "Insured: Mr [NAME_REDACTED] lives here"),
        ("Dr Madan Gopal, consultant", "Dr Madan Gopal, consultant"),
    ]
    df = spark.createDataFrame([(a,) for a, _ in cases], "text string")
    assert [r["masked"] for r in privacy.scan(df).select("masked").collect()] == [b for _, b in cases]
    dense = privacy.scan(spark.createDataFrame([("a@b.example c@d.example",), ("word " * 200 + "a@b.example",), (None,)], "text string")).collect()
    assert [r["quarantined"] for r in dense] == [True, False, False]
    assert dense[0]["findings"] == {"EMAIL": 2} and dense[2]["findings"] == {}


def test_normalize(spark):
    cases = [
        (normalize.dates, "on 1/4/25, 15-03-2025, 31/02/2025, 13/13/2025, April 1, 2025, 1 April 2025, 2 Foo 2025", "on 2025-04-01, 2025-03-15, 2025-02-31, 13/13/2025, 2025-04-01, 2025-04-01, 2 Foo 2025"),
        (normalize.currency, "₹5 lakh, 2.3 lakh, Rs. 500, INR 7, ₹ 9, 1 cr", "Rs 500,000 (5 lakh),Rs 229,999 (2.3 lakh), Rs 500, Rs 7, Rs 9,Rs 10,000,000 (1 cr)"),
        (normalize.terms, "Copay and COPAYMENT, co-pay-x, PED, a copay", "Co-payment and CO-PAYMENT, co-pay-x, Pre-existing disease, a co-payment"),
        (normalize.headings, "##  Scope :\ntext:\n#Title", "## Scope\ntext:\n# Title"),
    ]
    for function, given, wanted in cases:
        assert one(spark, given, function) == wanted
        assert one(spark, None, function) is None
    counted = one(spark, "copay, Copay and NCB", normalize.term_counts)
    assert counted == {"copay -> co-payment": 2, "NCB -> no claim bonus": 1}


def test_unicode_fingerprints_and_shingles(spark):
    rows = [("यह योजना Zed 1",), ("वह बीमा Zed 1",), ("保险 Zed 1",), ("Zed 1",)]
    df = spark.createDataFrame(rows, "t string")
    assert df.select(text.fingerprint(F.col("t"))).distinct().count() == 1
    assert df.select(text.fingerprint(F.col("t"), unicode=True)).distinct().count() == 4
    got = [x[0] for x in df.select(text.shingles(F.col("t"), 2, unicode=True)).collect()]
    assert got == [["यह योजना", "योजना zed", "zed 1"], ["वह बीमा", "बीमा zed", "zed 1"], ["保 险", "险 zed", "zed 1"], ["zed 1"]]

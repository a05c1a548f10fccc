"""All queries of the core over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import fixed, text
from millrace.operators import chunk, clean, conversation, dedupe, evaluation, normalize, privacy, quality, records, retrieval, telemetry
from millrace.plans import pipeline, star
from millrace.runtime import materialize, ship, small, table
from millrace.sources import files
from millrace.streaming import signals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# SQL twins of the text functions
_B = text.SPACE
_q = lambda s: "'" + s.replace("'", "''") + "'"
_words = lambda t: f"list_filter(regexp_split_to_array(coalesce({t}, ''), '{_B}'), lambda w: w <> '')"
_strip = lambda t: f"regexp_replace({t}, '^{_B}|{_B}$', '', 'g')"
_plain = lambda t: f"regexp_replace(coalesce({t}, ''), '\\r\\n?', chr(10), 'g')"
_lines = lambda t: f"(CASE WHEN {_plain(t)} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({_plain(t)}, '\\n$', ''), chr(10)) END)"
_canonical = lambda t: f"trim(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '{_B}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'))"
_any = lambda t, phrases: "(" + " OR ".join(f"contains({t}, {_q(p)})" for p in phrases) + ")"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return function(spark, d)

        _QUERIES[function.__name__] = run
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- text and quality


@_query(f"SELECT source, count(*) AS docs, CAST(sum(len({_words('text')})) AS BIGINT) AS words, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents GROUP BY source")
def word_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(text.word_count(F.col("text"))).alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


_OWN = f"SELECT doc_id, unnest(list_distinct(list_filter(list_transform({_lines('text')}, lambda l: {_strip('l')}), lambda l: l <> '' AND len({_words('l')}) <= 12))) AS line FROM documents"
_REPEATED = f"SELECT line, count(*) AS docs FROM ({_OWN}) GROUP BY line HAVING count(*) >= 3"


@_query(_REPEATED)
def repeated_lines(spark, d):
    return clean.repeated_lines(table(spark, d, "documents"), "doc_id", "text")


@_query(
    f"""WITH r AS ({_REPEATED}), l AS (SELECT doc_id, unnest({_lines('text')}) AS line, generate_subscripts({_lines('text')}, 1) AS n FROM documents),
    k AS (SELECT * FROM l WHERE {_strip('line')} NOT IN (SELECT line FROM r)),
    t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM k GROUP BY doc_id)
    SELECT documents.doc_id, sha256(coalesce(t, '')) AS digest FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id"""
)
def trimmed_documents(spark, d):
    documents = table(spark, d, "documents")
    trimmed = clean.trim_repeated(documents, "doc_id", "text", materialize(clean.repeated_lines(documents, "doc_id", "text")))
    return trimmed.select("doc_id", F.sha2("text", 256).alias("digest"))


_NONBLANK = f"list_filter(list_transform({_lines('text')}, lambda l: lower({_strip('l')})), lambda l: l <> '')"
_CHROME = f"list_filter({_NONBLANK}, lambda l: len({_words('l')}) <= 6 AND {_any('l', fixed.CHROME_PHRASES)})"
_RATIO = f"CASE WHEN len({_NONBLANK}) = 0 THEN 1.0 ELSE len({_CHROME}) / len({_NONBLANK}) END"


@_query(f"SELECT doc_id, round(CAST({_RATIO} AS DOUBLE), 6) AS ratio FROM documents")
def chrome_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(quality.chrome_ratio(F.col("text")), 6).alias("ratio"))


_MARKER = f"list_filter([{', '.join(map(_q, fixed.ERROR_MARKERS))}], lambda m: contains(lower(substr(coalesce(text, ''), 1, 2000)), m))[1]"
_REASON = f"""CASE WHEN {_strip("coalesce(text, '')")} = '' THEN 'empty' WHEN {_MARKER} IS NOT NULL THEN 'error page: ' || {_MARKER}
    WHEN len({_words('text')}) < 150 THEN 'only ' || len({_words('text')}) || ' words' WHEN {_RATIO} > 0.5 THEN 'mostly navigation' END"""


@_query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def usability_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.usability(F.col("text")).alias("reason"))


_IS_CHROME = f"""(NOT starts_with({_strip('l')}, '|') AND (regexp_matches({_strip('l')}, {_q('|'.join(f'(?:{p})' for p in fixed.DROP_LINES))})
    OR (len({_words('l')}) <= 5 AND {_any(f"lower({_strip('l')})", fixed.CHROME_PHRASES)})))"""


@_query(f"SELECT doc_id, CAST(len(list_filter({_lines('text')}, lambda l: {_IS_CHROME})) AS INTEGER) AS chrome FROM documents")
def chrome_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(text.lines(F.col("text")), lambda line: clean.is_chrome(line))).alias("chrome"))


@_query(
    f"""WITH l AS (SELECT doc_id, {_lines('text')} AS l FROM documents)
    SELECT doc_id, CAST(len(list_filter(l, lambda x, i: i = 1 OR lower({_strip('x')}) <> lower({_strip('l[i - 1]')}))) AS INTEGER) AS kept FROM l"""
)
def collapse_repeats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(clean.collapse_repeats(text.lines(F.col("text")))).alias("kept"))


@_query(
    f"""WITH l AS (SELECT doc_id, unnest({_lines('text')}) AS l, generate_subscripts({_lines('text')}, 1) AS n FROM documents),
    m AS (SELECT doc_id, n, {_strip('l')} <> '' AND NOT starts_with({_strip('l')}, '|') AND len({_words('l')}) <= 8 AND NOT regexp_matches({_strip('l')}, '[.!?:;]$') AS nav FROM l),
    g AS (SELECT *, sum(CASE WHEN nav THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM m),
    c AS (SELECT *, sum(CASE WHEN nav THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island) AS run FROM g)
    SELECT documents.doc_id, count(CASE WHEN c.doc_id IS NOT NULL AND (NOT nav OR run < 3) THEN 1 END) AS kept FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id GROUP BY documents.doc_id"""
)
def nav_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(clean.drop_nav_runs(text.lines(F.col("text")))).cast("bigint").alias("kept"))


_TIDY = f"{_strip('line_')}".replace("line_", "regexp_replace(line, '[ \t\u00a0]+', ' ', 'g')")


@_query(
    f"""WITH r AS (SELECT doc_id, source_type, unnest({_lines('text')}) AS l, generate_subscripts({_lines('text')}, 1) AS n FROM documents),
    c AS (SELECT *, lag(lower({_strip('l')})) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM r WHERE NOT {_IS_CHROME}),
    k AS (SELECT * FROM c WHERE before IS NULL OR before <> lower({_strip('l')})),
    m AS (SELECT *, {_strip('l')} <> '' AND NOT starts_with({_strip('l')}, '|') AND len({_words('l')}) <= 8 AND NOT regexp_matches({_strip('l')}, '[.!?:;]$') AS nav FROM k),
    g AS (SELECT *, sum(CASE WHEN nav THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM m),
    i AS (SELECT *, l AS line, sum(CASE WHEN nav THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island) AS run FROM g),
    s AS (SELECT doc_id, count(*) AS lines_out, string_agg({_TIDY}, chr(10) ORDER BY n) AS t FROM i WHERE coalesce(source_type, '') <> 'web_page' OR NOT nav OR run < 3 GROUP BY doc_id)
    SELECT d.doc_id, d.source_type, {_strip("regexp_replace(coalesce(t, ''), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean_text,
    CAST(len({_lines('text')}) AS INTEGER) AS lines_in, CAST(coalesce(lines_out, 0) AS INTEGER) AS lines_out FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""
)
def clean_documents(spark, d):
    return clean.clean_documents(table(spark, d, "documents").select("doc_id", "text", "source_type")).drop("text")


_N = "length(b) - length(regexp_replace(b, '[0-9%.,:;|/()\\[\\]-]', '', 'g'))"


@_query(
    f"""WITH r AS (SELECT record_id, {_strip("coalesce(content, '')")} AS b, len({_words('content')}) AS n FROM records WHERE kind = 'prose'),
    c AS (SELECT *, len(regexp_extract_all(b, {_q(fixed.CITATION)})) AS marks FROM r)
    SELECT record_id, CASE WHEN b = '' THEN false WHEN len(regexp_extract_all(b, '\\.{{4,}}')) >= 2 THEN false WHEN marks >= 3 AND marks / greatest(n, 1) > 0.02 THEN false
    WHEN n >= 10 THEN true WHEN ({_N}) / length(b) > 0.4 THEN false ELSE len(list_filter({_words('b')}, lambda w: length(w) >= 4 AND regexp_matches(w, '^\\p{{L}}+$'))) >= 3 END AS answerable FROM c"""
)
def answerability(spark, d):
    return table(spark, d, "records").where("kind = 'prose'").select("record_id", quality.answerable(F.col("content")).alias("answerable"))


_GUARD = rf"regexp_replace(coalesce(content, ''), '\b({'|'.join(a.replace('.', chr(92) + '.') for a in fixed.ABBREVIATIONS)})\.', '\1' || chr(1), 'g')"


@_query(rf"SELECT record_id, CAST(len(list_filter(string_split(regexp_replace({_GUARD}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: trim(s) <> '')) AS INTEGER) AS sentences FROM records")
def sentence_split(spark, d):
    return table(spark, d, "records").select("record_id", F.size(text.sentences(F.coalesce("content", F.lit("")))).alias("sentences"))


@_query("SELECT doc_id, regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://|//)?(?:www\\.)?([^/:?#]+)', 1) AS host FROM documents")
def hosts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.host(F.col("url")).alias("host"))


# ---------------------------------------------------------------- duplicates and statements


@_query(
    f"""WITH m AS (SELECT doc_id AS id, sha256({_canonical('text')}) AS p, length(coalesce(text, '')) AS n FROM documents),
    f AS (SELECT *, first_value(id) OVER (PARTITION BY p ORDER BY n DESC, id) AS kept FROM m)
    SELECT kept, id AS dropped FROM f WHERE id <> kept"""
)
def exact_duplicates(spark, d):
    return dedupe.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@_query(
    f"""WITH m AS (SELECT record_id AS id, string_split({_canonical('content')}, ' ') AS raw, sha256({_canonical('content')}) AS p, length(coalesce(content, '')) AS n FROM records),
    o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, id) AS k, list_filter(raw, lambda w: w <> '') AS w FROM m),
    s AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM o WHERE k = 1),
    c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, CAST(shared AS INTEGER) AS shared, CAST(u.n + v.n - shared AS INTEGER) AS either FROM p JOIN c u ON u.id = a JOIN c v ON v.id = b WHERE shared * 20 >= (u.n + v.n - shared) * 17"""
)
def shingle_pairs(spark, d):
    rows = table(spark, d, "records").select("record_id", "content")
    gone = dedupe.exact_duplicates(rows, "record_id", "content").select(F.col("dropped").alias("record_id"))
    return dedupe.similar_pairs(materialize(rows.join(gone, "record_id", "left_anti")), "record_id", "content")


@_query()
def near_duplicates(spark, d):
    return dedupe.near_duplicates(table(spark, d, "records").select("record_id", "content"), "record_id", "content")


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id AS id, {_q(topic)} AS topic, unnest(regexp_extract_all(text, {_q(p)}, 1)) AS n, unnest(regexp_extract_all(text, {_q(p)}, 2)) AS u FROM documents" for topic, p in fixed.TOPICS.items()
)


@_query(
    f"""WITH f AS (SELECT DISTINCT id, topic, trim(replace(n, ',', '') || ' ' || CASE WHEN u <> '' THEN lower(u) || 's' ELSE '' END) AS value FROM ({_FOUND})),
    c AS (SELECT topic, value, count(*) AS documents FROM f GROUP BY ALL)
    SELECT * FROM c WHERE topic IN (SELECT topic FROM c GROUP BY topic HAVING count(*) > 1)"""
)
def contradictions(spark, d):
    return dedupe.contradictions(table(spark, d, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- personal data and normal forms

_MASKED, _COUNTS = "coalesce(content, '')", []
for _kind, _pattern in fixed.SHAPES:
    _COUNTS.append(f"len(regexp_extract_all({_MASKED}, {_q(_pattern)}))")
    _MASKED = f"regexp_replace({_MASKED}, {_q(_pattern)}, '[{_kind}_REDACTED]', 'g')"


@_query(f"SELECT record_id, sha256({_MASKED}) AS digest, CAST({' + '.join(_COUNTS)} AS INTEGER) AS found FROM records")
def pii_shapes(spark, d):
    rows = table(spark, d, "records").select("record_id", F.coalesce("content", F.lit("")).alias("content"))
    scanned = privacy.scan(rows, "content", privacy.passes(cued=())[:-1])
    return scanned.select("record_id", F.sha2("masked", 256).alias("digest"), "found")


@_query()
def pii_scan(spark, d):
    return privacy.scan(table(spark, d, "records").select("record_id", "content"), "content").select("record_id", "masked", "findings", "found", "quarantined")


@_query("SELECT t AS kind, count(*) AS records FROM (SELECT unnest(pii_types) AS t FROM records) GROUP BY t")
def pii_kinds(spark, d):
    return table(spark, d, "records").select(F.explode("pii_types").alias("kind")).groupBy("kind").agg(F.count("*").alias("records"))


@_query()
def normalized_records(spark, d):
    return table(spark, d, "records").select("record_id", normalize.normalize(F.col("content")).alias("content"))


# every sign around words is doubled, so that one can be spent on each side of a match
_SPREAD = r"' ' || regexp_replace(coalesce(content, ''), '([^\w-])', '\1\1', 'g') || ' '"
_CHANGES = " UNION ALL ".join(
    f"SELECT {_q(f'{variant} -> {term}')} AS change, len(regexp_extract_all(b, {_q(r'(?i)[^\w-]' + variant.replace(' ', '  ') + r'[^\w-]')})) AS n FROM s" for term, variants in fixed.TERMS.items() for variant in variants
)


@_query(f"WITH s AS (SELECT {_SPREAD} AS b FROM records), c AS ({_CHANGES}) SELECT change, CAST(sum(n) AS BIGINT) AS times FROM c GROUP BY change HAVING sum(n) > 0")
def term_changes(spark, d):
    counted = table(spark, d, "records").select(F.explode(normalize.term_counts(F.coalesce("content", F.lit("")))).alias("change", "n"))
    return counted.groupBy("change").agg(F.sum("n").alias("times"))


# ---------------------------------------------------------------- chunks and records


@_query()
def chunk_documents(spark, d):
    return chunk.chunk_documents(table(spark, d, "documents"))


def _score(name: str, words: tuple[str, ...]) -> str:
    hits = lambda where: f"len(list_filter([{', '.join(map(_q, words))}], lambda w: contains({where}, w)))"
    return f"3 * {hits('h')} + {hits('b')} + CASE WHEN hint = '{name}' THEN 2 ELSE 0 END"


@_query(
    f"""WITH r AS (SELECT record_id, lower(coalesce(section_path, '')) AS h, lower(substr(coalesce(content, ''), 1, 600)) AS b, coalesce(category, '') AS hint FROM records),
    s AS (SELECT record_id, hint, [{', '.join(_score(n, w) for n, w in fixed.CATEGORIES.items())}] AS s, [{', '.join(map(_q, fixed.CATEGORIES))}] AS names FROM r),
    m AS (SELECT *, list_max(s) AS best FROM s), w AS (SELECT *, list_filter(names, lambda n, i: s[i] = best) AS winners FROM m)
    SELECT record_id, CASE WHEN best = 0 AND NOT list_contains(names, hint) THEN 'product' WHEN best = 0 OR list_contains(winners, hint) THEN hint ELSE winners[1] END AS category FROM w"""
)
def categories(spark, d):
    return table(spark, d, "records").select("record_id", records.category(F.col("section_path"), F.col("content"), F.col("category")).alias("category"))


@_query("SELECT record_id, substr(sha256(content), 1, 16) AS checksum, coalesce(substr(sha256(content), 1, 16) <> checksum, true) AS stale FROM records")
def stale_checksums(spark, d):
    now = text.checksum(F.col("content"))
    return table(spark, d, "records").select("record_id", now.alias("checksum"), F.coalesce(now != F.col("checksum"), F.lit(True)).alias("stale"))


@_query(
    f"""SELECT count(*) AS records, count(DISTINCT doc_id) AS documents, count(CASE WHEN kind = 'table' THEN 1 END) AS tables, count(CASE WHEN pii THEN 1 END) AS pii_records,
    CAST(sum(len({_words('content')})) AS BIGINT) AS words FROM records"""
)
def build_stats(spark, d):
    return records.build_stats(table(spark, d, "records"))


@_query(
    f"""WITH w AS (SELECT kind, len({_words('content')}) AS v FROM records WHERE content IS NOT NULL)
    SELECT kind, list_sort(list(v))[CAST(floor(count(v) / 2) AS BIGINT) + 1] AS upper_median, min(v) AS least, max(v) AS most, count(*) AS records FROM w GROUP BY kind"""
)
def median_words(spark, d):
    """The value at place n // 2 of the sorted word counts: a floor of one half of n places, n - 1 of which lie before the last."""
    counted = table(spark, d, "records").where("content IS NOT NULL").select("kind", text.word_count(F.col("content")).alias("v"))
    found = telemetry.percentiles(counted, ["kind"], "v", {"upper_median": 0.5}, upper=True)
    return found.select("kind", "upper_median", F.col("min").alias("least"), F.col("max").alias("most"), F.col("samples").alias("records"))


@_query("SELECT lower(trim(title)) AS title, count(*) AS records, count(DISTINCT doc_id) AS documents FROM records WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1")
def repeated_titles(spark, d):
    return records.repeated_titles(table(spark, d, "records"))


@_query(
    f"""WITH r AS (SELECT record_id, doc_id, ordinal, list_distinct(list_filter(string_split({_canonical('content')}, ' '), lambda w: w <> '')) AS w FROM records WHERE doc_id IS NOT NULL)
    SELECT a.record_id, b.record_id AS next_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) END AS jaccard
    FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.ordinal = a.ordinal + 1"""
)
def neighbour_overlap(spark, d):
    """Share of words that a record has in common with the record after it in its document."""
    rows = table(spark, d, "records").where("doc_id IS NOT NULL").select("record_id", "doc_id", "ordinal", text.shingles(F.col("content"), 1).alias("w"))
    after = rows.select(F.col("record_id").alias("next_id"), "doc_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("w").alias("v"))
    return rows.join(after, ["doc_id", "ordinal"]).select("record_id", "next_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@_query("SELECT category, kind, count(*) AS records FROM records GROUP BY ALL")
def category_counts(spark, d):
    return table(spark, d, "records").groupBy("category", "kind").agg(F.count("*").alias("records"))


@_query()
def corpus_build(spark, d):
    stay, _ = pipeline.collect(table(spark, d, "documents"))
    return pipeline.build(stay)


@_query("SELECT CAST(0 AS BIGINT) AS differing, true AS some_flagged")
def corpus_flags_kept(spark, d):
    """Records of the build whose flags are not those of their document; there must be none."""
    stay, _ = pipeline.collect(table(spark, d, "documents"))
    flags = stay.select("doc_id", F.col("pii_types").alias("masked"))
    joined = pipeline.build(stay).join(flags, "doc_id")
    differs = ~F.col("pii_types").eqNullSafe(F.col("masked")) | (F.col("pii") != (F.size("masked") > 0))
    return joined.agg(F.count_if(differs).alias("differing"), (F.count_if("pii") > 0).alias("some_flagged"))


@_query()
def corpus_left_out(spark, d):
    return pipeline.collect(table(spark, d, "documents"))[1]


@_query("SELECT s.category, s.source, count(d.doc_id) AS docs FROM sources s LEFT JOIN documents d ON d.source = s.source GROUP BY ALL")
def source_coverage(spark, d):
    sources, documents = table(spark, d, "sources").select("source", "category"), table(spark, d, "documents").groupBy("source").agg(F.count("doc_id").alias("docs"))
    return sources.join(documents, "source", "left").select("category", "source", F.coalesce("docs", F.lit(0)).alias("docs"))


@_query("SELECT lower(coalesce(string_split(lang, '-')[1], '')) AS label, count(*) AS docs FROM documents GROUP BY 1")
def language_labels(spark, d):
    return table(spark, d, "documents").groupBy(F.lower(F.coalesce(F.split("lang", "-")[0], F.lit(""))).alias("label")).agg(F.count("*").alias("docs"))


_LEAD = ["name", "phone", "email", "city"]


@_query(f"SELECT lead_id, concat_ws('; ', {', '.join(f'''CASE WHEN trim({c}) <> '' THEN '{c}: ' || trim({c}) END''' for c in _LEAD)}) AS line FROM sample_leads")
def labelled_leads(spark, d):
    return table(spark, d, "sample_leads").select("lead_id", files.labelled(_LEAD).alias("line"))


# ---------------------------------------------------------------- retrieval

_PAIRS = """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


def _dense(spark, d, k):
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_top_k(vectors, queries, k)


@_query(f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p)
    SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")  # fmt: skip
def dense_top_k(spark, d):
    return _dense(spark, d, 10).withColumn("similarity", F.round("similarity", 6))


_BM25 = """WITH q AS (SELECT sample_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1)[1:24])) AS term FROM lang_samples WHERE sample_id % 50 = 0),
    t AS (SELECT record_id AS id, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+') AS w FROM records),
    c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), u AS (SELECT id, len(w) AS size, unnest(w) AS term FROM t),
    f AS (SELECT term, id, size, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), x AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    s AS (SELECT query_id, f.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
          FROM f JOIN x ON x.term = f.term JOIN q ON q.term = f.term, c GROUP BY 1, 2),
    lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""


@_query(f"{_BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM lexical WHERE rank <= 25")
def bm25_top_k(spark, d):
    queries = table(spark, d, "lang_samples").where("sample_id % 50 = 0").select(F.col("sample_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "records").select(F.col("record_id").alias("id"), F.col("content").alias("body"))
    return retrieval.bm25_top_k(docs, queries).withColumn("score", F.round("score", 6))


@_query(
    f"""{_PAIRS}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vl = ql DESC, id) AS rank FROM p),
    f AS (SELECT query_id, id, rank FROM a WHERE rank <= 25 UNION ALL SELECT query_id, id, rank FROM b WHERE rank <= 25)
    SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM f GROUP BY 1, 2"""
)
def rank_fusion(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("ql"))
    order = W.partitionBy("query_id").orderBy(F.desc("same"), "id")
    same = vectors.crossJoin(small(queries)).withColumn("same", F.col("label") == F.col("ql"))  # the stated queries against all rows
    labelled = same.withColumn("rank", F.row_number().over(order)).where("rank <= 25")
    return retrieval.fuse(_dense(spark, d, 25), labelled).withColumn("fused", F.round("fused", 9))


def _search(spark, d, abstained=False):
    """Hits of the queries of the documents' titles; every second query asks for its own category."""
    rows = table(spark, d, "records").select(F.col("doc_id").alias("id"), "source_type", "category").groupBy("id").agg(F.max((F.col("source_type") == "internal_document").cast("int")).alias("a"), F.min("category").alias("category"))
    facts = materialize(rows.select("id", (F.col("a") == 1).alias("authoritative"), "category"))
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "title", "text").alias("body"))
    asked = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    own = facts.select(F.col("id").alias("query_id"), "category").where("query_id % 100 = 0")
    queries = materialize(asked.join(own, "query_id", "left"))
    dense = _dense(spark, d, fixed.DENSE_CANDIDATES)
    return retrieval.hybrid(dense, retrieval.bm25_top_k(titles, queries), facts, queries, abstained=abstained), queries


_HYBRID = f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p),
    q AS (SELECT doc_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 1)[1:24])) AS term FROM documents WHERE doc_id % 50 = 0),
    t AS (SELECT doc_id AS id, regexp_extract_all(lower(concat_ws(' ', title, text)), '[a-z0-9]+') AS w FROM documents),
    c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), u AS (SELECT id, len(w) AS size, unnest(w) AS term FROM t),
    tf AS (SELECT term, id, size, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), x AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    s AS (SELECT query_id, tf.id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score
          FROM tf JOIN x ON x.term = tf.term JOIN q ON q.term = tf.term, c GROUP BY 1, 2),
    lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s),
    facts AS (SELECT doc_id AS id, coalesce(bool_or(source_type = 'internal_document'), false) AS authoritative, min(category) AS category FROM records GROUP BY 1),
    asked AS (SELECT doc_id AS query_id, title AS query, CASE WHEN doc_id % 100 = 0 THEN category END AS wanted FROM documents LEFT JOIN facts ON facts.id = doc_id WHERE doc_id % 50 = 0),
    own AS (SELECT d.query_id, d.id, similarity, authoritative, row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank) AS rank
            FROM dense d JOIN facts USING (id) JOIN asked USING (query_id) WHERE d.rank <= {fixed.DENSE_CANDIDATES} AND (wanted IS NULL OR category = wanted)),
    words AS (SELECT l.query_id, l.id, authoritative, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank
            FROM lexical l JOIN facts USING (id) JOIN asked USING (query_id) WHERE l.rank <= 25 AND (wanted IS NULL OR category = wanted)),
    ranked AS (SELECT query_id, id, authoritative, row_number() OVER (PARTITION BY query_id, authoritative ORDER BY rank) AS rank FROM own WHERE authoritative OR rank <= 25
            UNION ALL SELECT query_id, id, authoritative, row_number() OVER (PARTITION BY query_id, authoritative ORDER BY rank) FROM words),
    fused AS (SELECT query_id, id, authoritative, sum(1.0::DOUBLE / (60 + rank)) AS fused FROM ranked GROUP BY ALL),
    placed AS (SELECT f.*, coalesce(o.similarity, 0) AS similarity, row_number() OVER (PARTITION BY f.query_id, f.authoritative ORDER BY coalesce(o.similarity, 0) DESC, f.id) AS place
            FROM fused f LEFT JOIN own o ON o.query_id = f.query_id AND o.id = f.id),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY authoritative DESC, CASE WHEN authoritative THEN similarity ELSE round(fused, 12) END DESC, id) AS position
            FROM placed WHERE NOT authoritative OR (similarity >= {fixed.MIN_SIMILARITY - fixed.AUTHORITY_MARGIN} AND place <= {fixed.RESERVED_SLOTS})),
    hits AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS confidence FROM ordered WHERE position <= {fixed.TOP_K})"""


@_query(
    f"""{_HYBRID} SELECT query_id, id, round(similarity, 6) AS similarity, round(fused, 9) AS fused, authoritative AS reserved, CAST(position AS INTEGER) AS position, round(confidence, 6) AS confidence
    FROM hits WHERE confidence >= {fixed.MIN_SIMILARITY}"""
)
def hybrid_search(spark, d):
    hits, _ = _search(spark, d)
    return hits.withColumns({"similarity": F.round("similarity", 6), "confidence": F.round("confidence", 6), "fused": F.round("fused", 9)})


@_query(
    f"""{_HYBRID}, b AS (SELECT query_id, max(similarity) AS best FROM hits GROUP BY 1),
    r AS (SELECT query_id, best, CASE WHEN trim(coalesce(query, '')) = '' THEN 'empty query' WHEN best IS NULL THEN 'no candidates' WHEN best < {fixed.MIN_SIMILARITY} THEN 'below threshold' END AS reason FROM asked LEFT JOIN b USING (query_id))
    SELECT query_id, round(coalesce(best, 0), 6) AS confidence, reason IS NOT NULL AS abstained, reason FROM r"""
)
def search_answers(spark, d):
    hits, queries = _search(spark, d, abstained=True)
    return retrieval.abstention(hits, queries).withColumn("confidence", F.round("confidence", 6))


@_query(
    f"""{_HYBRID}, n AS (SELECT query_id, lower(string_split(query, ' ')[1]) AS needle FROM asked),
    h AS (SELECT query_id, position, lower(coalesce(title, '')) AS t FROM hits JOIN documents ON doc_id = hits.id WHERE confidence >= {fixed.MIN_SIMILARITY}),
    v AS (SELECT query_id, CASE WHEN needle IS NULL AND bool_or(t IS NOT NULL) THEN 'incorrect' WHEN needle IS NULL THEN 'correct' WHEN count(t) = 0 THEN 'incorrect'
          WHEN bool_or(position = 1 AND contains(t, needle)) THEN 'correct' WHEN contains(string_agg(t, ' ' ORDER BY position), needle) THEN 'partially correct' ELSE 'incorrect' END AS verdict
          FROM n LEFT JOIN h USING (query_id) GROUP BY query_id, needle)
    SELECT verdict, count(*) AS queries FROM v GROUP BY 1"""
)
def retrieval_verdicts(spark, d):
    """A title's first word should stand in the titles of its hits; queries without a title should abstain."""
    hits, queries = _search(spark, d)
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"))
    found = hits.join(titles, "id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]).alias("hits"))
    judged = queries.join(found, "query_id", "left").select(
        retrieval.verdict(F.col("query").isNull(), F.col("hits").isNull(), F.coalesce("hits", F.array().cast("array<string>")), F.array(F.get(F.split("query", " "), F.lit(0)))).alias("verdict")
    )
    return judged.groupBy("verdict").agg(F.count("*").alias("queries"))


@_query(
    f"""{_HYBRID} SELECT query_id, string_agg(hits.id || ':' || coalesce(title, '') || ':' || printf('%.3f', similarity), '|' ORDER BY position) AS citations
    FROM hits JOIN documents ON doc_id = hits.id WHERE confidence >= {fixed.MIN_SIMILARITY} AND position <= 4 GROUP BY query_id"""
)
def search_citations(spark, d):
    hits, _ = _search(spark, d)
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", F.col("url").alias("source_url"))
    line = lambda c: F.concat_ws(":", c["record_id"].cast("string"), F.coalesce(c["title"], F.lit("")), F.format_string("%.3f", c["similarity"]))
    return retrieval.citations(hits, facts).select("query_id", F.array_join(F.transform("citations", line), "|").alias("citations"))


@_query(
    f"""{_PAIRS}, b AS (SELECT query_id, max(similarity) AS score, arg_max(vl = ql, (similarity, -id)) AS in_scope FROM p WHERE id <> query_id GROUP BY query_id),
    t AS (SELECT unnest(range(40, 85, 2)) AS pct)
    SELECT pct / 100 AS threshold, count(CASE WHEN in_scope AND score < pct / 100 THEN 1 END) AS false_refusals, count(CASE WHEN NOT in_scope AND score >= pct / 100 THEN 1 END) AS false_answers,
    count(CASE WHEN in_scope AND score < pct / 100 THEN 1 END) + count(CASE WHEN NOT in_scope AND score >= pct / 100 THEN 1 END) AS errors FROM b, t GROUP BY pct"""
)
def threshold_sweep(spark, d):
    return retrieval.threshold_sweep(_scored(spark, d))


def _scored(spark, d):
    """Best similarity of each query to another row, and whether that row has the query's label."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    best = _dense(spark, d, 2).where("id <> query_id")
    best = best.groupBy("query_id").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b")).select("query_id", F.col("b.id").alias("id"), F.col("b.similarity").alias("score"))
    joined = best.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "id", "label": "vl"}), "id")
    return joined.select("score", (F.col("ql") == F.col("vl")).alias("in_scope"))


_SWEEP = f"""{_PAIRS}, b AS (SELECT query_id, max(similarity) AS score, arg_max(vl = ql, (similarity, -id)) AS in_scope FROM p WHERE id <> query_id GROUP BY query_id)"""


@_query(
    f"""{_SWEEP}, t AS (SELECT unnest(range(40, 85, 2)) AS pct),
    w AS (SELECT pct / 100 AS threshold, count(CASE WHEN in_scope AND score < pct / 100 THEN 1 END) AS false_refusals, count(CASE WHEN NOT in_scope AND score >= pct / 100 THEN 1 END) AS false_answers FROM b, t GROUP BY pct)
    SELECT threshold, false_refusals, false_answers, false_refusals + false_answers AS errors FROM w ORDER BY errors, threshold LIMIT 1"""
)
def best_threshold(spark, d):
    return retrieval.best_threshold(retrieval.threshold_sweep(_scored(spark, d)))


@_query(
    f"""{_SWEEP} SELECT round(min(CASE WHEN in_scope THEN score END), 6) AS in_least, round(max(CASE WHEN NOT in_scope THEN score END), 6) AS out_most,
    min(CASE WHEN in_scope THEN score END) > max(CASE WHEN NOT in_scope THEN score END) AS separable FROM b"""
)
def separability(spark, d):
    return retrieval.separability(_scored(spark, d)).withColumns({"in_least": F.round("in_least", 6), "out_most": F.round("out_most", 6)})


_AT = lambda f: f"list_sort(list(score))[CAST(floor({f} * (count(score) - 1)) AS BIGINT) + 1]"


@_query(
    f"""{_PAIRS}, b AS (SELECT ql AS label, round(max(similarity), 6) AS score FROM p WHERE id <> query_id GROUP BY query_id, ql)
    SELECT label, {_AT(0.1)} AS p10, {_AT(0.5)} AS median, {_AT(0.9)} AS p90, min(score) AS min, max(score) AS max, count(*) AS samples FROM b GROUP BY label"""
)
def score_distribution(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    best = _dense(spark, d, 2).where("id <> query_id").groupBy("query_id").agg(F.round(F.max("similarity"), 6).alias("score"))
    return evaluation.distribution(best.join(labels, "query_id"), "label", "score")


# ---------------------------------------------------------------- telemetry and conversations


@_query(
    """WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, cumulative FROM traces ORDER BY trace_id),
    e AS (SELECT trace_id, unnest(map_entries(cumulative)) AS e FROM t),
    s AS (SELECT trace_id, e.key AS stage, e.value - coalesce(lag(e.value) OVER (PARTITION BY trace_id ORDER BY e.value, e.key), 0) AS ms FROM e)
    SELECT trace_id, stage, round(ms, 2) AS ms FROM s"""
)
def stage_durations(spark, d):
    return telemetry.stage_durations(table(spark, d, "traces").select("trace_id", "cumulative").dropDuplicates(["trace_id"]), "trace_id", "cumulative")


_RANK = lambda f: f"list_sort(list(ms))[CAST(round_even({f} * (count(ms) - 1), 0) AS BIGINT) + 1]"


@_query(
    f"""WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, stages FROM traces ORDER BY trace_id), e AS (SELECT unnest(map_entries(stages)) AS e FROM t), s AS (SELECT e.key AS stage, e.value AS ms FROM e WHERE e.value IS NOT NULL)
    SELECT stage, {_RANK(0.5)} AS p50, {_RANK(0.95)} AS p95, min(ms) AS min, max(ms) AS max, count(*) AS samples FROM s GROUP BY stage"""
)
def latency_summary(spark, d):
    return telemetry.latency_summary(table(spark, d, "traces").select("trace_id", "stages").dropDuplicates(["trace_id"]))


@_query(
    f"""WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, asr_provider, total_ms AS ms FROM traces ORDER BY trace_id)
    SELECT asr_provider, {_RANK(0.5)} AS p50, {_RANK(0.95)} AS p95, min(ms) AS min, max(ms) AS max, count(*) AS samples FROM t WHERE ms IS NOT NULL GROUP BY asr_provider"""
)
def provider_latency(spark, d):
    once = table(spark, d, "traces").select("trace_id", "asr_provider", "total_ms").dropDuplicates(["trace_id"])
    return telemetry.percentiles(once, ["asr_provider"], "total_ms", {"p50": 0.5, "p95": 0.95})


_LIVE = ", ".join(map(_q, fixed.LIVE_STAGES))


@_query(
    f"""WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, asr_provider, stages FROM traces ORDER BY trace_id),
    e AS (SELECT trace_id, asr_provider, unnest(map_entries(stages)) AS e FROM t),
    l AS (SELECT trace_id, asr_provider, round(sum(e.value), 6) AS ms FROM e WHERE e.key IN ({_LIVE}) AND e.value IS NOT NULL GROUP BY 1, 2)
    SELECT asr_provider, {_RANK(0.5)} AS p50, {_RANK(0.95)} AS p95, min(ms) AS min, max(ms) AS max, count(*) AS samples FROM l GROUP BY 1"""
)
def live_latency(spark, d):
    """Time of a turn without the stages of the test harness."""
    once = table(spark, d, "traces").select("trace_id", "asr_provider", "stages").dropDuplicates(["trace_id"])
    return telemetry.percentiles(telemetry.live(once), ["asr_provider"], "ms", {"p50": 0.5, "p95": 0.95})


_TURNS = "t AS (SELECT DISTINCT ON (turn_id) * FROM call_turns ORDER BY turn_id)"


def _once(spark, d):
    return conversation.once(table(spark, d, "call_turns"))


@_query(
    f"""WITH {_TURNS}, m AS (SELECT turn_id, list_filter([caller, agent], lambda c: c IS NOT NULL AND c <> '') AS m, call_id, turn_index FROM t),
    h AS (SELECT turn_id, flatten(list(m) OVER (PARTITION BY call_id ORDER BY turn_index, turn_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS h FROM m)
    SELECT turn_id, CAST(coalesce(len(h), 0) AS INTEGER) AS messages, sha256(coalesce(array_to_string(h, chr(10)), '')) AS digest FROM h"""
)
def conversation_history(spark, d):
    past = conversation.history(_once(spark, d))
    return past.select("turn_id", F.size("history").alias("messages"), F.sha2(F.array_join(F.transform("history", lambda m: m["content"]), "\n"), 256).alias("digest"))


@_query(
    f"""WITH {_TURNS}, f AS (SELECT call_id, intent AS value, min((turn_index, turn_id)) AS f FROM t WHERE intent IS NOT NULL GROUP BY 1, 2)
    SELECT call_id, value, f[1] AS turn_index, CAST(row_number() OVER (PARTITION BY call_id ORDER BY f, value) AS INTEGER) AS position FROM f"""
)
def first_seen_intents(spark, d):
    return conversation.first_seen(_once(spark, d), "intent")


@_query(
    f"""WITH {_TURNS}, r AS (SELECT call_id, turn_index, trim(lang) AS value FROM t WHERE lang IS NOT NULL AND lower(trim(lang)) NOT IN ('', 'null', 'unknown')),
    f AS (SELECT call_id, arg_min(value, (turn_index, value)) AS first, list_sort(list(DISTINCT (turn_index, value))) AS all_ FROM r GROUP BY call_id)
    SELECT call_id, 'lang' AS slot, first AS value, array_to_string(list_transform(list_filter(all_, lambda x: lower(x[2]) <> lower(first)), lambda x: x[2]), ',') AS conflicts FROM f"""
)
def merged_slots(spark, d):
    stated = _once(spark, d).select("call_id", "turn_index", F.lit("lang").alias("slot"), F.col("lang").alias("value"))
    return conversation.merge_slots(stated).withColumn("conflicts", F.array_join("conflicts", ","))


@_query(
    f"""WITH {_TURNS}, e AS (SELECT call_id, turn_index, turn_id, unnest(conflicts) AS c, generate_subscripts(conflicts, 1) AS n FROM t),
    o AS (SELECT call_id, c, min((turn_index, turn_id, n)) AS pos FROM e GROUP BY 1, 2)
    SELECT call_id, string_agg(c, '|' ORDER BY pos) AS conflicts FROM o GROUP BY call_id"""
)
def conflict_lists(spark, d):
    return conversation.conflict_list(_once(spark, d)).select("call_id", F.array_join("conflicts", "|").alias("conflicts"))


@_query(
    f"""WITH {_TURNS} SELECT call_id, count(*) AS turns, count(CASE WHEN abstained THEN 1 END) AS abstained, count(CASE WHEN len(conflicts) > 0 THEN 1 END) AS with_conflicts, count(DISTINCT intent) AS intents,
    count(CASE WHEN answer_source = 'insufficient_context' THEN 1 END) AS insufficient, round(avg(confidence), 6) AS mean_confidence FROM t GROUP BY call_id"""
)
def call_report(spark, d):
    return conversation.call_report(_once(spark, d))


_UNIT = r"(?i)\b\d[\d,.]*\s*(?:months?|days?|years?|%|percent|lakhs?|crores?)"
_MONEY = r"(?i)\b(?:rs\.?|inr|rupees)\s*\d[\d,.]*"


@_query(
    rf"""WITH t AS (SELECT DISTINCT ON (turn_id) * FROM call_turns ORDER BY turn_id),
    h AS (SELECT turn_id, regexp_replace(lower(coalesce(caller, '')), '[,\s]+', ' ', 'g') AS hay,
      list_concat(list_transform(regexp_extract_all(coalesce(agent, ''), {_q(_UNIT + "(?:[^a-z]|$)")}), lambda x: regexp_extract(x, {_q(_UNIT)})), regexp_extract_all(coalesce(agent, ''), {_q(_MONEY)})) AS w FROM t),
    e AS (SELECT turn_id, hay, trim(unnest(w)) AS w, generate_subscripts(w, 1) AS n FROM h),
    b AS (SELECT *, regexp_extract(w, '\d[\d,.]*') AS number, rtrim(replace(regexp_extract(w, '\d[\d,.]*'), ',', ''), '.') AS bare FROM e),
    s AS (SELECT *, replace(number, ',', ' ') AS spaced, CASE WHEN regexp_matches(bare, '^\d{{1,18}}$') THEN replace(format('{{:,}}', TRY_CAST(bare AS BIGINT)), ',', ' ') ELSE bare END AS grouped FROM b)
    SELECT turn_id, string_agg(w, '|' ORDER BY n) AS figures FROM s WHERE NOT (contains(hay, bare) OR contains(hay, spaced) OR contains(hay, grouped)) GROUP BY turn_id"""
)
def figure_grounding(spark, d):
    none = F.array().cast("array<string>")
    found = _once(spark, d).select("turn_id", conversation.unsupported_figures(F.col("agent"), F.col("caller"), none).alias("figures")).where(F.size("figures") > 0)
    return found.withColumn("figures", F.array_join("figures", "|"))


@_query()
def transcript_error(spark, d):
    compared = _once(spark, d).select("call_id", evaluation.compare(F.col("caller"), F.col("agent")).alias("c"), evaluation.exact_match(F.col("caller"), F.col("agent")).alias("same"))
    return compared.groupBy("call_id").agg(F.round(F.avg("c.wer"), 6).alias("wer"), F.sum(F.size("c.differences")).alias("differences"), F.count_if("same").alias("exact"))


# ---------------------------------------------------------------- events


@_query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    return signals.window_counts(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@_query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark, d):
    return signals.sessions(table(spark, d, "events"))


@_query(
    """WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
    SELECT event_id, user_id, event_type FROM g WHERE before IS NULL OR ts >= before + INTERVAL '600 seconds'"""
)
def event_quiet_gap(spark, d):
    return signals.quiet_gap(table(spark, d, "events"), ["user_id", "event_type"], 600).select("event_id", "user_id", "event_type")


@_query(
    """WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_type, event_id, n, ts AS last, true AS passed FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.event_type, o.event_id, o.n, CASE WHEN o.ts >= r.last + INTERVAL '600 seconds' THEN o.ts ELSE r.last END, o.ts >= r.last + INTERVAL '600 seconds'
      FROM r JOIN o ON o.user_id IS NOT DISTINCT FROM r.user_id AND o.event_type IS NOT DISTINCT FROM r.event_type AND o.n = r.n + 1)
    SELECT event_id, user_id, event_type FROM r WHERE passed"""
)
def event_cooldown(spark, d):
    return signals.cooldown_of(table(spark, d, "events"), ["user_id", "event_type"], 600).select("event_id", "user_id", "event_type")


@_query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_events(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return files.latest(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "at").select("user_id", "event_id", "event_type")


for _name, (_function, _sql) in star.QUERIES.items():
    _query(_sql)(_function)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

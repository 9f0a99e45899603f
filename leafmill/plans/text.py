"""Queries over functions on text and over the translation of entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.operators import layout, translate
from leafmill.sources import table


def _entries(spark, folder):
    return layout.entries(table(spark, folder, "page_entries"), ("doc_id",)).select(*layout.ENTRY, "category", "text")


def entry_scripts(spark, folder):
    """Of every entry whether it is worth translating, which script it shows, how many boxes, how wide and how many bytes."""
    t = F.col("text")
    return _entries(spark, folder).where("text is not null").select(
        *layout.ENTRY, X.worth_translating(t).alias("worth"), X.has_cjk(t).alias("cjk"), X.script_language(t).alias("script"), X.boxes(t).cast("long").alias("n_boxes"),
        X.display_width(t).cast("long").alias("width"), X.utf8_size(t).cast("long").alias("n_bytes"),
    )


def entry_masks(spark, folder):
    """Texts with boxes masked, and unmasked again."""
    t = F.col("text")
    return _entries(spark, folder).where(t.rlike("[☐☑]")).select(*layout.ENTRY, X.masked(t).alias("masked"), X.unmasked(X.masked(t)).alias("text"))


def entry_signatures(spark, folder):
    """How often each signature of a text comes, where it comes more than once."""
    return _entries(spark, folder).groupBy(X.signature(F.col("text")).alias("signature")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and signature <> ''")


def entry_xml(spark, folder):
    """Texts with signs of markup, escaped, their dollars balanced and inline math in dollars."""
    t = F.col("text")
    return _entries(spark, folder).where(t.rlike("[<&>]")).select(*layout.ENTRY, X.xml_escaped(t).alias("escaped"), X.inline_math(t).alias("math"))


def document_dollars(spark, folder):
    """Texts with dollar signs, balanced by line."""
    return table(spark, folder, "documents").where(F.col("text").contains("$")).select("doc_id", X.balanced_dollars(F.col("text")).alias("text"))


def artifact_names(spark, folder):
    """Names of translated files."""
    t = table(spark, folder, "translations").dropDuplicates(["id"])
    return t.select("id", X.artifact_name(F.col("original_name"), F.col("target_lang"), ".docx").alias("name"))


def download_headers(spark, folder):
    """Header values that name the downloads."""
    return table(spark, folder, "documents").select("doc_id", X.content_disposition("original_name").alias("header"))


def repeated_tails(spark, folder):
    """Entries whose text ends in a repeated tail."""
    return _entries(spark, folder).select(*layout.ENTRY, X.repeated_tail("text").alias("period")).where("period > 0")


def formula_texts(spark, folder):
    """Texts with their inline formulas as plain signs."""
    return table(spark, folder, "documents").where(F.col("text").contains("$")).select("doc_id", X.formulas_as_text("text").alias("text"))


def translation_units(spark, folder):
    """Every unit of every entry."""
    return translate.units(_entries(spark, folder))


def unit_chunks(spark, folder):
    """The chunk of every wanted unit."""
    return translate.chunked(translate.units(_entries(spark, folder)).where("wanted"), 20, 1000).select(*translate.UNIT, "chunk")


def _signed(texts):
    return ["» " + t for t in texts]


def entries_translated(spark, folder):
    """Every entry translated by a model that puts a sign before each unit."""
    return translate.translated(_entries(spark, folder), _signed)


def entries_translated_windowed(spark, folder):
    """The same, window by window of two pages."""
    return translate.translated(_entries(spark, folder), _signed, window=2)


def window_totals(spark, folder):
    """Units and failures of each document so far, by windows of two pages, when a model fails for long units."""
    every = translate.units(_entries(spark, folder)).where("wanted")
    model = lambda ts: [t.upper() for t in ts] if max(map(len, ts)) < 100 else []
    return translate.running_totals(translate.called(translate.chunked(every, window=2), model), 2)


def _half_done(texts):
    return [t if len(t) > 40 else "done" for t in texts]


def residual_units(spark, folder):
    """Units that still hold Chinese after a model that leaves long texts as they are, and two more tries."""
    every = translate.units(_entries(spark, folder)).where("wanted")
    out = translate.retried(translate.called(translate.chunked(every), _half_done), _half_done)
    return out.where(X.has_cjk(F.col("result"))).select(*translate.UNIT, "result")


def unit_outcomes(spark, folder):
    """Units of each document and how many fell back when a model answers nothing for chunks with a long unit."""
    every = translate.units(_entries(spark, folder)).where("wanted")
    model = lambda ts: [t.upper() for t in ts] if max(map(len, ts)) < 100 else []
    return translate.outcome(translate.called(translate.chunked(every), model))


def pages_resumed(spark, folder):
    """Entries of translated documents with their first pages taken from a saved copy."""
    e = _entries(spark, folder)
    jobs = table(spark, folder, "translations").dropDuplicates(["id"]).where("pages_done is not null").groupBy("source_document_id").agg(F.max("pages_done").alias("pages_done"), F.max("page_count").alias("page_count"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("id").alias("source_document_id"), F.col("page_count").alias("now_pages"))
    checkpoints = jobs.join(docs, "source_document_id")
    saved = e.withColumn("text", F.concat(F.lit("saved "), "text"))
    return translate.resumed(saved, e, checkpoints)


_NAMES = """entry_scripts entry_masks entry_signatures entry_xml document_dollars artifact_names download_headers repeated_tails formula_texts translation_units unit_chunks entries_translated
entries_translated_windowed window_totals residual_units unit_outcomes pages_resumed""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_E = r"""e AS (SELECT DISTINCT ON (doc_id, page_index, entry_idx) doc_id, page_index, entry_idx, category, text FROM page_entries)"""
_CJK = "[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]"
_U = rf"""{_E}, c AS (SELECT doc_id, page_index, entry_idx, text, array_to_string(list_transform(regexp_split_to_array(trim(category), '[-_ ]+'), lambda w: upper(w[1]) || lower(w[2:])), '-') AS category FROM e WHERE trim(coalesce(text, '')) <> ''),
    k AS (SELECT *, CASE WHEN category = 'Table' THEN list_filter(string_split(regexp_replace(text, '(<[^>]+>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')
        WHEN category IN ('Equation-Block', 'Formula') THEN list_filter(string_split(regexp_replace(text, '(\\text\{{[^{{}}]*\}})', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') ELSE [text] END AS ps FROM c),
    x AS (SELECT doc_id, page_index, entry_idx, category, CAST(i AS INTEGER) AS part_idx, ps[i + 1] AS part FROM k, LATERAL (SELECT unnest(range(len(ps))) AS i)),
    y AS (SELECT *, coalesce(category IN ('Equation-Block', 'Formula'), false) AS formula, coalesce(category IN ('Equation-Block', 'Formula'), false) AND regexp_full_match(part, '\\text\{{[^{{}}]*\}}') AS wrapped FROM x),
    z AS (SELECT *, CASE WHEN wrapped THEN part[7:-2] ELSE part END AS unit FROM y),
    u AS (SELECT *, coalesce(category, '') <> 'Picture' AND NOT (coalesce(category, '') = 'Table' AND part[1] = '<' AND part[-1] = '>') AND (NOT formula OR wrapped) AND regexp_matches(unit, '\p{{L}}') AS wanted FROM z)"""
_SIGNED = f"""WITH {_U} SELECT doc_id, page_index, entry_idx, string_agg(CASE WHEN wrapped AND wanted THEN '\\text{{' || '» ' || unit || '}}' WHEN wanted THEN '» ' || unit ELSE part END, '' ORDER BY part_idx) AS text FROM u GROUP BY ALL"""
SQL = {
    "entry_scripts": rf"""WITH {_E} SELECT doc_id, page_index, entry_idx, regexp_matches(text, '\p{{L}}') AS worth, regexp_matches(text, '{_CJK}') AS cjk,
        CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[㐀-䶿一-鿿]') THEN 'zh' END AS script,
        len(regexp_extract_all(text, '[☐-☒○●◯✓✔✗✘]|(?i:<input\b)')) AS n_boxes, length(text) + len(regexp_extract_all(text, '[ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]')) AS width, strlen(text) AS n_bytes FROM e WHERE text IS NOT NULL""",
    "entry_masks": f"WITH {_E} SELECT doc_id, page_index, entry_idx, replace(replace(text, '☑', '[[CBX_ON]]'), '☐', '[[CBX_OFF]]') AS masked, text FROM e WHERE regexp_matches(text, '[☐☑]')",
    "entry_signatures": f"WITH {_E}, s AS (SELECT regexp_replace(lower(coalesce(text, '')), '[^0-9a-z㐀-䶿一-鿿]', '', 'g') AS signature FROM e) SELECT signature, count(*) AS n FROM s WHERE signature <> '' GROUP BY 1 HAVING count(*) > 1",
    "entry_xml": rf"""WITH {_E} SELECT doc_id, page_index, entry_idx, replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
        CASE WHEN text ILIKE '%<math display=%block%' THEN text ELSE regexp_replace(text, '(?is)<math[^>]*>(.*?)</math>', '$\1$', 'g') END AS math FROM e WHERE regexp_matches(text, '[<&>]')""",
    "document_dollars": r"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(regexp_extract_all(x, '\$')) % 2 = 1 THEN x || '$' ELSE x END), chr(10)) AS text FROM documents WHERE contains(text, '$')""",
    "artifact_names": r"""SELECT DISTINCT id, regexp_replace(original_name, '\.[^.]*$', '') || CASE WHEN regexp_replace(coalesce(target_lang, ''), '[^A-Za-z0-9_-]', '', 'g') <> '' THEN '_' || regexp_replace(target_lang, '[^A-Za-z0-9_-]', '', 'g') ELSE '' END || '.docx' AS name FROM translations""",
    "translation_units": f"WITH {_U} SELECT doc_id, page_index, entry_idx, part_idx, unit, wanted, wrapped FROM u",
    "unit_chunks": f"""WITH RECURSIVE {_U}, w AS (SELECT doc_id, page_index, entry_idx, part_idx, strlen(unit) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, entry_idx, part_idx) AS k FROM u WHERE wanted),
        f AS (SELECT doc_id, k, 0 AS chunk, 1 AS items, b AS bytes FROM w WHERE k = 1
            UNION ALL SELECT w.doc_id, w.k, CASE WHEN f.items >= 20 OR f.bytes + w.b > 1000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.items >= 20 OR f.bytes + w.b > 1000 THEN 1 ELSE f.items + 1 END,
            CASE WHEN f.items >= 20 OR f.bytes + w.b > 1000 THEN w.b ELSE f.bytes + w.b END FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1)
        SELECT doc_id, page_index, entry_idx, part_idx, chunk FROM f JOIN w USING (doc_id, k)""",
    "entries_translated": _SIGNED,
    "entries_translated_windowed": _SIGNED,
    "unit_outcomes": f"WITH {_U} SELECT doc_id, count(*) AS n_units, count(*) FILTER (length(unit) >= 100) AS n_fell_back, bool_and(length(unit) >= 100) AS failed FROM u WHERE wanted GROUP BY doc_id",
    "window_totals": f"""WITH {_U}, w AS (SELECT doc_id, CAST(page_index // 2 AS INTEGER) AS window_no, count(*) AS n, count(*) FILTER (length(unit) >= 100) AS f FROM u WHERE wanted GROUP BY ALL)
        SELECT doc_id, window_no, CAST(sum(n) OVER o AS BIGINT) AS n_units, CAST(sum(f) OVER o AS BIGINT) AS n_fell_back FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY window_no)""",
    "repeated_tails": f"""WITH {_E}, t AS (SELECT doc_id, page_index, entry_idx, right(coalesce(text, ''), 500) AS t FROM e),
        p AS (SELECT *, list_filter(range(1, length(t) // 4 + 1), lambda p: CAST(floor(4 + 12.0 / p) + 1 AS INTEGER) * p <= length(t) AND right(t, CAST(floor(4 + 12.0 / p) AS INTEGER) * p) = left(right(t, CAST(floor(4 + 12.0 / p) + 1 AS INTEGER) * p), CAST(floor(4 + 12.0 / p) AS INTEGER) * p)) AS ps FROM t)
        SELECT doc_id, page_index, entry_idx, CAST(ps[1] AS INTEGER) AS period FROM p WHERE len(ps) > 0""",
    "residual_units": f"WITH {_U} SELECT doc_id, page_index, entry_idx, part_idx, unit AS result FROM u WHERE wanted AND length(unit) > 40 AND regexp_matches(unit, '{_CJK}')",
    "pages_resumed": f"""WITH {_E}, t AS (SELECT source_document_id, max(pages_done) AS pages_done, max(page_count) AS page_count FROM (SELECT DISTINCT ON (id) * FROM translations) WHERE pages_done IS NOT NULL GROUP BY 1),
        c AS (SELECT d.doc_id, t.pages_done FROM t JOIN documents d ON d.id = t.source_document_id WHERE t.pages_done > 0 AND t.pages_done <= t.page_count AND t.page_count = d.page_count)
        SELECT e.doc_id, page_index, entry_idx, CASE WHEN page_index < pages_done THEN 'saved ' || text ELSE text END AS text, coalesce(page_index < pages_done, false) AS was_saved FROM e LEFT JOIN c USING (doc_id)""",
}

"""Queries over what a first reading missed, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import blocks
from leafmill.functions import geometry as G
from leafmill.functions import text as X
from leafmill.operators import layout, nested, recovery
from leafmill.plans.general import _PAGES
from leafmill.plans.layout import _E, _SX
from leafmill.sources import table


def _entries(spark, folder):
    return layout.entries(table(spark, folder, "page_entries"))


def zone_styles(spark, folder):
    """The category that most characters have in each quarter of a page's height."""
    e = _entries(spark, folder).where("x1 is not null and category is not null")
    h, w = F.col("page_height_pt") * F.col("zoom"), F.col("page_width_pt") * F.col("zoom")
    zones = e.select("doc_id", "page_index", h.alias("h"), w.alias("w")).groupBy("doc_id", "page_index").agg(F.max("h").alias("h"), F.max("w").alias("w"))
    quarter = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("entry_idx")
    boxes = zones.select("doc_id", "page_index", "h", "w", quarter).select("doc_id", "page_index", "entry_idx", F.lit(0.0).alias("x1"), (F.col("h") / 4 * F.col("entry_idx")).alias("y1"), F.col("w").alias("x2"), (F.col("h") / 4 * (F.col("entry_idx") + 1)).alias("y2"))
    spans = e.select("doc_id", "page_index", F.col("entry_idx").alias("span_idx"), "x1", "y1", "x2", "y2", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "category")
    return recovery.styled(boxes, spans, ["category"])


def caption_owners(spark, folder):
    """What each caption belongs to."""
    return recovery.captions(_entries(spark, folder), 200.0)


def _forms(spark, folder):
    """Entries as lines of forms: every third names a pair of options after its text, every ninth shows a box."""
    return _entries(spark, folder).withColumn("text", F.when(F.col("entry_idx") % 9 == 0, F.concat("text", F.lit(": ☐ yes no"))).when(F.col("entry_idx") % 3 == 0, F.concat("text", F.lit(": Pass / Fail"))).otherwise(F.col("text")))


def box_candidates(spark, folder):
    """Lines of forms that name a pair of options and show no box."""
    return recovery.box_candidates(_forms(spark, folder)).select(*layout.ENTRY)


def boxes_taken(spark, folder):
    """Second readings with boxes that keep the first one's words; every other reading loses one."""
    e = recovery.box_candidates(_forms(spark, folder)).select(*layout.ENTRY, "text")
    new = e.select(*layout.ENTRY, F.when(F.col("entry_idx") % 2 == 0, F.concat(F.lit("☑ "), "text")).otherwise(F.lit("☑ other")).alias("new_text"))
    return recovery.taken_boxes(e, new)


def turn_candidates(spark, folder):
    return recovery.turn_candidates(_entries(spark, folder)).select(*layout.ENTRY)


def pictures_lost(spark, folder):
    """Recovered entries whose place no other entry has."""
    e = _entries(spark, folder).where("x1 is not null")
    return recovery.lost_pictures(e.where("source is not null"), e.where("source is null"), same=0.01)


def page_rules(spark, folder):
    """Upper edges of a page's boxes, near ones made one."""
    return recovery.merged_rules(_entries(spark, folder).where("y1 is not null"), layout.PAGE, "y1", 40.0)


def scan_types(spark, folder):
    return recovery.scan_types(_entries(spark, folder))


def diagram_lines(spark, folder):
    """Lines of diagram regions that were read surely enough and hold a letter."""
    parts = nested.flat_tables(nested.occurrences(table(spark, folder, "documents")))["parts"].where("region_idx >= 0")
    lines = parts.withColumn("line_no", F.regexp_extract("path", r"^/lines/(\d+)$", 1).try_cast("int")).where("line_no is not null")
    conf = F.get_json_object("fields", "$.conf").try_cast("double")
    return lines.where((conf >= 0.45) & X.worth_translating(F.col("text"))).select("doc_id", "page_index", "entry_idx", "region_idx", "line_no", "text", F.round(conf, 4).alias("conf"))


def _plain(kind):
    functions = {"block": blocks.block_text, "list": blocks.list_text, "outside": blocks.outside_tables}
    return lambda column: X._vectorised(functions[kind], "string", column)


def block_texts(spark, folder):
    """Entries with markup as plain text."""
    e = _entries(spark, folder).where(F.col("text").rlike("<[a-zA-Z]"))
    return e.select(*layout.ENTRY, _plain("block")(F.col("text")).alias("text"))


def list_texts(spark, folder):
    """Lists of pages as numbered lines."""
    e = _entries(spark, folder).where(F.col("text").rlike("(?i)<[uo]l"))
    return e.select(*layout.ENTRY, _plain("list")(F.col("text")).alias("text"))


def outside_tables(spark, folder):
    """What stands outside the tables of entries."""
    e = _entries(spark, folder).where(F.col("text").rlike("(?i)<table"))
    return e.select(*layout.ENTRY, _plain("outside")(F.col("text")).alias("text"))


def event_frames(spark, folder):
    """Events written as a stream of frames and read again."""
    ev = table(spark, folder, "events")
    wire = F.concat(F.lit("event: "), F.col("event_type"), F.lit("\ndata: "), F.col("props"), F.lit("\n\n: keep\n\nevent: end\ndata: "), F.col("event_id").cast("string"), F.lit("\n\n"))
    rows = ev.select("event_id", F.posexplode(blocks.frames(wire)).alias("frame_no", "f"))
    return rows.select("event_id", "frame_no", "f.event", "f.data")


def entry_sizes(spark, folder):
    """Lines and font size of every entry by its box, and whether the box is a container of its text."""
    e = _entries(spark, folder).where("x1 is not null")
    wide = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]"))
    lines = G.estimated_lines(F.trim("text"), F.col("x2") - F.col("x1"), F.col("zoom"), wide)
    height = (F.col("y2") - F.col("y1")).cast("double")
    rows = e.select(*layout.ENTRY, lines.alias("n_lines"), height.alias("h"), "zoom")
    return rows.select(*layout.ENTRY, "n_lines", G.estimated_size(F.col("h"), F.col("n_lines"), F.col("zoom")).alias("size_pt"), G.is_container(F.col("h") / F.col("zoom"), F.col("n_lines"), F.lit(2.0)).alias("container"))


def markdown_cells(spark, folder):
    """Cells of the Markdown tables of documents."""
    docs = table(spark, folder, "documents").where(F.col("text").rlike(r"(?md)^\|.*\|$"))
    rows = docs.select("doc_id", F.posexplode(blocks.markdown_rows(F.col("text"))).alias("row_no", "cells"))
    return rows.select("doc_id", "row_no", F.posexplode("cells").alias("col_no", "cell"))


_NAMES = "entry_sizes markdown_cells zone_styles caption_owners box_candidates boxes_taken turn_candidates pictures_lost page_rules scan_types diagram_lines block_texts list_texts outside_tables event_frames".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_HINT = "|".join(X.OPTION_PAIRS)
_FORMS = "SELECT * REPLACE (CASE WHEN entry_idx % 9 = 0 THEN text || ': ☐ yes no' WHEN entry_idx % 3 = 0 THEN text || ': Pass / Fail' ELSE text END AS text) FROM e"
_GAP = "greatest(b.y1 - a.y2, a.y1 - b.y2, 0)"
SQL = {
    "entry_sizes": f"""WITH {_E}, w AS (SELECT *, trim(text) AS t, length(trim(text)) + len(regexp_extract_all(coalesce(text, ''), '[぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]')) AS n FROM e WHERE x1 IS NOT NULL),
        l AS (SELECT *, CAST(CASE WHEN coalesce(t, '') = '' THEN 1 ELSE greatest(length(t) - length(replace(t, chr(10), '')) + 1, least(50, greatest(1, ceil(n * 7.0::DOUBLE * greatest(zoom, 1.0::DOUBLE) / greatest(CAST(x2 - x1 AS DOUBLE), 1.0::DOUBLE) - 0.25::DOUBLE)))) END AS INTEGER) AS n_lines FROM w),
        z AS (SELECT *, CAST(y2 - y1 AS DOUBLE) / n_lines / zoom * 0.7::DOUBLE AS s FROM l)
        SELECT doc_id, page_index, entry_idx, n_lines, CASE WHEN s BETWEEN 6 AND 96 THEN round_even(s, 1) ELSE 11.0::DOUBLE END AS size_pt, CAST(y2 - y1 AS DOUBLE) / zoom > n_lines * 2.0::DOUBLE * 7 AND y2 > y1 AS container FROM z""",
    "zone_styles": f"""WITH {_E}, s AS (SELECT * FROM e WHERE x1 IS NOT NULL AND category IS NOT NULL), z AS (SELECT doc_id, page_index, max(page_height_pt * zoom) AS h FROM s GROUP BY ALL),
        w AS (SELECT max(page_width_pt * zoom) AS w, doc_id, page_index FROM s GROUP BY ALL),
        o AS (SELECT s.doc_id, s.page_index, s.entry_idx AS span_idx, category, length(coalesce(text, '')) AS n, min(q.q) AS entry_idx FROM s JOIN z USING (doc_id, page_index) JOIN w USING (doc_id, page_index), (SELECT unnest([0, 1, 2, 3]) AS q) q
            WHERE (y1 + y2) / 2 >= h / 4 * q AND (y1 + y2) / 2 <= h / 4 * (q + 1) AND (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 <= w GROUP BY ALL),
        t AS (SELECT doc_id, page_index, entry_idx, category, CAST(sum(n) AS BIGINT) AS weight, min(span_idx) AS seen FROM o GROUP BY ALL)
        SELECT doc_id, page_index, entry_idx, category, weight FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, entry_idx ORDER BY weight DESC, seen) = 1""",
    "caption_owners": f"""WITH {_E}, p AS (SELECT a.doc_id, a.page_index, a.entry_idx, b.entry_idx AS owner_idx, {_GAP} AS gap FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page_index = b.page_index
        WHERE a.category = 'Caption' AND b.category IN ('Table', 'Image', 'Figure', 'Form') AND {_SX} > 0 AND {_GAP} <= 200 * a.zoom)
        SELECT doc_id, page_index, entry_idx, owner_idx, gap FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, entry_idx ORDER BY gap, owner_idx) = 1""",
    "turn_candidates": f"""WITH {_E} SELECT doc_id, page_index, entry_idx FROM e WHERE category IN {recovery.TEXT_CATEGORIES} AND length(trim(text)) >= 2 AND rotation = 0 AND y2 - y1 >= 2 * (x2 - x1)""",
    "pictures_lost": f"""WITH {_E}, f AS (SELECT * FROM e WHERE x1 IS NOT NULL), i AS (SELECT *, CAST(x2 - x1 AS DOUBLE) * (y2 - y1) AS s FROM f)
        SELECT a.doc_id, a.page_index, a.entry_idx FROM i a WHERE a.source IS NOT NULL AND a.x2 - a.x1 >= 12 * a.zoom AND a.y2 - a.y1 >= 12 * a.zoom AND NOT EXISTS
        (SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.page_index = a.page_index AND b.source IS NULL AND b.entry_idx <> a.entry_idx
            AND greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
            >= 0.01 * (a.s + b.s - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) AND a.s + b.s > 0)""",
    "page_rules": f"""WITH {_E}, r AS (SELECT doc_id, page_index, y1, CASE WHEN y1 - lag(y1) OVER w < 40 THEN 0 ELSE 1 END AS start FROM e WHERE y1 IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y1)),
        n AS (SELECT *, sum(start) OVER (PARTITION BY doc_id, page_index ORDER BY y1 RANGE UNBOUNDED PRECEDING) AS run FROM r)
        SELECT doc_id, page_index, min(y1) AS position, count(*) AS n_rules FROM n GROUP BY doc_id, page_index, run""",
    "scan_types": f"""WITH {_E}, p AS (SELECT doc_id, page_index, length(string_agg(trim(text), chr(10)) FILTER (trim(coalesce(text, '')) <> '')) AS n FROM e GROUP BY ALL)
        SELECT doc_id, CASE WHEN bool_or(coalesce(n, 0) >= 32) THEN 'native' ELSE 'scanned' END AS scan_type FROM p GROUP BY doc_id""",
    "box_candidates": f"""WITH {_E}, o AS ({_FORMS}) SELECT doc_id, page_index, entry_idx FROM o WHERE category IN {recovery.FORM_CATEGORIES} AND regexp_matches(text, '{_HINT}') AND NOT regexp_matches(text, '[☐-☒○●◯✓✔✗✘]|(?i:<input\\b)')""",
    "boxes_taken": f"""WITH {_E}, o AS ({_FORMS}), c AS (SELECT * FROM o WHERE category IN {recovery.FORM_CATEGORIES} AND regexp_matches(text, '{_HINT}') AND NOT regexp_matches(text, '[☐-☒○●◯✓✔✗✘]|(?i:<input\\b)'))
        SELECT doc_id, page_index, entry_idx, CASE WHEN entry_idx % 2 = 0 THEN '☑ ' || text ELSE '☑ other' END AS new_text FROM c
        WHERE entry_idx % 2 = 0 OR contains('other', regexp_replace(lower(text), '[^0-9a-z㐀-䶿一-鿿]', '', 'g'))""",
    "diagram_lines": f"""WITH {_PAGES}, l AS (SELECT doc_id, page_index, entry_idx, region_idx, CAST(i AS INTEGER) AS line_no, json_extract(ls, '$[' || i || ']') AS l
        FROM (SELECT *, json_extract(r, '$.lines') AS ls FROM regions WHERE json_type(r) = 'OBJECT'), LATERAL (SELECT unnest(range(CAST(json_array_length(ls) AS BIGINT))) AS i) WHERE json_type(ls) = 'ARRAY')
        SELECT doc_id, page_index, entry_idx, region_idx, line_no, l ->> '$.text' AS text, round(CAST(l ->> '$.conf' AS DOUBLE), 4) AS conf FROM l WHERE CAST(l ->> '$.conf' AS DOUBLE) >= 0.45 AND regexp_matches(l ->> '$.text', '\\p{{L}}')""",
    "markdown_cells": r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '(?m)^\|.*\|$')),
        t AS (SELECT doc_id, list_filter(list_transform(list_filter(ls, lambda x: contains(x, '|') AND NOT regexp_full_match(x, '[\s|:-]+')), lambda x: list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rs FROM d),
        r AS (SELECT doc_id, CAST(i AS INTEGER) AS row_no, rs[i + 1] AS cs FROM t, LATERAL (SELECT unnest(range(len(rs))) AS i))
        SELECT doc_id, row_no, CAST(k AS INTEGER) AS col_no, cs[k + 1] AS cell FROM r, LATERAL (SELECT unnest(range(len(cs))) AS k)""",
    "event_frames": """SELECT event_id, unnest([0, 1, 2]) AS frame_no, unnest([event_type, '', 'end']) AS event, unnest([props, '', CAST(event_id AS VARCHAR)]) AS data FROM events""",
}

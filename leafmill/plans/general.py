"""Queries of the general training-data problems 1 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import incremental, nested
from leafmill.sources import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found(table(spark, folder, "documents"))


def p1_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Every different object of all layouts once, with the number of its places."""
    return nested.objects(nested.occurrences(table(spark, folder, "documents")))


def _flat(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.flat_tables(nested.occurrences(table(spark, folder, "documents")))[name].drop("parent_id", "object_id", "fields")

    query.__doc__ = f"The flat table of {name}; each row names its parent by the leading columns."
    return query


def p1_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every object at any depth, with its parent's and its own identity."""
    return nested.occurrences(table(spark, folder, "documents"), payload=False)


def p1_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The objects below pages, entries and regions (styles, lines of regions, …), each with its path, identities and fields."""
    return nested.flat_tables(nested.occurrences(table(spark, folder, "documents")))["parts"]


def p1_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every layout put together again from the bridge and the objects stored once."""
    bridge = nested.occurrences(table(spark, folder, "documents"))
    return nested.rebuilt(bridge, nested.objects(bridge))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.replay(table(spark, folder, "change_feed"), table(spark, folder, "runs"))


def p6_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Records with changes that no successful run has covered yet."""
    feed, runs = table(spark, folder, "change_feed"), table(spark, folder, "runs")
    changed = incremental.changes(feed)
    done = incremental.candidates(changed, incremental.reread_spans(feed, runs))
    return incremental.unprocessed(changed, done).groupBy("tab", "rec_id").agg(F.count(F.lit(1)).alias("n_changes"))


QUERIES = {
    "p1_found": p1_found,
    "p1_objects": p1_objects,
    "p1_pages": _flat("pages"),
    "p1_entries": _flat("entries"),
    "p1_regions": _flat("regions"),
    "p1_bridge": p1_bridge,
    "p1_parts": p1_parts,
    "p1_rebuilt": p1_rebuilt,
    "p6_found": p6_found,
    "p6_pending": p6_pending,
}

_PAGES = """
    decoded AS (
        SELECT doc_id, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(j ->> '$' AS JSON) ELSE j END AS j
        FROM (SELECT doc_id, TRY_CAST(layout AS JSON) AS j FROM documents)
        WHERE j IS NOT NULL),
    page_lists AS (
        SELECT doc_id, CASE json_type(j) WHEN 'ARRAY' THEN j ELSE json_extract(j, '$.pages') END AS ps
        FROM decoded WHERE json_type(j) IN ('ARRAY', 'OBJECT')),
    pages AS (
        SELECT doc_id, CAST(i AS INTEGER) AS pos, json_extract(ps, '$[' || i || ']') AS p
        FROM page_lists, LATERAL (SELECT unnest(range(CAST(json_array_length(ps) AS BIGINT))) AS i) WHERE json_type(ps) = 'ARRAY'),
    entry_lists AS (
        SELECT doc_id, pos, p, COALESCE(TRY_CAST(CASE WHEN json_type(p) = 'OBJECT' THEN p ->> '$.page_index' END AS INTEGER), pos) AS page_index,
            CASE WHEN json_type(p) = 'ARRAY' THEN p
                 WHEN json_type(json_extract(p, '$.entries')) = 'ARRAY' THEN json_extract(p, '$.entries')
                 ELSE json_extract(p, '$.layout_result') END AS es
        FROM pages),
    entries AS (
        SELECT doc_id, pos AS page_pos, page_index, CAST(i AS INTEGER) AS entry_idx, json_extract(es, '$[' || i || ']') AS e
        FROM entry_lists, LATERAL (SELECT unnest(range(CAST(json_array_length(es) AS BIGINT))) AS i) WHERE json_type(es) = 'ARRAY'),
    regions AS (
        SELECT doc_id, page_pos, page_index, entry_idx, CAST(i AS INTEGER) AS region_idx, json_extract(rs, '$[' || i || ']') AS r
        FROM (SELECT doc_id, page_pos, page_index, entry_idx, json_extract(e, '$.diagram_regions') AS rs FROM entries WHERE json_type(e) = 'OBJECT'),
            LATERAL (SELECT unnest(range(CAST(json_array_length(rs) AS BIGINT))) AS i) WHERE json_type(rs) = 'ARRAY'
        UNION ALL
        SELECT doc_id, page_pos, page_index, entry_idx, 0, json_extract(e, '$.diagram_regions')
        FROM entries WHERE json_type(json_extract(e, '$.diagram_regions')) = 'OBJECT')
"""


def _corners(box: str) -> str:
    """x1, y1, x2, y2 of a JSON box in any notation: a list by position, an object or string only with four numbers."""
    listed = f"list_transform(range(4), lambda i: TRY_CAST({box} ->> ('$[' || i || ']') AS DOUBLE))"
    named = f"[TRY_CAST({box} ->> ('$.' || n) AS DOUBLE) FOR n IN ['x1', 'y1', 'x2', 'y2']]"
    written = f"list_transform(regexp_split_to_array(trim(regexp_replace({box} ->> '$', '[][(),;]', ' ', 'g')), '\\s+'), lambda v: TRY_CAST(v AS DOUBLE))"
    whole = lambda x: f"CASE WHEN len({x}) = 4 AND len(list_filter({x}, lambda v: v IS NOT NULL)) = 4 THEN {x} END"
    return f"CASE json_type({box}) WHEN 'ARRAY' THEN {listed} WHEN 'OBJECT' THEN {whole(named)} WHEN 'VARCHAR' THEN {whole(written)} END"


_BOX = "b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2"
_CHANGES = """
    states AS (
        SELECT *, struct_pack(u := updated_at, a := arrived_at, f := feed_id, s := status) AS state
        FROM change_feed WHERE arrived_at IS NOT NULL AND rec_id IS NOT NULL AND tab IS NOT NULL),
    seen AS (
        SELECT *, max(state) OVER (PARTITION BY tab, rec_id ORDER BY arrived_at, feed_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
        FROM states),
    changes AS (
        SELECT tab, rec_id, feed_id, arrived_at FROM seen
        WHERE last IS NULL OR updated_at > last.u OR (updated_at = last.u AND status IS DISTINCT FROM last.s)),
    covered AS (
        SELECT c.tab, c.rec_id, c.feed_id,
            (SELECT min(struct_pack(a := r.started_at, b := r.run_id)) FROM runs r WHERE r.state = 'ok' AND r.started_at >= c.arrived_at) AS run
        FROM changes c)
"""
SQL = {
    "p1_found": f"""
        WITH {_PAGES}
        SELECT doc_id, page_index, entry_idx, CAST(-1 AS INTEGER) AS region_idx FROM entries WHERE json_type(e) <> 'NULL'
        UNION ALL
        SELECT doc_id, page_index, entry_idx, region_idx FROM regions WHERE json_type(r) <> 'NULL'
    """,
    "p1_pages": f"""
        WITH {_PAGES}
        SELECT doc_id, pos AS page_pos, page_index, {", ".join(f"TRY_CAST(CASE WHEN json_type(p) = 'OBJECT' THEN p ->> '$.{c}' END AS DOUBLE) AS {c}" for c in ("page_width_pt", "page_height_pt", "zoom"))}
        FROM entry_lists WHERE json_type(p) <> 'NULL'
    """,
    "p1_entries": f"""
        WITH {_PAGES}
        SELECT doc_id, page_pos, page_index, entry_idx, {_BOX}, {", ".join(f"e ->> '$.{c}' AS {c}" for c in ("category", "text", "source", "image_key"))},
            TRY_CAST(e ->> '$.rotation' AS DOUBLE) AS rotation, e ->> '$.style.font' AS style_font, TRY_CAST(e ->> '$.style.size' AS DOUBLE) AS style_size,
            TRY_CAST(e ->> '$.style.bold' AS BOOLEAN) AS style_bold, TRY_CAST(e ->> '$.style.italic' AS BOOLEAN) AS style_italic
        FROM (SELECT *, {_corners("json_extract(e, '$.bbox')")} AS b FROM entries WHERE json_type(e) <> 'NULL')
    """,
    "p1_regions": f"""
        WITH {_PAGES}
        SELECT doc_id, page_pos, page_index, entry_idx, region_idx, {_BOX}, r ->> '$.text' AS text, r ->> '$.style.font' AS style_font, TRY_CAST(r ->> '$.style.size' AS DOUBLE) AS style_size
        FROM (SELECT *, {_corners("json_extract(r, '$.bbox')")} AS b FROM regions WHERE json_type(r) <> 'NULL')
    """,
    "p6_found": f"WITH {_CHANGES} SELECT DISTINCT run.b AS run_id, tab, rec_id FROM covered WHERE run IS NOT NULL",
    "p6_pending": f"WITH {_CHANGES} SELECT tab, rec_id, count(*) AS n_changes FROM covered WHERE run IS NULL GROUP BY tab, rec_id",
}

"""Nested layout records as related flat tables, by Merkle subtree identities.

A layout is read bottom-up. Every object has an identity: a 128-bit hash over
its kind, its own fields in canonical form and the ordered identities of its
children. Documents, pages, entries and regions are kinds of their own; every
other object, at any depth and under any field, is a part, reached from its
page, entry or region by a path (a JSON pointer such as ``/style`` or
``/lines/3``). Equal objects have equal identities wherever they stand, so
each is stored once (``objects``), while ``occurrences`` keeps a bridge row
for every place: document, ordinals on the way down, path, the parent's
identity and the child's.

Both tables come from one pass over the documents without a shuffle; storing
objects once is an aggregation on the identity, combined on the map side, so
an object that stands in a third of all documents costs one row per task.
``rebuilt`` puts the layouts together again from the bridge and the objects.

Canonical is the notation, never the value: keys are sorted, absent and null
fields are alike, a box is a list however it was written and keeps its
fractions, a whole number has no point, a page is an object with ``entries``,
an empty list of regions is none.

Defined results: a null, empty or damaged layout gives no rows; a null in a
list gives a bridge row without child, so that positions stay; a layout that
is a string holding JSON is read once more; pages are a list, or stand under
``pages`` of an object, whose other fields are the document's; a page is an
object with ``entries`` or ``layout_result``, or the bare list of its entries;
a single region not in a list has position 0. ``page_index`` is the page's own
if it reads as a whole number, else its position. Objects more than
``DEEPEST`` levels below their entry stay values of the object above them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("document", "page", "entry", "region", "part")
DEEPEST = 100
_FIELDS = (
    ("doc_id", T.LongType(), pa.int64()), ("kind", T.StringType(), pa.string()), ("page_pos", T.IntegerType(), pa.int32()),
    ("page_index", T.IntegerType(), pa.int32()), ("entry_idx", T.IntegerType(), pa.int32()), ("region_idx", T.IntegerType(), pa.int32()),
    ("path", T.StringType(), pa.string()), ("parent_id", T.StringType(), pa.string()), ("object_id", T.StringType(), pa.string()),
    ("payload", T.StringType(), pa.string()), ("style", T.StringType(), pa.string()),
)
OCCURRENCE = T.StructType([T.StructField(name, kind) for name, kind, _ in _FIELDS])
ARROW = pa.schema([(name, kind) for name, _, kind in _FIELDS])
_canonical = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def read_layout(text: str | None) -> tuple[list, dict] | None:
    """The list of pages and the document's other fields, or None if the layout is not valid as a whole."""
    if not text:
        return None
    try:
        value = _decode(text)
        if isinstance(value, str):
            value = _decode(value)
    except (ValueError, RecursionError):
        return None
    other: dict = {}
    if isinstance(value, dict):
        other = {k: v for k, v in value.items() if k != "pages"}
        value = value.get("pages")
    return (value, other) if isinstance(value, list) else None


def _whole(value: object) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return int(number) if math.isfinite(number) and number == int(number) and abs(number) < 2**31 else None


def bbox_of(value: object) -> list[int | float] | None:
    """x1, y1, x2, y2 of any notation: list, object, or numbers in a string; None if there are not four numbers."""
    if isinstance(value, dict):
        if set(value) - {"x1", "y1", "x2", "y2"}:
            return None
        value = [value.get(k) for k in ("x1", "y1", "x2", "y2")]
    elif isinstance(value, str):
        value = value.strip("[]() ").replace(",", " ").replace(";", " ").split()
    if not isinstance(value, list) or len(value) != 4:
        return None
    out = [_number(v) for v in value]
    return None if None in out else out


def _number(value: object) -> int | float | None:
    """A finite number as it is, without a point if it is whole; None for anything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        number = float(value)
    except (ValueError, OverflowError):
        return None
    if not math.isfinite(number):
        return None
    return value if isinstance(value, int) else int(number) if number.is_integer() and abs(number) < 2**53 else number


def _identity(kind: str, payload: str, children: list[str]) -> str:
    return xxhash.xxh3_128_hexdigest("\x1f".join([kind, payload, *children]))


def _nests(value: object) -> bool:
    """True for an object, or a list that holds one at any depth."""
    return isinstance(value, dict) or isinstance(value, list) and any(map(_nests, value))


def _plain(value: object) -> object:
    """A value without null fields, whole numbers without a point."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 2**53 else value


def _step(path: str, name: object) -> str:
    return f"{path}/{str(name).replace('~', '~0').replace('/', '~1')}"


def _split(value: object, apart: tuple[str, ...], path: str, depth: int, parts: list[tuple]) -> tuple[str, list[str]]:
    """An object's own fields in canonical form, and its parts' names and identities; rows (path, parent, id, payload) of what is below it are added to ``parts``, ``parent`` left open for its direct ones."""
    if not isinstance(value, dict):
        return _canonical(_plain(value)), []
    own: dict = {}
    children: list[str] = []
    for k, v in value.items():
        if v is None or k in apart:
            continue
        if k == "bbox" and (box := bbox_of(v)) is not None:
            own[k] = box
        elif depth >= DEEPEST or not _nests(v):
            own[k] = _plain(v)
        else:
            _parts(v, _step(path, k), depth, parts, children)
    return _canonical(own), sorted(children)


def _parts(value: object, path: str, depth: int, parts: list[tuple], children: list[str]) -> None:
    if isinstance(value, list) and _nests(value):
        for k, v in enumerate(value):
            _parts(v, _step(path, k), depth, parts, children)
        return
    if value is None:
        parts.append((path, None, None, None))
        children.append(f"{path}=-")
        return
    first = len(parts)
    own, below = _split(value, (), "", depth + 1, parts)
    oid = _identity("part", own, below)
    for k in range(first, len(parts)):
        p, parent, *more = parts[k]
        parts[k] = (path + p, parent or oid, *more)
    parts.append((path, None, oid, own))
    children.append(f"{path}={oid}")


def _as_list(value: object) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _style(value: object) -> str | None:
    style = value.get("style") if isinstance(value, dict) else None
    return _canonical(_plain(style)) if isinstance(style, dict) else None


def _page_parts(page: object) -> tuple[object, str]:
    """A page's entries and the field that holds them."""
    if isinstance(page, list):
        return page, ""
    if not isinstance(page, dict):
        return None, ""
    name = "entries" if page.get("entries") is not None else "layout_result"
    return page.get(name), name


def subtree_rows(doc_id: int, text: str | None) -> Iterator[tuple]:
    """Bridge rows of one document, in the order of OCCURRENCE; the document's own comes last."""
    found = read_layout(text)
    if found is None:
        return
    rows: list[tuple] = []

    def add(value: object, kind: str, apart: tuple[str, ...], place: tuple, below: list[str], first: int) -> str:
        """The identity of an object whose children's rows are those from ``first`` on that have no parent yet; its parts' rows and its own are added."""
        parts: list[tuple] = []
        own, children = _split(value, apart, "", 0, parts)
        oid = _identity(kind, own, children + below)
        for k in range(first, len(rows)):
            if rows[k][7] is None:
                rows[k] = (*rows[k][:7], oid, *rows[k][8:])
        rows.extend((doc_id, "part", *place, path, parent or oid, pid, payload, None) for path, parent, pid, payload in parts)
        rows.append((doc_id, kind, *place, None, None, oid, own, _style(value)))
        return oid

    def none(kind: str, place: tuple) -> str:
        rows.append((doc_id, kind, *place, None, None, None, None, None))
        return "-"

    pages, other = found
    page_ids: list[str] = []
    for page_pos, page in enumerate(pages):
        if page is None:
            page_ids.append(none("page", (page_pos, page_pos, None, None)))
            continue
        own_index = _whole(page.get("page_index")) if isinstance(page, dict) else None
        index = page_pos if own_index is None else own_index
        entries, name = _page_parts(page)
        first_of_page, entry_ids = len(rows), []
        for entry_idx, entry in enumerate(_as_list(entries)):
            if entry is None:
                entry_ids.append(none("entry", (page_pos, index, entry_idx, -1)))
                continue
            first_of_entry, region_ids = len(rows), []
            regions = _as_list(entry.get("diagram_regions")) if isinstance(entry, dict) else []
            for region_idx, region in enumerate(regions):
                place = (page_pos, index, entry_idx, region_idx)
                region_ids.append(none("region", place) if region is None else add(region, "region", (), place, [], len(rows)))
            entry_ids.append(add(entry, "entry", ("diagram_regions",), (page_pos, index, entry_idx, -1), region_ids, first_of_entry))
        page_ids.append(add({} if isinstance(page, list) else page, "page", (name,), (page_pos, index, None, None), entry_ids, first_of_page))
    add(other, "document", (), (None, None, None, None), page_ids, 0)
    yield from rows


def canonical_layout(text: str | None) -> str | None:
    """A layout in canonical notation: an object with ``pages``; null if it is not valid as a whole."""
    found = read_layout(text)
    if found is None:
        return None

    def boxed(value: object) -> object:
        if isinstance(value, list):
            return [boxed(v) for v in value]
        if not isinstance(value, dict):
            return _plain(value)
        return {k: box if k == "bbox" and (box := bbox_of(v)) is not None else boxed(v) for k, v in value.items() if v is not None}

    def entry_of(entry: object) -> object:
        out = boxed(entry)
        if isinstance(out, dict):
            regions = _as_list(out.pop("diagram_regions", None))
            return out | ({"diagram_regions": regions} if regions else {})
        return out

    pages = []
    for page in found[0]:
        if page is None or not isinstance(page, (dict, list)):
            pages.append(_plain(page))
            continue
        entries, name = _page_parts(page)
        own = {} if isinstance(page, list) else {k: boxed(v) for k, v in page.items() if v is not None and k != name}
        pages.append(own | {"entries": [entry_of(e) for e in _as_list(entries)]})
    return _canonical(boxed(found[1]) | {"pages": pages})


def _placed(root: object, path: str, value: object, objects: set[str]) -> None:
    """Puts ``value`` where ``path`` leads from ``root``; steps below a path that is no object's are places in a list."""
    steps, here, at = path.split("/")[1:], root, ""
    for k, step in enumerate(steps):
        name = step.replace("~1", "/").replace("~0", "~")
        inside_object = at == "" or at in objects
        at = f"{at}/{step}"
        key = name if inside_object else int(name)
        if not inside_object:
            here.extend([None] * (key + 1 - len(here)))
        if k + 1 == len(steps):
            here[key] = value
        else:
            if not inside_object and here[key] is None or inside_object and key not in here:
                here[key] = []
            here = here[key]


def _together(rows: list[dict]) -> str:
    """The canonical layout of one document's bridge rows with their payloads."""
    def place(r: dict) -> tuple:
        return tuple(-1 if r[c] is None else r[c] for c in ("page_pos", "entry_idx", "region_idx"))

    mains = {place(r): None if r["object_id"] is None else _decode(r["payload"]) for r in rows if r["kind"] != "part"}
    parts = [r for r in rows if r["kind"] == "part"]
    objects: dict[tuple, set[str]] = {}
    for r in parts:
        if r["object_id"] is not None and r["payload"].startswith("{"):
            objects.setdefault(place(r), set()).add(r["path"])
    pointer = lambda r: [(0, int(s), "") if s.isdigit() else (1, 0, s) for s in r["path"].split("/")]
    for r in sorted(parts, key=pointer):
        _placed(mains[place(r)], r["path"], None if r["object_id"] is None else _decode(r["payload"]), objects.get(place(r), set()))
    document = mains[(-1, -1, -1)] | {"pages": []}
    for at in sorted(mains):
        value, (page, entry, region) = mains[at], at
        if page < 0:
            continue
        if entry < 0:
            document["pages"].append(value | {"entries": []} if isinstance(value, dict) else value)
        elif region < 0:
            document["pages"][page]["entries"].append(value)
        else:
            document["pages"][page]["entries"][entry].setdefault("diagram_regions", []).append(value)
    return _canonical(document)


def rebuilt(bridge: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id and its layout in canonical notation, from the bridge's places and the objects stored once. A document is one group; repeated doc_ids must have equal layouts."""
    places = bridge.select(*(c for c in OCCURRENCE.names if c not in ("payload", "style", "parent_id")))
    rows = places.join(stored.select("object_id", "payload"), "object_id", "left")

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "layout": pa.array([_together(table.to_pylist())])})

    return rows.groupBy("doc_id").applyInArrow(run, "doc_id long, layout string")


def occurrences(documents: DataFrame, payload: bool = True, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One bridge row for every place of every object in ``documents(doc_id, layout)``; other columns are not read.

    ``object_id`` is null where a list holds a null. Without ``payload`` the
    objects' own fields are left out of the rows; ``kinds`` names the kinds
    whose rows are given.
    """
    width = len(OCCURRENCE) if payload else len(OCCURRENCE) - 2
    schema, arrow = T.StructType(OCCURRENCE.fields[:width]), pa.schema(list(ARROW)[:width])
    every = set(kinds) == set(KINDS)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.extend(r for r in subtree_rows(doc_id, text.as_py()) if every or r[1] in kinds)
                if len(rows) >= 20_000:
                    yield _batch(rows, arrow, width)
                    rows = []
        if rows:
            yield _batch(rows, arrow, width)

    slim = documents.select(F.col("doc_id").cast("long"), F.col("layout").cast("string")).where(F.length("layout") > 0)
    return slim.mapInArrow(expand, schema)


def _batch(rows: list[tuple], schema: pa.Schema, width: int) -> pa.RecordBatch:
    columns = list(zip(*rows))[:width]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def found(documents: DataFrame) -> DataFrame:
    """doc_id, page_index, entry_idx, region_idx of every entry (region -1) and every region that is not null."""
    bridge = occurrences(documents, payload=False, kinds=("entry", "region"))
    return bridge.where(F.col("object_id").isNotNull()).select(
        "doc_id", "page_index", "entry_idx", "region_idx"
    )


def objects(bridge: DataFrame) -> DataFrame:
    """Each different object once, with its own fields and the number of its places."""
    return (
        bridge.where(F.col("object_id").isNotNull())
        .groupBy("object_id", "kind")
        .agg(F.min("payload").alias("payload"), F.count(F.lit(1)).alias("places"))
    )


def _json(name: str, column: str = "payload") -> Column:
    return F.get_json_object(column, f"$.{name}")


def flat_tables(bridge: DataFrame) -> dict[str, DataFrame]:
    """documents, pages, entries, regions and parts as flat tables; each row names its place, its parent and its object.

    ``fields`` holds all of an object's own fields, those with a column of
    their own as well; what is nested below it has rows of the other tables.
    """
    here = bridge.where(F.col("object_id").isNotNull())
    box = F.from_json(_json("bbox"), "array<double>")
    # A damaged box of fewer than four numbers has nulls for what it lacks.
    placed = [F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    ids = ["parent_id", "object_id"]
    styled = [
        _json("font", "style").alias("style_font"), _json("size", "style").try_cast("double").alias("style_size"),
        _json("bold", "style").try_cast("boolean").alias("style_bold"), _json("italic", "style").try_cast("boolean").alias("style_italic"),
    ]
    fields = F.col("payload").alias("fields")
    return {
        "documents": here.where("kind = 'document'").select("doc_id", "object_id", fields),
        "pages": here.where("kind = 'page'").select(
            "doc_id", "page_pos", "page_index", *ids,
            _json("page_width_pt").try_cast("double").alias("page_width_pt"),
            _json("page_height_pt").try_cast("double").alias("page_height_pt"),
            _json("zoom").try_cast("double").alias("zoom"), fields,
        ),
        "entries": here.where("kind = 'entry'").select(
            "doc_id", "page_pos", "page_index", "entry_idx", *ids, *placed,
            _json("category").alias("category"), _json("text").alias("text"), _json("source").alias("source"),
            _json("rotation").try_cast("double").alias("rotation"), _json("image_key").alias("image_key"), *styled, fields,
        ),
        "regions": here.where("kind = 'region'").select(
            "doc_id", "page_pos", "page_index", "entry_idx", "region_idx", *ids, *placed, _json("text").alias("text"), *styled[:2], fields,
        ),
        "parts": here.where("kind = 'part'").select("doc_id", "page_pos", "page_index", "entry_idx", "region_idx", "path", *ids, *placed, _json("text").alias("text"), fields),
    }

"""Flattening of nested page layouts into related tables, on Arrow buffers.

A batch of layouts is never walked row by row: the offsets of each list column give, by a parent-index kernel, the row every
element belongs to; the elements themselves are the child buffer; and the keys of the parents reach the children by a take with
those indices. Only layouts that are delivered as JSON text have to be parsed first, each payload once, into the same nested
Arrow type; from there on they take the same kernels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = pa.struct([("text", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("alternatives", pa.list_(pa.string()))])
READ = pa.struct([("verbatim_text", pa.string()), ("confidence", pa.float64()), ("uncertain_spans", pa.list_(SPAN))])
REGION = {
    "id": pa.string(), "type": pa.string(), "article_id": pa.string(), "parent_id": pa.string(), "reading_order": pa.int32(),
    "polygon": pa.list_(pa.list_(pa.float64())), "text": pa.string(), "confidence": pa.float64(), "needs_enhancement": pa.bool_(), "read_a": READ,
}
ARTICLE = {"id": pa.string(), "region_ids": pa.list_(pa.string()), "reading_order": pa.int32()}
_WHOLE = re.compile(r"[+-]?\d{1,9}(\.0*)?")


def _no_constant(name: str) -> float:
    raise ValueError(name)


def _number(x: object) -> float | None:
    try:
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    except OverflowError:
        return None


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None if x is None or isinstance(x, (bool, list, dict)) else str(x)


def _order(x: object) -> int | None:
    """A whole number, given as number or text."""
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        return None
    x = str(x).strip()
    return int(x.split(".")[0]) if _WHOLE.fullmatch(x) else None


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _point(x: object) -> list[float | None] | None:
    if isinstance(x, dict):
        return [_number(x.get("x")), _number(x.get("y"))]
    return [_number(v) for v in x] if isinstance(x, list) else None


def _read(x: object) -> dict | None:
    if not isinstance(x, dict):
        return None
    spans = [
        {"text": _text(s.get("text")), "start_offset": _order(s.get("start_offset")), "end_offset": _order(s.get("end_offset")), "alternatives": [_text(a) for a in _list(s.get("alternatives"))]}
        if isinstance(s, dict) else None
        for s in _list(x.get("uncertain_spans"))
    ]
    return {"verbatim_text": _text(x.get("verbatim_text")), "confidence": _number(x.get("confidence")), "uncertain_spans": spans}


def _region(x: object, fields: list[str]) -> dict | None:
    if isinstance(x, dict) and isinstance(x.get("region"), dict):
        x = x["region"]
    if not isinstance(x, dict):
        return None
    made = {}
    for f in fields:
        v = x.get(f)
        if f == "polygon":
            corners = v if isinstance(v, list) else x.get("points")
            made[f] = [_point(p) for p in corners] if isinstance(corners, list) else None
        elif f == "reading_order":
            made[f] = _order(v)
        elif f == "confidence":
            made[f] = _number(v)
        elif f == "needs_enhancement":
            made[f] = v if isinstance(v, bool) else None
        elif f == "read_a":
            made[f] = _read(v)
        else:
            made[f] = _text(v)
    return made


def parse_payload(text: str | None) -> dict | None:
    """The page document of a payload: the document itself, or that of its pages, whose regions and articles follow one another where there are several; None where it isn't complete JSON."""
    try:
        found = json.loads(text, parse_constant=_no_constant) if text else None
    except (ValueError, RecursionError):
        return None
    if isinstance(found, dict) and isinstance(found.get("pages"), list):
        pages = [p for p in found["pages"] if isinstance(p, dict)]
        if len(pages) < 2:
            return next(iter(pages), None)
        return {k: [x for p in pages for x in _list(p.get(k))] for k in ("regions", "articles")}
    return found if isinstance(found, dict) else None


def _articles(doc: dict) -> list[dict | None]:
    return [
        {"id": _text(a.get("id")), "region_ids": [_text(r) for r in _list(a.get("region_ids"))], "reading_order": _order(a.get("reading_order"))} if isinstance(a, dict) else None
        for a in _list(doc.get("articles"))
    ]


def children(lists: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of a list array: the elements, the index of each one's parent, and its position in it from 0. Null lists have none."""
    parents = pc.list_parent_indices(lists)
    at = parents.to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), parents, np.arange(len(at)) - np.searchsorted(at, at)


def _column(struct: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(struct, name)


def _clean(ids: pa.Array) -> pa.Array:
    return pc.fill_null(pc.utf8_trim_whitespace(ids), "")


def _corners(keys: list[pa.Array], regions: pa.Array) -> list[pa.Array]:
    region, row, pos = children(regions)
    polygon = _column(region, "polygon")
    point, of, point_pos = children(polygon)
    two = pc.fill_null(pc.equal(pc.list_value_length(point), 2), False)
    point, of, point_pos = point.filter(two), of.filter(two), point_pos[two.to_numpy(zero_copy_only=False)]
    xy = pc.list_flatten(point)
    real = np.isfinite(xy.to_numpy(zero_copy_only=False).astype("float64")).reshape(-1, 2).all(axis=1)
    xy, of, point_pos = xy.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, 2)[real], of.filter(pa.array(real)), point_pos[real]
    up = row.take(of)
    return [
        *[k.take(up) for k in keys], pa.array(pos[of.to_numpy(zero_copy_only=False)], pa.int32()), _clean(_column(region, "article_id")).take(of),
        pc.fill_null(_column(region, "reading_order"), -1).take(of), pa.array(point_pos, pa.int32()), pa.array(xy[:, 0]), pa.array(xy[:, 1]),
    ]


def _regions(keys: list[pa.Array], regions: pa.Array) -> list[pa.Array]:
    region, row, pos = children(regions)
    there = region.is_valid()
    plain = [_column(region, f) for f in ("id", "type", "parent_id", "text", "confidence", "needs_enhancement")]
    read = _column(region, "read_a")
    made = [
        *[k.take(row) for k in keys], pa.array(pos, pa.int32()), *plain, _clean(_column(region, "article_id")), pc.fill_null(_column(region, "reading_order"), -1),
        pc.fill_null(pc.list_value_length(_column(region, "polygon")), 0), _column(read, "verbatim_text"), _column(read, "confidence"),
    ]
    return [m.filter(there) for m in made]


def _spans(keys: list[pa.Array], regions: pa.Array) -> list[pa.Array]:
    region, row, pos = children(regions)
    span, of, span_pos = children(_column(_column(region, "read_a"), "uncertain_spans"))
    up = row.take(of)
    made = [
        *[k.take(up) for k in keys], pa.array(pos[of.to_numpy(zero_copy_only=False)], pa.int32()), _column(region, "id").take(of), pa.array(span_pos, pa.int32()),
        *[_column(span, f) for f in ("text", "start_offset", "end_offset")], pc.fill_null(pc.list_value_length(_column(span, "alternatives")), 0),
    ]
    return [m.filter(span.is_valid()) for m in made]


def _members(keys: list[pa.Array], articles: pa.Array) -> list[pa.Array]:
    article, row, pos = children(articles)
    made = [
        *[k.take(row) for k in keys], pa.array(pos, pa.int32()), _clean(_column(article, "id")), pc.fill_null(_column(article, "reading_order"), -1),
        pc.fill_null(pc.list_value_length(_column(article, "region_ids")), 0),
    ]
    return [m.filter(article.is_valid()) for m in made]


def _links(keys: list[pa.Array], articles: pa.Array) -> list[pa.Array]:
    article, row, pos = children(articles)
    region, of, link_pos = children(_column(article, "region_ids"))
    up = row.take(of)
    made = [*[k.take(up) for k in keys], pa.array(pos[of.to_numpy(zero_copy_only=False)], pa.int32()), _clean(_column(article, "id")).take(of), pa.array(link_pos, pa.int32()), region]
    return [m.filter(region.is_valid()) for m in made]


def _alternatives(keys: list[pa.Array], regions: pa.Array) -> list[pa.Array]:
    region, row, pos = children(regions)
    span, of, span_pos = children(_column(_column(region, "read_a"), "uncertain_spans"))
    alternative, span_of, alternative_pos = children(_column(span, "alternatives"))
    region_of = of.take(span_of)
    up, at = row.take(region_of), span_of.to_numpy(zero_copy_only=False)
    made = [
        *[k.take(up) for k in keys], pa.array(pos[region_of.to_numpy(zero_copy_only=False)], pa.int32()), pa.array(span_pos[at], pa.int32()),
        pa.array(alternative_pos, pa.int32()), alternative,
    ]
    return [m.filter(alternative.is_valid()) for m in made]


#: Of each table: the list it comes from, the fields it needs, its kernel, and its columns after the keys.
TABLES: dict[str, tuple[str, list[str], Callable, str]] = {
    "corners": ("regions", ["article_id", "reading_order", "polygon"], _corners, "region_pos int, article_id string, reading_order int, point_pos int, x double, y double"),
    "regions": ("regions", list(REGION), _regions, "region_pos int, region_id string, type string, parent_id string, text string, confidence double, needs_enhancement boolean, article_id string, reading_order int, n_points int, read_text string, read_confidence double"),
    "spans": ("regions", ["id", "read_a"], _spans, "region_pos int, region_id string, span_pos int, text string, start_offset int, end_offset int, n_alternatives int"),
    "articles": ("articles", list(ARTICLE), _members, "article_pos int, article_id string, reading_order int, n_regions int"),
    "links": ("articles", ["id", "region_ids"], _links, "article_pos int, article_id string, link_pos int, region_id string"),
    "alternatives": ("regions", ["read_a"], _alternatives, "region_pos int, span_pos int, alternative_pos int, alternative string"),
}


def _flatten(table: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    source, fields, kernel, _ = TABLES[table]
    types = REGION if source == "regions" else ARTICLE
    kind = pa.list_(pa.struct([(f, types[f]) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, typed, payload = batch.columns[:2], batch.column(2), batch.column(3)
            yield pa.RecordBatch.from_arrays(kernel(keys, typed), names)
            given = payload.is_valid()
            if pc.any(given).as_py():
                docs = [parse_payload(p) for p in payload.filter(given).to_pylist()]
                nested = [None if d is None else [a and {f: a[f] for f in fields} for a in _articles(d)] if source == "articles" else [_region(r, fields) for r in _list(d.get("regions"))] for d in docs]
                yield pa.RecordBatch.from_arrays(kernel([k.filter(given) for k in keys], pa.array(nested, kind)), names)

    return run


def flatten_layouts(layouts: DataFrame, table: str) -> DataFrame:
    """One of the flat tables of page layouts: corners, regions, spans, alternatives (of spans), articles or links (of articles to regions), each row with the keys of its parents.

    Every row has layout_id and page_id, then positions in the lists above it, from 0; null and bad elements count for positions
    but give no rows. A corner needs a point of exactly two finite numbers. article_id is trimmed, and '' when null, absent or
    blank; reading_order is -1 when null, absent or not a whole number. Where regions and articles are null, payload_json is
    read instead; one that isn't complete JSON gives no rows. Identical deliveries count once; a null layout_id is kept; an
    empty table gives none; other columns are not read. Only the fields a table needs are read from the file.
    """
    source, fields, _, columns = TABLES[table]
    typed = F.col(source) if fields in (list(REGION), list(ARTICLE)) else F.arrays_zip(*[F.col(f"{source}.{f}").alias(f) for f in fields])
    payload = F.when(F.col("regions").isNull() & F.col("articles").isNull(), F.col("payload_json"))
    kept = layouts.select("layout_id", "page_id", typed.alias("__typed"), payload.alias("__payload"))
    schema = f"layout_id {layouts.schema['layout_id'].dataType.simpleString()}, page_id string, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    return kept.mapInArrow(_flatten(table, names), schema).distinct()


def _parse(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [parse_payload(p) for p in batch.column(2).to_pylist()]
            there = pa.array([d is not None for d in docs])
            regions = [[_region(r, list(REGION)) for r in _list(d.get("regions"))] for d in docs if d is not None]
            articles = [_articles(d) for d in docs if d is not None]
            kept = [c.filter(there) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(regions, schema.field(0).type), pa.array(articles, schema.field(1).type)], ["layout_id", "page_id", "regions", "articles"])

    return run


def whole_layouts(layouts: DataFrame) -> DataFrame:
    """(layout_id, page_id, regions, articles) of all layouts in the type of the typed ones: where regions and articles are null, payload_json is read, as flatten_layouts does. Identical deliveries count once."""
    absent = F.col("regions").isNull() & F.col("articles").isNull()
    names = ["layout_id", "page_id", "regions", "articles"]
    types = pa.schema([("regions", pa.list_(pa.struct(list(REGION.items())))), ("articles", pa.list_(pa.struct(list(ARTICLE.items()))))])
    given = layouts.where(absent & F.col("payload_json").isNotNull()).select("layout_id", "page_id", "payload_json").distinct()
    typed = layouts.where(~absent).select(*names)
    return typed.unionByName(given.mapInArrow(_parse(types), ", ".join(f"{n} {layouts.schema[n].dataType.simpleString()}" for n in names))).distinct()


def layout_pages(layouts: DataFrame) -> DataFrame:
    """One row for each layout: its keys and the properties of the page, with the number of its regions; payloads are read like the rest."""
    regions = flatten_layouts(layouts, "regions").groupBy("layout_id").agg(F.count("*").alias("n_regions"))
    plain = layouts.select(
        "layout_id", "page_id", "driver", "coordinate_system", "saved_at",
        *[F.coalesce(F.col(c), F.get_json_object("payload_json", f"$.{c}"), F.get_json_object("payload_json", f"$.pages[0].{c}")).alias(c) for c in ("page_type", "lang")],
        F.coalesce(F.col("file_name"), F.get_json_object("payload_json", "$.file")).alias("file_name"),
    ).distinct()
    return plain.join(regions, plain.layout_id.eqNullSafe(regions.layout_id), "left").select(plain["*"], F.coalesce("n_regions", F.lit(0)).alias("n_regions"))

"""Queries of the core operators on nested layouts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.operators import nested
from folio.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "corners")
    return corners.select("layout_id", "region_pos", "article_id", "reading_order", "point_pos").distinct()


def p1_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "corners")


def p1_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.layout_pages(read(spark, sf_dir, "manual_layouts"))


def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "regions")


def p1_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "articles")


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "spans")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "links")


def p1_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_layouts(read(spark, sf_dir, "manual_layouts"), "alternatives")


#: Regions of either kind, with the number at which each stands.
_REGIONS = """
WITH doc AS (
  SELECT layout_id, CASE WHEN json_valid(payload_json) THEN CAST(payload_json AS JSON) END AS whole
  FROM manual_layouts WHERE regions IS NULL AND articles IS NULL),
page AS (SELECT layout_id, coalesce(whole -> '$.pages[0]', whole) AS page FROM doc WHERE whole IS NOT NULL),
listed AS (SELECT layout_id, CAST(page -> '$.regions' AS JSON[]) AS regions FROM page),
item AS (SELECT layout_id, unnest(regions) AS outer_region, unnest(range(len(regions))) AS region_pos FROM listed),
region_doc AS (SELECT layout_id, region_pos, coalesce(outer_region -> '$.region', outer_region) AS region FROM item),
"""
_P1_FOUND = (
    _REGIONS
    + """
json_points AS (
  SELECT layout_id, region_pos, region, CAST(coalesce(nullif(region -> '$.polygon', 'null'), region -> '$.points') AS JSON[]) AS points FROM region_doc
  WHERE json_type(coalesce(nullif(region -> '$.polygon', 'null'), region -> '$.points')) = 'ARRAY'),
json_corner AS (SELECT layout_id, region_pos, region, unnest(points) AS p, unnest(range(len(points))) AS point_pos FROM json_points),
typed AS (SELECT layout_id, unnest(regions) AS region, unnest(range(len(regions))) AS region_pos FROM manual_layouts WHERE regions IS NOT NULL),
typed_corner AS (
  SELECT layout_id, region_pos, region.article_id AS article_id, region.reading_order AS reading_order, unnest(region.polygon) AS p,
    unnest(range(len(region.polygon))) AS point_pos FROM typed WHERE region.polygon IS NOT NULL)
SELECT DISTINCT layout_id, CAST(region_pos AS INTEGER) AS region_pos, coalesce(trim(region ->> '$.article_id'), '') AS article_id,
  CASE WHEN regexp_full_match(trim(region ->> '$.reading_order'), '[+-]?[0-9]{1,9}([.]0*)?') THEN CAST(CAST(trim(region ->> '$.reading_order') AS DOUBLE) AS INTEGER) ELSE -1 END AS reading_order,
  CAST(point_pos AS INTEGER) AS point_pos
FROM json_corner
WHERE json_type(p) = 'ARRAY' AND json_array_length(p) = 2 AND json_type(p, '$[0]') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND json_type(p, '$[1]') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
   OR json_type(p) = 'OBJECT' AND json_type(p, '$.x') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND json_type(p, '$.y') IN ('DOUBLE', 'UBIGINT', 'BIGINT')
UNION
SELECT DISTINCT layout_id, CAST(region_pos AS INTEGER), coalesce(trim(article_id), ''), coalesce(reading_order, -1), CAST(point_pos AS INTEGER)
FROM typed_corner WHERE len(p) = 2 AND isfinite(p[1]) AND isfinite(p[2])
"""
)
_P1_SPANS = (
    _REGIONS
    + """
span_doc AS (SELECT layout_id, region_pos, region ->> '$.id' AS region_id, CAST(region -> '$.read_a.uncertain_spans' AS JSON[]) AS spans FROM region_doc),
span_item AS (SELECT layout_id, region_pos, region_id, unnest(spans) AS s, unnest(range(len(spans))) AS span_pos FROM span_doc),
typed AS (SELECT layout_id, unnest(regions) AS region, unnest(range(len(regions))) AS region_pos FROM manual_layouts WHERE regions IS NOT NULL),
typed_span AS (SELECT layout_id, region_pos, region.id AS region_id, unnest(region.read_a.uncertain_spans) AS s, unnest(range(len(region.read_a.uncertain_spans))) AS span_pos FROM typed),
both_kinds AS (
  SELECT layout_id, region_pos, region_id, span_pos, s ->> '$.text' AS text, CAST(s ->> '$.start_offset' AS INTEGER) AS start_offset,
    CAST(s ->> '$.end_offset' AS INTEGER) AS end_offset, coalesce(json_array_length(s -> '$.alternatives'), 0) AS n_alternatives
  FROM span_item WHERE json_type(s) = 'OBJECT'
  UNION
  SELECT layout_id, region_pos, region_id, span_pos, s.text, s.start_offset, s.end_offset, coalesce(len(s.alternatives), 0) FROM typed_span WHERE s IS NOT NULL)
SELECT DISTINCT b.layout_id, m.page_id, CAST(region_pos AS INTEGER) AS region_pos, region_id, CAST(span_pos AS INTEGER) AS span_pos, text, start_offset, end_offset,
  CAST(n_alternatives AS INTEGER) AS n_alternatives
FROM both_kinds b JOIN (SELECT DISTINCT layout_id, page_id FROM manual_layouts) m USING (layout_id)
"""
)

#: The same with coordinates and the page.
_P1_CORNERS = (
    "SELECT f.*, m.page_id FROM ("
    + _P1_FOUND.replace("AS point_pos\nFROM json_corner", "AS point_pos, CAST(coalesce(p ->> '$[0]', p ->> '$.x') AS DOUBLE) AS x, CAST(coalesce(p ->> '$[1]', p ->> '$.y') AS DOUBLE) AS y\nFROM json_corner").replace(
        "CAST(point_pos AS INTEGER)\nFROM typed_corner", "CAST(point_pos AS INTEGER), p[1], p[2]\nFROM typed_corner"
    )
    + ") f JOIN (SELECT DISTINCT layout_id, page_id FROM manual_layouts) m USING (layout_id)"
)
_P1_ARTICLES = (
    _REGIONS
    + """
members AS (SELECT layout_id, CAST(page -> '$.articles' AS JSON[]) AS articles FROM page),
article_doc AS (SELECT layout_id, unnest(articles) AS a, unnest(range(len(articles))) AS article_pos FROM members),
typed AS (SELECT layout_id, unnest(articles) AS a, unnest(range(len(articles))) AS article_pos FROM manual_layouts WHERE articles IS NOT NULL),
both_kinds AS (
  SELECT layout_id, article_pos, coalesce(trim(a ->> '$.id'), '') AS article_id,
    CASE WHEN regexp_full_match(trim(a ->> '$.reading_order'), '[+-]?[0-9]{1,9}([.]0*)?') THEN CAST(CAST(trim(a ->> '$.reading_order') AS DOUBLE) AS INTEGER) ELSE -1 END AS reading_order,
    CASE WHEN json_type(a -> '$.region_ids') = 'ARRAY' THEN json_array_length(a -> '$.region_ids') ELSE 0 END AS n_regions
  FROM article_doc WHERE json_type(a) = 'OBJECT'
  UNION
  SELECT layout_id, article_pos, coalesce(trim(a.id), ''), coalesce(a.reading_order, -1), coalesce(len(a.region_ids), 0) FROM typed WHERE a IS NOT NULL)
SELECT DISTINCT b.layout_id, m.page_id, CAST(article_pos AS INTEGER) AS article_pos, article_id, reading_order, CAST(n_regions AS INTEGER) AS n_regions
FROM both_kinds b JOIN (SELECT DISTINCT layout_id, page_id FROM manual_layouts) m USING (layout_id)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_corners, p1_layouts, p1_regions, p1_articles, p1_spans, p1_links, p1_alternatives)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1_FOUND, "p1_corners": _P1_CORNERS, "p1_articles": _P1_ARTICLES, "p1_spans": _P1_SPANS}

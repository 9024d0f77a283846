"""Queries of plans, drafts, spans and small helpers held against the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import geometry, text
from folio.operators import layout, reads
from folio.plans.queries import _BOX, _LINE_END, _SPACE, _TYPED, _boxed, _layouts, _regions, query
from folio.session import read

# Plans and drafts ------------------------------------------------------------------------------------------------------------

_PLAN = (
    f"WITH {_TYPED}, h AS (SELECT layout_id AS page_id, id, article_id, reading_order, polygon FROM r WHERE type = 'headline'), "
    "p AS (SELECT layout_id AS page_id, id, reading_order, coalesce(len(region_ids), 0) AS n, region_ids AS heading_ids, coalesce(len(region_ids), 0) % 3 AS columns FROM a), "
    "g AS (SELECT layout_id AS page_id, id, article_id, CASE WHEN type = 'headline' THEN id END AS heading_id, reading_order % 3 + 1 AS column_index FROM r), "
    "placed AS (SELECT page_id, heading_id AS id, count(*) AS n, min(article_id) AS owner FROM g WHERE heading_id IS NOT NULL GROUP BY ALL), "
    "cols AS (SELECT page_id, article_id AS id, list_sort(list(DISTINCT column_index)) AS found FROM g WHERE column_index IS NOT NULL AND article_id IS NOT NULL GROUP BY ALL), "
    "named AS (SELECT page_id, unnest(heading_ids) AS id FROM p) "
)


def _twice(table: str, key: str, rule: str) -> str:
    return f"SELECT page_id, '{rule}' AS rule, CAST({key} AS VARCHAR) AS key FROM {table} WHERE {key} IS NOT NULL GROUP BY page_id, {key} HAVING count(*) > 1 "


@query(
    _PLAN
    + "UNION ".join(
        (
            _twice("h", "id", "duplicate_heading_id"), _twice("p", "id", "duplicate_article_id"), _twice("h", "reading_order", "duplicate_heading_order"), _twice("p", "reading_order", "duplicate_article_order"),
            "SELECT page_id, 'unknown_article', article_id FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = h.page_id AND p.id = h.article_id) ",
            "SELECT page_id, 'heading_not_four_corners', id FROM h WHERE coalesce(len(polygon), -1) <> 4 ",
            "SELECT page_id, 'envelope_too_small', id FROM p WHERE n < 3 ",
            "SELECT page_id, 'unknown_heading', id FROM named n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = n.page_id AND h.id = n.id) ",
            "SELECT page_id, 'article_without_region', id FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.page_id = p.page_id AND g.article_id = p.id) ",
            "SELECT h.page_id, 'heading_without_region', h.id FROM h LEFT JOIN placed USING (page_id, id) WHERE n IS NULL ",
            "SELECT h.page_id, 'heading_with_several_regions', h.id FROM h JOIN placed USING (page_id, id) WHERE n > 1 ",
            "SELECT h.page_id, 'heading_of_other_article', h.id FROM h JOIN placed USING (page_id, id) WHERE n = 1 AND owner IS DISTINCT FROM article_id ",
            "SELECT p.page_id, 'column_indices', p.id FROM p LEFT JOIN cols USING (page_id, id) WHERE columns > 0 AND found IS DISTINCT FROM [x::INTEGER FOR x IN range(1, columns + 1)] ",
        )
    )
)
def plan_reconcile(spark, sf_dir):
    """Layouts as plans: headlines as headings, the regions of an article as its headings and envelope."""
    regions, articles = layout.exploded(_layouts(spark, sf_dir))
    r = regions.select(F.col("layout_id").alias("page_id"), "r.id", "r.article_id", "r.type", "r.reading_order", "r.polygon")
    headings = r.where("type = 'headline'").drop("type")
    n = F.coalesce(F.size("a.region_ids"), F.lit(0))
    plans = articles.select(F.col("layout_id").alias("page_id"), "a.id", "a.reading_order", F.col("a.region_ids").alias("polygon"), F.col("a.region_ids").alias("heading_ids"), (n % 3).alias("columns"))
    placed = r.select("page_id", "id", "article_id", F.when(F.col("type") == "headline", F.col("id")).alias("heading_id"), (F.col("reading_order") % 3 + 1).alias("column_index"))
    return reads.plan_violations(headings, plans, placed)


@query(
    f"WITH {_TYPED}, b AS (SELECT layout_id, list(id ORDER BY pos) AS ids, bool_and(coalesce(confidence > 0.3, true)) AS sure, count(*) FILTER (text IS NULL OR text = '') AS empty FROM r GROUP BY layout_id), "
    "c AS (SELECT layout_id, list(id) AS checked FROM (SELECT layout_id, unnest(region_ids) AS id FROM a) GROUP BY layout_id) "
    "SELECT b.layout_id FROM b LEFT JOIN c USING (layout_id) WHERE empty <= 4 AND sure AND (b.layout_id % 4 < 3 OR coalesce(len(checked) = len(list_distinct(ids)) AND list_sort(list_distinct(checked)) = list_sort(list_distinct(ids)) AND len(list_filter(checked, lambda x: x IS NULL)) + len(list_filter(ids, lambda x: x IS NULL)) = 0, false))"
)
def accepted_plan_filter(spark, sf_dir):
    """Layouts as plans: their regions as blocks, the regions that their articles name as those that were checked, more than four regions without text as an issue."""
    regions, articles = layout.exploded(_layouts(spark, sf_dir))
    block = F.struct(F.col("r.id").alias("block_id"), F.lit(0.02).alias("font_size_ratio"), F.lit(1.2).alias("line_height"))
    empty = F.count_if(F.coalesce(F.col("r.text"), F.lit("")) == "")
    plans = regions.groupBy("layout_id").agg(
        F.collect_list(block).alias("blocks"), F.bool_and(F.coalesce(F.col("r.confidence") > 0.3, F.lit(True))).alias("sure"), F.when(empty > 4, F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")).alias("issues")
    )
    checked = articles.select("layout_id", F.explode("a.region_ids").alias("id")).groupBy("layout_id").agg(F.collect_list("id").alias("checked_block_ids"))
    return layout.accepted(plans.join(checked, "layout_id", "left").withColumn("schema_version", F.col("layout_id") % 4), ["sure"]).select("layout_id")


_CORNERS_OK = "len(polygon) = 4 AND len(list_filter(polygon, lambda p: p IS NULL OR len(p) <> 2 OR p[1] IS NULL OR p[2] IS NULL OR p[1] < 0 OR p[1] > 1000 OR p[2] < 0 OR p[2] > 1000)) = 0"


@query(
    f"WITH {_TYPED}, b AS (SELECT layout_id, pos, polygon, type = 'headline' AS heading, CASE WHEN pos % 3 > 0 THEN reading_order - 2 END AS s, CASE WHEN pos % 3 > 0 THEN pos END AS e, CASE WHEN pos % 4 = 0 THEN left(text, 3) END AS sq, CASE WHEN pos % 4 = 0 THEN right(text, 3) END AS eq FROM r), "
    "c AS (SELECT *, s IS NOT NULL OR e IS NOT NULL AS lines, sq IS NOT NULL OR eq IS NOT NULL AS quotes FROM b) "
    f"SELECT layout_id, CAST(pos AS INTEGER) AS pos, list_filter([CASE WHEN NOT coalesce({_CORNERS_OK}, false) THEN 'polygon' END, CASE WHEN heading AND (lines OR quotes) THEN 'heading_selects_text' END, CASE WHEN NOT heading AND lines = quotes THEN 'one_selector' END, "
    "CASE WHEN NOT heading AND lines <> quotes AND lines AND NOT coalesce(s >= 0 AND e >= s, false) THEN 'line_range' END, CASE WHEN NOT heading AND lines <> quotes AND quotes AND NOT coalesce(sq <> '' AND eq <> '', false) THEN 'quotes' END], lambda x: x IS NOT NULL) AS errors FROM c"
)
def draft_errors(spark, sf_dir):
    """Regions as drafted blocks: some select by lines, some by quotes, some by both or neither."""
    r = _regions(spark, sf_dir).select("layout_id", "pos", "r.type", "r.text", "r.reading_order", "r.polygon")
    by_line, by_quote = F.col("pos") % 3 > 0, F.col("pos") % 4 == 0
    errors = reads.draft_errors(
        F.when(F.col("type") == "headline", F.lit("heading")).otherwise(F.col("type")), F.when(by_line, F.col("reading_order") - 2), F.when(by_line, F.col("pos")), F.when(by_quote, F.left("text", F.lit(3))), F.when(by_quote, F.right("text", F.lit(3))), F.col("polygon")
    )
    return r.select("layout_id", "pos", errors.alias("errors"))


@query(
    "WITH c AS (SELECT article_id, reader, count(*) AS changes FROM article_input WHERE reader = 'A' GROUP BY ALL), d AS (SELECT article_id, 'A' AS reader, count(*) AS decisions FROM article_input WHERE reader = 'B' GROUP BY ALL) "
    "SELECT article_id, reader, coalesce(changes, 0) AS changes, coalesce(decisions, 0) AS decisions FROM c FULL JOIN d USING (article_id, reader) WHERE changes IS NULL OR decisions IS NULL OR changes > 1 OR decisions > 1"
)
def undecided_changes(spark, sf_dir):
    """Reads of reader A as changes, those of reader B as the decisions about them."""
    df = read(spark, sf_dir, "article_input")
    return reads.undecided(df.where("reader = 'A'").select("article_id", "reader"), df.where("reader = 'B'").select("article_id", F.lit("A").alias("reader")), ["article_id", "reader"])


@query(
    "SELECT article_id, list_filter([CASE WHEN confidence < 0.985 THEN 'low_coverage' END, CASE WHEN NOT coalesce(article_order > 0, false) THEN 'ordered' END, CASE WHEN NOT coalesce(heading <> '', false) THEN 'named' END], lambda x: x IS NOT NULL) AS failures FROM articles"
)
def audit_failure_list(spark, sf_dir):
    """Articles as layouts: their confidence as coverage, an order and a heading as verdicts."""
    failures = reads.audit_failures(F.col("confidence"), {"ordered": F.col("article_order") > 0, "named": F.col("heading") != ""}, F.array().cast("array<string>"))
    return read(spark, sf_dir, "articles").select("article_id", failures.alias("failures"))


# Spans -----------------------------------------------------------------------------------------------------------------------


@query(
    "WITH b AS (SELECT DISTINCT article_id, start_offset AS b, end_offset AS e FROM passages WHERE start_offset IS NOT NULL AND end_offset IS NOT NULL), t AS (SELECT article_id, normalized_text AS body FROM articles WHERE normalized_text IS NOT NULL), "
    "s AS (SELECT article_id, b, e, body, coalesce(max(e) OVER (PARTITION BY article_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN t USING (article_id)) "
    r"SELECT article_id, 'gap' AS rule FROM s WHERE regexp_replace(substr(body, before + 1, greatest(0, b - before)), '\s+', '', 'g') <> '' UNION SELECT article_id, 'overlap' FROM s WHERE b < before "
    r"UNION SELECT t.article_id, 'incomplete' FROM t LEFT JOIN (SELECT article_id, max(e) AS e FROM b GROUP BY 1) x USING (article_id) WHERE regexp_replace(substr(body, coalesce(e, 0) + 1), '\s+', '', 'g') <> ''"
)
def coverage_sweep(spark, sf_dir):
    """Do the passages of an article cover its text once and in order?"""
    blocks = read(spark, sf_dir, "passages").where("start_offset is not null and end_offset is not null").select("article_id", F.col("start_offset").alias("begin"), F.col("end_offset").alias("end")).distinct()
    return layout.coverage(blocks, read(spark, sf_dir, "articles").where("normalized_text is not null").select("article_id", F.col("normalized_text").alias("body")))


@query(
    "WITH q AS (SELECT article_id, verbatim_text AS t, substr(verbatim_text, 11, 4) AS s, substr(verbatim_text, 31, 5) AS e FROM articles WHERE length(verbatim_text) >= 40), p AS (SELECT *, instr(t, s) AS b FROM q), "
    "x AS (SELECT *, CASE WHEN e = s THEN b WHEN instr(substr(t, b + length(s)), e) > 0 THEN instr(substr(t, b + length(s)), e) + b + length(s) - 1 ELSE 0 END AS z FROM p) "
    'SELECT article_id, CAST(b - 1 AS INTEGER) AS "begin", CAST(z - 1 + length(e) AS INTEGER) AS "end" FROM x WHERE b > 0 AND z > 0'
)
def quoted_span(spark, sf_dir):
    """From a quote of each text to another one behind it."""
    t = F.col("verbatim_text")
    span = text.quoted_span(t, F.substr(t, F.lit(11), F.lit(4)), F.substr(t, F.lit(31), F.lit(5)))
    found = read(spark, sf_dir, "articles").where(F.length("verbatim_text") >= 40).select("article_id", span.alias("s"))
    return found.where("s is not null").select("article_id", F.col("s.begin").cast("int").alias("begin"), F.col("s.end").cast("int").alias("end"))


@query(f"SELECT article_id, coalesce(array_to_string(regexp_split_to_array(verbatim_text, '{_LINE_END}')[2:3], chr(10)), '') AS lines FROM articles WHERE verbatim_text IS NOT NULL")
def line_range(spark, sf_dir):
    return read(spark, sf_dir, "articles").where("verbatim_text is not null").select("article_id", text.line_range(F.col("verbatim_text"), F.lit(1), F.lit(2)).alias("lines"))


@query(
    "WITH h AS (SELECT page_id, page_number * 137 + 20 AS h FROM pages WHERE page_number IS NOT NULL), s AS (SELECT page_id, h, CAST(floor(h * 0.4) AS INTEGER) AS size, greatest(1, CAST(floor(h * 0.3) AS INTEGER)) AS stride FROM h), "
    "m AS (SELECT page_id, h, size, list_filter(list_transform(range(0, greatest(0, h - size) + 1, stride), lambda x: [x, least(h, x + size)]), lambda b: b[2] - b[1] >= h * 0.2) AS bands FROM s), "
    "f AS (SELECT page_id, CASE WHEN len(bands) > 0 AND bands[-1][2] < h THEN list_append(bands, [greatest(0, h - size), h]) ELSE bands END AS bands FROM m) "
    'SELECT page_id, CAST(n AS INTEGER) AS band_no, CAST(bands[n + 1][1] AS INTEGER) AS "begin", CAST(bands[n + 1][2] AS INTEGER) AS "end" FROM f, LATERAL (SELECT unnest(range(len(bands))) AS n)'
)
def page_bands(spark, sf_dir):
    """Bands down pages whose heights are made from their numbers."""
    pages = read(spark, sf_dir, "pages").where("page_number is not null").select("page_id", (F.col("page_number") * 137 + 20).alias("h"))
    return pages.select("page_id", F.posexplode(reads.bands(F.col("h"), 0.4, 0.3, 0.2)).alias("band_no", "b")).select("page_id", "band_no", F.col("b.begin").cast("int").alias("begin"), F.col("b.end").cast("int").alias("end"))


# Shapes ----------------------------------------------------------------------------------------------------------------------


@query(
    _BOX + " SELECT a.layout_id, CAST(a.pos AS INTEGER) AS pos, CASE WHEN (a.x2 - a.x1) * (a.y2 - a.y1) >= 25 AND (b.x2 - b.x1) * (b.y2 - b.y1) >= 25 THEN greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) "
    "/ greatest(1.0, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))) ELSE 0.0 END AS overlap FROM g a JOIN g b ON a.layout_id = b.layout_id AND b.pos = a.pos + 1"
)
def polygon_overlap(spark, sf_dir):
    """Of the boxes around successive regions of a layout."""
    b = geometry.box(F.col("polygon"))
    r = _boxed(spark, sf_dir).select("layout_id", "pos", geometry.corners(b["x1"], b["y1"], b["x2"], b["y2"]).alias("quad"))
    both = r.join(r.select("layout_id", (F.col("pos") - 1).alias("pos"), F.col("quad").alias("other")), ["layout_id", "pos"])
    valid = geometry.quad_valid(F.col("quad")) & geometry.quad_valid(F.col("other"))
    return both.select("layout_id", "pos", F.when(valid, geometry.overlap_of(F.col("quad"), F.col("other"))).otherwise(F.lit(0.0)).alias("overlap"))


@query(
    "WITH v AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS v FROM embeddings) SELECT vec_id, hex(list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN v[i + i // 8 + 2] > v[i + i // 8 + 1] THEN CAST(1 AS UBIGINT) << CAST(63 - i AS UBIGINT) ELSE CAST(0 AS UBIGINT) END), lambda a, b: a | b)) AS hash FROM v"
)
def difference_hashes(spark, sf_dir):
    """Vectors, and their first numbers again, as the gray values."""
    return read(spark, sf_dir, "embeddings").select("vec_id", geometry.difference_hash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("hash"))


# Small helpers ---------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, CASE WHEN regexp_replace(regexp_replace(source_path, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'article' ELSE regexp_replace(regexp_replace(source_path, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') END AS file_id FROM pages WHERE source_path IS NOT NULL")
def safe_file_ids(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("source_path is not null").select("page_id", text.safe_file_id(F.col("source_path")).alias("file_id"))


@query(r"SELECT doc_id, CASE WHEN try_cast(regexp_extract(text, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE) > 0 AND length(regexp_extract(text, '(\d+)\s*/\s*(\d+)', 1)) <= 9 AND length(regexp_extract(text, '(\d+)\s*/\s*(\d+)', 2)) <= 9 THEN least(1.0, try_cast(regexp_extract(text, '(\d+)\s*/\s*(\d+)', 1) AS DOUBLE) / try_cast(regexp_extract(text, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE)) END AS part FROM documents WHERE text IS NOT NULL")
def first_fraction(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.fraction(F.col("text")).alias("part"))


@query(f"SELECT article_id, regexp_replace(verbatim_text, '{_SPACE}+', '', 'g') = regexp_replace(normalized_text, '{_SPACE}+', '', 'g') AS same FROM articles WHERE verbatim_text IS NOT NULL AND normalized_text IS NOT NULL")
def same_without_space(spark, sf_dir):
    return read(spark, sf_dir, "articles").where("verbatim_text is not null and normalized_text is not null").select("article_id", text.same_without_space(F.col("verbatim_text"), F.col("normalized_text")).alias("same"))


@query("SELECT batch_id, count(DISTINCT event_id) AS events, count(DISTINCT event_id) FILTER (lower(trim(status)) = 'complete') AS complete, count(DISTINCT event_id) FILTER (status IS NULL) AS unknown FROM stage_events GROUP BY batch_id")
def filtered_counts(spark, sf_dir):
    once = read(spark, sf_dir, "stage_events").select("batch_id", "event_id", "status").distinct()
    return once.groupBy("batch_id").agg(F.count("*").alias("events"), F.count_if(F.lower(F.trim("status")) == "complete").alias("complete"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query("SELECT batch_id, event_id, scan_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY received_at NULLS LAST, event_id) AS n FROM (SELECT DISTINCT batch_id, event_id, scan_id, received_at FROM stage_events WHERE lower(trim(status)) IS DISTINCT FROM 'complete')) WHERE n = 1")
def fifo_head(spark, sf_dir):
    """Of each batch the oldest event that isn't complete."""
    waiting = read(spark, sf_dir, "stage_events").where("not (lower(trim(status)) <=> 'complete')").select("batch_id", "event_id", "scan_id", "received_at").distinct()
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.asc_nulls_last("received_at"), "event_id"))
    return waiting.withColumn("n", n).where("n = 1").select("batch_id", "event_id", "scan_id")


@query("SELECT p.page_id, coalesce(list(a.article_id ORDER BY a.article_order NULLS LAST, a.article_id) FILTER (a.article_id IS NOT NULL), []) AS articles FROM pages p LEFT JOIN articles a USING (page_id) GROUP BY p.page_id")
def children_of_parents(spark, sf_dir):
    """The articles of each page in order, fetched by one join."""
    item = F.struct(F.coalesce("article_order", F.lit(2**31 - 1)).alias("o"), "article_id")
    listed = read(spark, sf_dir, "articles").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["article_id"]).alias("articles"))
    return read(spark, sf_dir, "pages").select("page_id").join(listed, "page_id", "left").select("page_id", F.coalesce("articles", F.array().cast("array<string>")).alias("articles"))


@query("SELECT article_id, json_array_length(uncertainties_json) AS n, uncertainties_json ->> '$[0]' AS first, CASE WHEN json_array_length(uncertainties_json) > 2 THEN uncertainties_json ->> '$[2]' END AS third FROM articles WHERE json_valid(uncertainties_json)")
def json_array_access(spark, sf_dir):
    """Items of a JSON array by number, null beyond its end."""
    j = F.col("uncertainties_json")
    return read(spark, sf_dir, "articles").where(F.json_array_length(j).isNotNull()).select("article_id", F.json_array_length(j).cast("bigint").alias("n"), F.get_json_object(j, "$[0]").alias("first"), F.get_json_object(j, "$[2]").alias("third"))


@query(f"WITH {_TYPED}, x AS (SELECT layout_id, list(DISTINCT id) FILTER (id IS NOT NULL) AS have FROM r GROUP BY layout_id), y AS (SELECT layout_id, list(DISTINCT id) FILTER (id IS NOT NULL) AS need FROM m GROUP BY layout_id) "
       "SELECT layout_id, len(list_filter(coalesce(need, []), lambda v: NOT list_contains(coalesce(have, []), v))) = 0 AS contained, CAST(len(list_intersect(coalesce(need, []), coalesce(have, []))) AS INTEGER) AS common FROM y JOIN x USING (layout_id)")  # fmt: skip
def subset_test(spark, sf_dir):
    """Are the regions that a layout's articles name among its regions?"""
    regions, articles = layout.exploded(_layouts(spark, sf_dir))
    have = regions.groupBy("layout_id").agg(F.collect_set("r.id").alias("have"))
    need = articles.select("layout_id", F.explode("a.region_ids").alias("id")).groupBy("layout_id").agg(F.collect_set("id").alias("need"))
    return need.join(have, "layout_id").select("layout_id", (F.size(F.array_except("need", "have")) == 0).alias("contained"), F.size(F.array_intersect("need", "have")).alias("common"))


@query("SELECT publication_code, row_number() OVER (ORDER BY lower(publication), publication_code) AS place FROM publication_hints WHERE publication IS NOT NULL")
def case_folded_order(spark, sf_dir):
    """Publications by name, case ignored; the table has one row for each paper."""
    place = F.row_number().over(Window.orderBy(F.lower("publication"), "publication_code"))
    return read(spark, sf_dir, "publication_hints").where("publication is not null").select("publication_code", place.cast("bigint").alias("place"))

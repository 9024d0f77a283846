import json

import pytest

from folio.operators.nested import flatten_layouts, layout_pages, parse_payload, whole_layouts
from folio.plans import queries

SCHEMA = (
    "layout_id bigint, page_id string, file_name string, driver string, coordinate_system string, page_type string, lang string, regions array<struct<id:string,type:string,article_id:string,parent_id:string,"
    "reading_order:int,polygon:array<array<double>>,text:string,confidence:double,needs_enhancement:boolean,read_a:struct<verbatim_text:string,confidence:double,uncertain_spans:array<struct<text:string,"
    "start_offset:int,end_offset:int,alternatives:array<string>>>>>>, articles array<struct<id:string,region_ids:array<string>,reading_order:int>>, payload_json string, saved_at timestamp"
)


def layout(i, regions=None, articles=None, payload=None, page="p"):
    return (i, page, None, "d", "c", None, None, regions, articles, payload, None)


def region(id="r", article=None, order=None, polygon=None, spans=None):
    read = {"verbatim_text": "t", "confidence": 0.5, "uncertain_spans": spans} if spans is not None else None
    return (id, "body", article, None, order, polygon, None, None, None, read)


@pytest.fixture()
def layouts(spark):
    doc = {"regions": [{"region": {"id": "a", "article_id": " x ", "reading_order": "3", "points": [{"x": 1, "y": 2.5}, {"x": 1}, [1, 2, 3], [True, 1], [5, 6]]}}, None, {"id": "b", "reading_order": "n/a", "polygon": [[1, 2]]}]}
    rows = [
        layout(1, [None, region("r1", " art ", 2, [[1.0, 2.0], None, [1.0], [1.0, None], [3.0, 4.0], [float("nan"), 1.0]]), region("r2", "  ", None, [])], [("art", ["r1"], 1)]),
        layout(1, [None, region("r1", " art ", 2, [[1.0, 2.0], None, [1.0], [1.0, None], [3.0, 4.0], [float("nan"), 1.0]]), region("r2", "  ", None, [])], [("art", ["r1"], 1)]),
        layout(2, payload=json.dumps(doc)), layout(3, payload=json.dumps({"driver": "d", "pages": [doc]})), layout(4, payload=json.dumps(doc)[:-5]),
        layout(5), layout(None, [region("z", "q", 1, [[0.0, 0.0]])], []), layout(6, [region("s", "q", 1, None, [("a", 0, 1, ["b"]), None])], [None, ("", None, None)], payload="{}"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_corners(layouts):
    got = sorted(((r.layout_id or 0), r.region_pos, r.article_id, r.reading_order, r.point_pos, r.x, r.y) for r in flatten_layouts(layouts, "corners").collect())
    json_rows = [(0, "x", 3, 0, 1.0, 2.5), (0, "x", 3, 4, 5.0, 6.0), (2, "", -1, 0, 1.0, 2.0)]
    assert got == sorted([(0, 0, "q", 1, 0, 0.0, 0.0), (1, 1, "art", 2, 0, 1.0, 2.0), (1, 1, "art", 2, 4, 3.0, 4.0), *[(i, *r) for i in (2, 3) for r in json_rows]])


def test_other_tables(layouts):
    regions = {(r.layout_id, r.region_pos, r.region_id, r.n_points) for r in flatten_layouts(layouts, "regions").collect()}
    assert {(1, 1, "r1", 6), (1, 2, "r2", 0), (2, 0, "a", 5), (2, 2, "b", 1), (3, 0, "a", 5)} <= regions and not any(r[0] in (4, 5) for r in regions)
    assert [(r.layout_id, r.span_pos, r.text, r.n_alternatives) for r in flatten_layouts(layouts, "spans").collect()] == [(6, 0, "a", 1)]
    assert sorted((r.layout_id, r.article_pos, r.article_id, r.n_regions) for r in flatten_layouts(layouts, "articles").collect()) == [(1, 0, "art", 1), (6, 1, "", 0)]
    assert {r.layout_id: r.n_regions for r in layout_pages(layouts).collect()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0, None: 1, 6: 1}


def test_empty_and_extra_columns(spark, layouts):
    assert flatten_layouts(layouts.limit(0), "corners").count() == 0
    clash = layouts.selectExpr("*", "1 AS x", "2 AS region_pos", "'k' AS __key")
    assert flatten_layouts(clash, "corners").count() == flatten_layouts(layouts, "corners").count()


def test_links_and_alternatives(spark):
    spans = [None, ("a", 0, 1, ["b", None, "c"]), ("d", 1, 2, None)]
    doc = {"regions": [{"id": "q"}, {"read_a": {"uncertain_spans": [{"text": "a", "alternatives": ["x"]}]}}], "articles": [None, {"id": " k ", "region_ids": ["r9", 3, None]}]}
    rows = [layout(1, [None, region("r1"), region("r2", spans=spans)], [("z", [], 1), None, (" a ", ["r2", None, "gone"], 2), ("n", None, 3)]), layout(2, payload=json.dumps(doc)), layout(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in flatten_layouts(df, "links").collect()) == [(1, "p", 2, "a", 0, "r2"), (1, "p", 2, "a", 2, "gone"), (2, "p", 1, "k", 0, "r9"), (2, "p", 1, "k", 1, "3")]
    assert sorted(tuple(r) for r in flatten_layouts(df, "alternatives").collect()) == [(1, "p", 2, 1, 0, "b"), (1, "p", 2, 1, 2, "c"), (2, "p", 1, 0, 0, "x")]


def test_whole_layouts(spark, layouts, tmp_path):
    got = {r.layout_id: r for r in whole_layouts(layouts).collect()}
    assert set(got) == {1, 2, 3, None, 6} and [r and r.id for r in got[2].regions] == ["a", None, "b"] and got[2].regions[0].reading_order == 3 and len(got[1].regions) == 3
    quad = [[0, 0], [10, 0], [10, 10], [0, 10]]
    doc = {"regions": [{"id": "a", "type": "body", "article_id": "none", "reading_order": 1, "polygon": quad, "text": "t", "read_a": {"verbatim_text": "abc", "uncertain_spans": [{"text": "x", "start_offset": 0, "end_offset": 9}]}}, {"id": "b", "type": "body", "article_id": "A", "reading_order": 2, "polygon": quad}], "articles": [{"id": "A", "region_ids": ["zz"]}]}
    spark.createDataFrame([layout(7, payload=json.dumps(doc))], SCHEMA).write.parquet(str(tmp_path / "manual_layouts.parquet"))
    names = ("layout_violations", "span_violations", "iou_pairs", "assignment", "precedence_score", "article_reconstruct", "polygon_scale", "quad_validity", "flatten_order", "reader_choice")
    run = {n: queries.queries()[n](spark, str(tmp_path)).collect() for n in names}
    assert all(run.values())
    assert {(r.rule, r.key) for r in run["layout_violations"]} == {("unknown_region", "zz"), ("unknown_article", "none")}
    assert [(r.true_positive, r.false_negative, r.false_positive) for r in run["assignment"]] == [(2, 0, 0)] and [r.position for r in sorted(run["flatten_order"], key=lambda r: r.pos)] == [1, 2]
    assert {(r.corners, r.valid) for r in run["quad_validity"]} == {("given", True), ("crossed", False)}


def test_payload():
    assert parse_payload('{"a": NaN}') is None and parse_payload("[1]") is None and parse_payload(None) is None and parse_payload('{"pages": []}') is None
    assert parse_payload('{"regions": []}') == {"regions": []}


def test_pages_of_a_payload_follow_one_another(spark):
    page = lambda n: {"regions": [{"id": f"r{n}", "reading_order": n, "polygon": [[n, n]]}], "articles": [{"id": f"a{n}", "region_ids": [f"r{n}"]}]}
    df = spark.createDataFrame([layout(1, payload=json.dumps({"pages": [page(1), None, page(2)]})), layout(2, payload=json.dumps({"pages": []}))], SCHEMA)
    assert sorted((r.layout_id, r.region_pos, r.reading_order, r.x) for r in flatten_layouts(df, "corners").collect()) == [(1, 0, 1, 1.0), (1, 1, 2, 2.0)]
    assert sorted((r.article_pos, r.article_id) for r in flatten_layouts(df, "articles").collect()) == [(0, "a1"), (1, "a2")]
    assert [len(r.regions or []) for r in whole_layouts(df).orderBy("layout_id").collect()][:1] == [2]

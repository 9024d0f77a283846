import pytest
from pyspark.sql import functions as F

from folio.operators import reads


def test_routing(spark):
    rows = [(1, " дума ", "дума", 0.95, 0.91, 0), (2, "дума", "друга", 0.95, 0.95, 0), (3, "а [неясно]", "а [неясно]", 0.99, 0.99, 0), (4, "а", "а", 0.8, 0.99, 1), (5, "а", "а", None, 0.99, 0)]
    df = spark.createDataFrame(rows, "id int, a string, b string, a_confidence double, b_confidence double, uncertain int")
    got = {r.id: (r.route, r.reasons) for r in reads.routed(df).collect()}
    assert got[1] == ("agreement", []) and got[2] == ("adjudicate", ["reader_disagreement"]) and got[3] == ("adjudicate", [])
    assert got[4] == ("adjudicate", ["low_confidence", "reported_uncertainty"]) and got[5][0] == "adjudicate"
    one = df.where("id = 1").select(reads.accepted_unseen(F.lit(True), F.lit("heading")).alias("h"), reads.accepted_unseen(F.lit(True), F.lit("body")).alias("b"), reads.layout_escalates(F.lit(0.9), F.lit(0.8)).alias("e")).first()
    assert not one.h and one.b and one.e


def test_audit(spark):
    df = spark.createDataFrame([(0.9, True, None, ["x", "x"]), (0.99, True, True, [])], "c double, a boolean, b boolean, more array<string>")
    got = [r.f for r in df.select(reads.audit_failures(F.col("c"), {"a": F.col("a"), "b": F.col("b")}, F.col("more")).alias("f")).collect()]
    assert got == [["low_coverage", "b", "x"], []]


def test_order(spark):
    r = spark.createDataFrame([("p", "r1", "b", 1, 0), ("p", "r2", "a", 2, 1), ("p", "r3", "a", 1, 2), ("p", "r4", None, 9, 3), ("p", "r5", "zz", 1, 4)], "page_id string, region_id string, article_id string, reading_order int, pos int")
    a = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "page_id string, id string, reading_order int")
    assert [x.region_id for x in reads.two_level_order(r, a, "page_id").orderBy("position").collect()] == ["r4", "r3", "r2", "r1", "r5"]


def test_plan(spark):
    quad = [[0.0, 0.0]] * 4
    h = spark.createDataFrame([("p", "h1", "a1", 1, quad), ("p", "h1", "a1", 1, quad[:3]), ("p", "h2", "gone", 2, quad), ("p", "h3", "a1", 3, quad), ("p", "h4", "a1", 4, quad)], "page_id string, id string, article_id string, reading_order int, polygon array<array<double>>")
    a = spark.createDataFrame([("p", "a1", 1, quad, ["h1", "hx"], 2), ("p", "a2", 1, quad[:2], [], None)], "page_id string, id string, reading_order int, polygon array<array<double>>, heading_ids array<string>, columns int")
    r = spark.createDataFrame([("p", "r1", "a1", "h1", 1), ("p", "r2", "a1", "h3", 3), ("p", "r3", "a1", "h3", None), ("p", "r4", "other", "h4", None)], "page_id string, id string, article_id string, heading_id string, column_index int")
    got = {(x.rule, x.key) for x in reads.plan_violations(h, a, r).collect()}
    assert got == {
        ("duplicate_heading_id", "h1"), ("duplicate_heading_order", "1"), ("duplicate_article_order", "1"), ("unknown_article", "gone"), ("heading_not_four_corners", "h1"), ("envelope_too_small", "a2"), ("unknown_heading", "hx"),
        ("article_without_region", "a2"), ("heading_without_region", "h2"), ("heading_with_several_regions", "h3"), ("heading_of_other_article", "h4"), ("column_indices", "a1"),
    }


def test_drafts(spark):
    quad = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = [("body", 0, 2, None, None, quad), ("body", None, None, "a", "b", quad), ("heading", None, None, None, None, quad), ("heading", 1, 1, None, None, quad), ("body", None, None, None, None, quad), ("body", 3, 2, None, None, quad), ("body", None, None, "a", "", quad[:3])]
    df = spark.createDataFrame(rows, "role string, s int, e int, sq string, eq string, p array<array<double>>")
    got = [r.x for r in df.select(reads.draft_errors(*[F.col(c) for c in df.columns]).alias("x")).collect()]
    assert got == [[], [], [], ["heading_selects_text"], ["one_selector"], ["line_range"], ["polygon", "quotes"]]


def test_decisions(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")
    d = spark.createDataFrame([("a",), ("d",), ("c",)], "id string")
    assert sorted((r.id, r.changes, r.decisions) for r in reads.undecided(c, d, ["id"]).collect()) == [("b", 1, 0), ("c", 2, 1), ("d", 0, 1)]


def test_bands(spark):
    df = spark.createDataFrame([(1000,), (50,)], "h int")
    got = [[(b.begin, b.end) for b in r.x] for r in df.select(reads.bands(F.col("h"), 0.34, 0.24, 0.18).alias("x")).collect()]
    assert got[0] == [(0, 340), (240, 580), (480, 820), (660, 1000)] and got[1][-1][1] == 50


def test_encoder(spark):
    df = spark.createDataFrame([(str(i), "x" * i) for i in range(150)], "passage_id string, normalized_text string").coalesce(1)
    assert {r.passage_id: r.embedding for r in reads.embedded(df, lambda texts: [[float(len(t)), float(len(texts) <= 64)] for t in texts]).collect()}["7"] == [7.0, 1.0]
    with pytest.raises(Exception, match="another number"):
        reads.embedded(df, lambda texts: [[0.0]]).count()


def test_answer_stream(spark):
    answers = spark.createDataFrame([(1, "One. Two."), (2, None)], "question_id int, answer string")
    found = spark.createDataFrame([(1, "R1"), (2, "R1")], "question_id int, resource_id string")
    got = [(r.question_id, r.event, r.payload) for r in reads.answer_events(answers, found).orderBy("question_id", "seq").collect()]
    assert [e for q, e, _ in got if q == 1] == ["resources", "answer_delta", "answer_delta", "done"] and [e for q, e, _ in got if q == 2] == ["resources", "answer_error", "done"]


def test_fingerprint(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, None), ("a", 2, None)], "x string, y int, z string")
    shas = [r.s for r in df.select(reads.fingerprint("x", "y", "z").alias("s")).collect()]
    assert shas[0] == shas[1] != shas[2] and len(shas[0]) == 64

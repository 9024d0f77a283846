import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import geometry, text
from folio.operators import compare, entities, layout, passages, quality, search, tables
from folio.plans import archive
from folio.sources import files
from folio.streaming import progress


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_normalizers(spark):
    t = "  Обед-\n  но\r\nчай  и \t мед \n\n\n\nкрай̆ "
    assert one(spark, text.normalize_index(F.col("t")), t=t) == "Обедно\nчай и мед\n\nкрай̆".replace("й", "й")
    assert one(spark, text.normalize_store(F.col("t")), t="a-\n b  c ") == "ab c"
    assert one(spark, text.normalize_scoring(F.col("t"), "search"), t="Stra-\nße X\n y") == "strasse x y"
    assert one(spark, text.normalize_comparison(F.col("t")), t="\n a  b \n\n c\r\n") == "a b\n\nc"
    assert one(spark, text.nfc(F.col("t")), t="край") == "край"
    with pytest.raises(ValueError):
        text.normalize_scoring(F.col("t"), "other")


def test_small_functions(spark):
    assert one(spark, text.token_estimate(F.col("t")), t="x" * 2881) == 901 and one(spark, text.token_estimate(F.col("t")), t="") == 0
    assert one(spark, text.slug(F.col("t")), t=" Нов Град, 5! ") == "нов-град-5"
    assert one(spark, text.transliterated(F.col("t")), t="Shtastie") == "щастие"
    assert [one(spark, text.budget(F.col("t")), t=q) for q in ("show all", "compare x", "има ли данни", "who")] == [12, 8, 5, 3]
    assert one(spark, text.fraction(F.col("t")), t="page 3 / 4") == 0.75 and one(spark, text.fraction(F.col("t")), t="1/0") is None
    assert one(spark, text.integrity_errors(F.col("t")), t="x [ truncated ] �") == ["truncation_marker", "replacement_character"]
    assert one(spark, text.abrupt_ending(F.col("t")), t="дума- ") and not one(spark, text.abrupt_ending(F.col("t")), t="дума.")
    assert one(spark, text.quoted_span(F.col("t"), F.lit("b"), F.lit("d")), t="abcd").asDict() == {"begin": 1, "end": 4}
    assert one(spark, text.line_range(F.col("t"), F.lit(1), F.lit(2)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, text.body_without_heading(F.col("t"), F.lit("Head")), t="Head\n\nbody").body == "body"
    assert one(spark, text.body_without_heading(F.col("t"), F.lit("Head")), t="Head and body").inline
    assert text.expand_terms("what did he die of") == ["he", "die", "почина", "смърт", "умира", "хе"]


def test_bm25_brute(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["a1", "b2", "c3", "d4", "e5"]) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    df = spark.createDataFrame(docs, "id int, t string")
    tokens = {i: t.split() for i, t in docs}
    avg = sum(map(len, tokens.values())) / len(tokens)

    def score(doc):
        s = 0.0
        for term in ("a1", "e5"):
            n = sum(term in t for t in tokens.values())
            tf = doc.count(term)
            s -= max(1e-6, math.log((len(tokens) - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / avg))
        return s

    expected = sorted((round(score(t), 9), i) for i, t in tokens.items() if {"a1", "e5"} & set(t))[:7]
    got = [(round(r.score, 9), r.id) for r in search.lexical(df, "a1 e5", 7, "id", "t").orderBy("rank").collect()]
    assert got == expected
    assert search.lexical(df, "???", 5, "id", "t").count() == 0


def test_boolean(spark):
    df = spark.createDataFrame([(1, "red fox runs"), (2, "red cat"), (3, "foxes run"), (4, None)], "id int, t string")
    ids = lambda q: [r.id for r in search.boolean(df, q, 9, "id", "t").orderBy("id").collect()]
    assert ids("red fox") == [1] and ids("red NOT fox") == [2] and ids('"red fox" OR fox*') == [1, 3] and ids("cat OR runs") == [1, 2]
    assert search.parse_boolean("what?") is None and search.parse_boolean("NOT x") is None and search.parse_boolean("a OR") is None
    assert [r.strategy for r in search.boolean(df, "RED c?", 9, "id", "t").collect()] == [] and [r.id for r in search.boolean(df, "D C", 9, "id", "t").collect()] == []
    assert [r.id for r in search.boolean(df, "(RED", 9, "id", "t").collect()] == []


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 6) for r in df.select(search.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.707107, -1.0, -1.0, -1.0, -1.0]


def test_passages():
    paragraph = "дума " * 400
    whole = "\n\n".join([paragraph.strip()] * 4 + ["къс край"])
    got = passages.pack(whole)
    assert all(passages.tokens(len(t)) <= 900 for t, _, _ in got) and got[0][1] == 0 and got[-1][2] == len(whole)
    assert "".join("".join(t.split()) for t, _, _ in got) == "".join(whole.split())
    assert passages.pack("  a b ") == [("a b", 2, 5)] and passages.pack(" \n ") == []
    long = "x" * 4000 + " y"
    assert passages.pack(long) == [("x" * 4000, 0, 4000), ("y", 4001, 4002)]


def test_entities(spark):
    df = spark.createDataFrame([("a", "На 03.07.1949 Георги Петров срещна „НОВА ДУМА“ и Георги Петров."), ("b", None), ("c", "")], "article_id string, verbatim_text string")
    found = entities.mentions(df)
    rows = sorted((r.kind, r.name, r.start_offset, r.end_offset) for r in found.collect())
    assert [r[:2] for r in rows] == [("date", "03.07.1949"), ("named_entity", "Георги Петров"), ("named_entity", "Георги Петров"), ("named_entity", "НОВА ДУМА")]
    assert {(r.entity_id, r.mentions) for r in entities.entities(found).collect()} == {("date:03-07-1949", 1), ("named_entity:георги-петров", 2), ("named_entity:нова-дума", 1)}
    assert entities.together(found).count() == 3 and entities.neighbourhood(found, "named_entity:георги-петров").count() == 2


def test_comparison(spark):
    df = spark.createDataFrame([(1, "a  b\nc", "a b\nc"), (2, "a\nb", "a b"), (3, "x y z", "x q z"), (4, None, "")], "id int, a string, b string")
    got = {r.id: r for r in compare.text_comparison(df).collect()}
    assert got[1].lexically_equal and not got[2].lexically_equal and got[2].differences[0].kind == "line_or_paragraph_break" and got[3].difference_count == 1 and got[4].lexically_equal
    script = compare.edit_script(df)
    all_ = compare.applied(df, script, script)
    assert {r.id: r.text for r in all_.collect()} == {1: "a b\nc", 2: "a b", 3: "x q z", 4: ""}
    assert {r.id: r.text for r in compare.applied(df, script, script.limit(0)).collect()} == {1: "a  b\nc", 2: "a\nb", 3: "x y z", 4: ""}
    rates = compare.error_rates(spark.createDataFrame([(1, "котка", "кола"), (2, "a b c", "a x c")], "id int, a string, b string"))
    assert {r.id: (r.cer, round(r.wer, 6)) for r in rates.collect()} == {1: (0.4, 1.0), 2: (0.2, 0.333333)}
    assert compare.agreement(spark.createDataFrame([(1, " A  b", "a B ")], "id int, a string, b string")).first().agreement == 1.0
    lost = compare.truncation_signals(spark.createDataFrame([(1, "a b,", "a b c d e f g h i j k")], "id int, a string, b string")).first().signals
    assert lost[0] == "a_ends_abruptly" and "more_ending_words" in lost[1]


def test_boundary_overlap(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [("p", "a", " ".join(words[:150])), ("p", "b", " ".join(words[70:200])), ("p", "c", " ".join(words[200:])), ("q", "d", " ".join(words[:150])), ("p", "e", None)]
    got = compare.boundary_overlap(spark.createDataFrame(rows, "page_id string, article_id string, verbatim_text string")).collect()
    assert [(r.id.first, r.id.second, r.words) for r in got] == [("a", "b", 80)]


def test_geometry(spark):
    a, b = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]], [[1.0, 0.0], [3.0, 0.0], [3.0, 2.0], [1.0, 2.0]]
    df = spark.createDataFrame([(a, b)], "a array<array<double>>, b array<array<double>>")
    r = df.select(
        geometry.box_iou(geometry.box(F.col("a")), geometry.box(F.col("b"))).alias("iou"), geometry.overlap_of("a", "b").alias("o"), geometry.quad_valid(F.col("a"), 4.0).alias("v"), geometry.quad_valid(F.col("a")).alias("small"),
        geometry.quad_ordered(F.reverse("a")).alias("q"), geometry.hash_distance(F.lit("ff"), F.lit("8000000000000000")).alias("d"),
    ).first()
    assert abs(r.iou - 1 / 3) < 1e-9 and r.o == 0.5 and r.v and not r.small and r.q[0] == [0.0, 0.0] and r.d == 9
    bowtie = spark.createDataFrame([([[0.0, 0.0], [9.0, 9.0], [9.0, 0.0], [0.0, 9.0]],)], "a array<array<double>>")
    assert not bowtie.select(geometry.quad_valid(F.col("a"), 1.0).alias("v")).first().v


def test_assignment_brute():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(60):
        w = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        n = max(w.shape)
        full = np.zeros((n, n))
        full[: w.shape[0], : w.shape[1]] = w
        best = max(sum(full[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(w[i, j] for i, j in layout.best_assignment(w)) - best) < 1e-9


def test_coverage(spark):
    texts = spark.createDataFrame([("a", "one two three"), ("b", "x y"), ("c", "z")], "article_id string, body string")
    blocks = spark.createDataFrame([("a", 0, 3), ("a", 8, 13), ("b", 0, 3), ("b", 2, 3)], "article_id string, begin int, end int")
    assert sorted((r.article_id, r.rule) for r in layout.coverage(blocks, texts).collect()) == [("a", "gap"), ("b", "overlap"), ("c", "incomplete")]


def test_accepted_plans(spark):
    block = "array<struct<block_id:string,font_size_ratio:double,line_height:double>>"
    good = [("x", 0.1, 1.0)]
    rows = [(1, True, [], 3, good, ["x"]), (2, None, [], 3, good, ["x"]), (3, True, ["i"], 3, good, ["x"]), (4, True, [], 3, good, ["x", "y"]), (5, True, [], 2, good, None), (6, True, None, 3, [("x", None, 1.0)], ["x"])]
    df = spark.createDataFrame(rows, f"id int, ok boolean, issues array<string>, schema_version int, blocks {block}, checked_block_ids array<string>")
    assert sorted(r.id for r in layout.accepted(df, ["ok"]).collect()) == [1, 5]


def test_doubled_captions(spark):
    p = [[0.0, 0.0]]
    rows = [("h", "a", "heading", p, "Head"), ("c", "a", "caption", p, "Head and more"), ("i", "a", "heading", [[1.0, 1.0]], "Head"), ("b", "b", "heading", p, "Head")]
    df = spark.createDataFrame(rows, "block_id string, article_id string, role string, polygon array<array<double>>, text string")
    assert sorted(r.block_id for r in layout.without_doubled_captions(df).collect()) == ["b", "c", "i"]


@pytest.mark.parametrize("distance", [3, 9])
def test_duplicates_brute(spark, distance):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(80):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randint(0, 62)
        rows.append((i, h, rng.choice([None, "s1", f"u{i}", "s2"]) if i % 9 == 0 else f"u{i}"))
    expected = {}
    for i, h, s in rows:
        for j, g, t in rows[:i]:
            if (s is not None and s == t) or (h ^ g).bit_count() <= distance:
                expected[i] = (j, (h ^ g).bit_count())
                break
    got = {r.idx: (r.duplicate_of, r.hash_distance) for r in quality.duplicates(spark.createDataFrame(rows, "idx int, hash bigint, sha256 string"), distance).collect()}
    assert got == expected


def test_flags(spark):
    rows = [("a", 10.0, 5.0, 0.5, 0.1, 90.0, 0.001, 0.2, 100, 100), ("b", 100.0, 0.0, 0.5, 1.0, 10.0, 0.1, 0.0, 2000, 3000), ("c", *[None] * 9)]
    df = spark.createDataFrame(rows, "path string, blur_laplacian_variance double, skew_degrees double, skew_confidence double, orientation_gradient_ratio double, illumination_grid_range double, ink_coverage double, edge_ink_ratio double, width int, height int")
    got = {r.path: (r.flags, r.qc_status) for r in quality.flags(df).collect()}
    assert got["a"] == (["blur", "skew", "orientation_suspect", "uneven_illumination", "blank_page", "cropped_or_missing_edge", "insufficient_resolution"], "review")
    assert got["b"] == ([], "pass") and got["c"] == ([], "pass")


def test_corrections(spark):
    base = spark.createDataFrame([("r1", "old"), ("r2", "kept")], "region_id string, text string")
    changes = spark.createDataFrame([("r1", "first", 1), ("r1", "second", 2)], "region_id string, correction string, updated_at int")
    assert {r.region_id: r.text for r in tables.corrected(base, changes, "region_id", "text").collect()} == {"r1": "second", "r2": "kept"}


def test_progress(spark):
    events = (("Some stage", None), ("Page", "1/2"), ("Independent article read", "1/2"), ("Preprocessing", ""), ("Article saved", "3 of them"), ("Transcribing regions", "5/0"), ("Page", "2 / 2"), ("Layout complete", ""), ("Page", "1/2"), ("Complete", "saved"), ("Complete", ""), ("Thinking", ""))
    df = spark.createDataFrame([("j", i, *e) for i, e in enumerate(events)] + [("k", 0, "Complete", ""), ("k", 1, "Some stage", "")], "job_id string, seq bigint, stage string, detail string")
    rows = progress.progress_batch(df).orderBy("job_id", "seq").collect()
    got = [r.percent for r in rows if r.job_id == "j"]
    # The parts of page 1 count half, a start of page 2 half and its own part.
    assert got == [5.8, 5.8, 34.3, 34.3, 34.3, 34.3, 49.0, 94.1, 94.1, 94.1, 100.0, 100.0] and [r.percent for r in rows if r.job_id == "k"] == [100.0, 100.0]
    assert [r.estimated for r in rows if r.job_id == "j"] == [True] * 10 + [False, True] and progress.progress_batch(df.limit(0)).count() == 0
    pdf = df.where("job_id = 'j'").toPandas()
    for cut in range(len(events)):
        state, parts = (1.0, 1.0, None, 0.0), []
        for piece in (pdf[:cut], pdf[cut:]):
            if len(piece):
                out, state = progress.continued(piece.reset_index(drop=True), *state)
                parts += out["percent"].tolist()
        assert parts == got, cut


def test_stream_is_batch(spark, data):
    from folio.plans.queries import progress_fold, progress_stream

    rows = lambda df: sorted((r.job_id, r.seq, r.percent, r.estimated) for r in df.collect())
    assert rows(progress_stream(spark, data)) == rows(progress_fold(spark, data))


def test_instants(spark):
    df = spark.createDataFrame([("2024-02-01T04:28:50+02:00",), ("2024-02-01 04:28:50",), ("1706761730",), ("1706761730000",), ("01.02.2024 04:28",), ("soon",), (None,)], "t string")
    got = [r.x for r in df.select(progress.instant(F.col("t")).cast("string").alias("x")).collect()]
    assert got == ["2024-02-01 02:28:50", "2024-02-01 04:28:50", "2024-02-01 04:28:50", "2024-02-01 04:28:50", "2024-02-01 04:28:00", None, None]


def test_artifacts_to_index(spark, tmp_path):
    def put(name, doc):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(doc if isinstance(doc, str) else json.dumps(doc), encoding="utf-8")

    put("a.articles.json", {"source_sha256": "h1", "articles": [{"article_id": "x", "verbatim_text": "къс текст"}]})
    put("b.articles.json", {"source_sha256": "h1", "workflow": "w", "articles": [{"heading": "Глава", "verbatim_text": "пожарна команда"}, {"text": "втори запис за умира", "label": "L", "confidence": 0.5}, {"text": "  "}]})
    put("c.articles.json", "{ not json")
    put("d.articles.json", {"articles": []})
    found = files.artifacts(spark, str(tmp_path / "in"))
    assert [(r.source_sha256, r.workflow, r.n_articles) for r in found.collect()] == [("h1", "w", 2)]
    made = archive.index_tables(found)
    counts = archive.write_index(made, str(tmp_path / "index"))
    assert counts["articles"] == 2 and counts["passages"] == 2
    assert [r.passage_id for r in archive.indexed_search(spark, str(tmp_path / "index"), "пожарна").collect()] == ["page:h1:article-1:passage:1"]
    # A rebuild that fails leaves the last run; one that ends is searched at once.
    broken = {**made, "passages": made["passages"].withColumn("heading", F.raise_error(F.lit("lost")))}
    with pytest.raises(Exception):
        archive.write_index(broken, str(tmp_path / "index"))
    assert [r.passage_id for r in archive.indexed_search(spark, str(tmp_path / "index"), "пожарна").collect()] == ["page:h1:article-1:passage:1"]
    archive.write_index({**made, "passages": made["passages"].limit(0)}, str(tmp_path / "index"), buckets=4)
    assert archive.indexed_search(spark, str(tmp_path / "index"), "пожарна").count() == 0 and spark.read.parquet(str(tmp_path / "index" / "runs")).count() == 2
    assert {r.page_id: r.value for r in files.markdown(made["articles"]).collect()}["page:h1"].startswith("## Глава\n\nпожарна команда\n\n## L")
    files.write_once(made["pages"], str(tmp_path / "once"))
    with pytest.raises(Exception):
        files.write_once(made["pages"], str(tmp_path / "once"))


def test_manifest(spark, tmp_path):
    doc = {"run_id": "r", "pages": [{"page_id": "p", "source": {"path": "x/p.png"}, "regions": [{"region": {"id": "1", "type": "headline", "article_id": "a", "reading_order": 1}, "accepted_text": "T"}, {"id": "2", "type": "body", "article_id": "a", "reading_order": 2, "text": "body", "status": "needs_crop_transcription"}]}], "review_queue": [{"page_id": "p", "reasons": ["x"]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    found = files.manifests(spark, str(tmp_path))
    regions = files.manifest_regions(found)
    assert layout.reconstructed(regions).first().verbatim_text == "T\n\nbody"
    assert sorted((r.region_id or "", r.reasons) for r in files.reviews(found, regions).collect()) == [("", ["x"]), ("r:p:2", ["needs_crop_transcription"])]
    assert files.manifests(spark, str(tmp_path), found.select("run_id")).count() == 0


def test_filenames(spark):
    df = spark.createDataFrame([("scans/IMG_0982_nm_07_04_1949_page1.png",), ("x/holiday.png",), ("a/zz_13_40_1949_02_03_1950.png",)], "p string")
    hints = F.create_map(F.lit("nm"), F.lit("Н. м."))
    got = [r.m for r in df.select(archive.filename_metadata(F.col("p"), hints).alias("m")).collect()]
    assert (got[0].publication, str(got[0].issue_date), got[0].page_number) == ("Н. м.", "1949-07-04", 1)
    assert all(v is None for v in got[1]) and str(got[2].issue_date) == "1950-02-03"


def test_images_and_paths(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert [(r.name, r.bytes) for r in files.images(spark, str(tmp_path), content=True).collect()] == [("a.PNG", 1)]
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), str(tmp_path / ".." / "x"))




def test_written_and_forgotten(spark):
    from folio.session import forget, importable, written

    forget(spark)
    df = written(spark.createDataFrame([(1, None)], "a int, b string"), "t")
    path = df.inputFiles()[0]
    assert df.collect() == [(1, None)] and os.path.exists(path.replace("file://", "")) and forget(spark) == 1 and not os.path.exists(path.replace("file://", ""))
    assert importable(spark) is importable(spark)

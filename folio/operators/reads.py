"""Two independent reads of the same piece: routing, reasons for review, summaries; plans and drafts held against layouts; vectors for passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.geometry import in_range
from folio.functions.text import trimmed, unresolved

#: The least confidences of an agreement, of a region's own role, and of a read; the least agreement of two reads.
AGREED, AGREED_STRICT, SURE, SAME, HARD = 0.90, 0.92, 0.85, 0.92, 0.85
#: Roles that are never accepted without a look; the least coverage of a layout and of regional reads.
HIGH_IMPACT = ("heading", "subheading", "deck", "caption", "signature", "metadata", "notice")
LAYOUT_COVERAGE, READ_COVERAGE = 0.985, 0.82


def agreed(a: Column, b: Column, a_confidence: Column, b_confidence: Column, uncertain: Column, least: float = AGREED) -> Column:
    """Both reads say the same, surely, without uncertain spans or marks."""
    sure = F.least(a_confidence, b_confidence) >= least
    both = a_confidence.isNotNull() & b_confidence.isNotNull() & (trimmed(a) == trimmed(b)) & sure & (uncertain == 0) & ~unresolved(a)
    return F.coalesce(both, F.lit(False))


def accepted_unseen(agreement: Column, role: Column) -> Column:
    return agreement & ~F.coalesce(role.isin(*HIGH_IMPACT), F.lit(False))


def review_reasons(agreement: Column, a_confidence: Column, b_confidence: Column, uncertain: Column, same: float = SAME, sure: float = SURE) -> Column:
    """Which of reader_disagreement, low_confidence and reported_uncertainty there are, in this order."""
    return F.array_compact(F.array(F.when(agreement < same, "reader_disagreement"), F.when(F.least(a_confidence, b_confidence) < sure, "low_confidence"), F.when(uncertain > 0, "reported_uncertainty")))


def hard(needs_enhancement: Column, confidence: Column) -> Column:
    """Does a region need the stronger reader?"""
    return F.coalesce(needs_enhancement, F.lit(False)) | F.coalesce(confidence < HARD, F.lit(True))


def layout_escalates(confidence: Column, difficulty: Column, least: float = 0.82, most: float = 0.70) -> Column:
    return (confidence < least) | (difficulty > most)


def audit_failures(coverage: Column, verdicts: dict[str, Column], *further: Column) -> Column:
    """What is wrong with a layout: low coverage, verdicts that aren't true, and the issues reported, each once, in order."""
    listed = [F.when(coverage < LAYOUT_COVERAGE, "low_coverage"), *[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in verdicts.items()]]
    return F.array_distinct(F.concat(F.array_compact(F.array(*listed)), *further))


def routed(reads: DataFrame) -> DataFrame:
    """(id, route, reasons) of (id, a, b, a_confidence, b_confidence, uncertain): agreement or adjudicate, and why."""
    ok = agreed(F.col("a"), F.col("b"), F.col("a_confidence"), F.col("b_confidence"), F.col("uncertain"))
    same = F.when(trimmed(F.col("a")) == trimmed(F.col("b")), 1.0).otherwise(0.0)
    return reads.select("id", F.when(ok, "agreement").otherwise("adjudicate").alias("route"), review_reasons(same, F.col("a_confidence"), F.col("b_confidence"), F.col("uncertain")).alias("reasons"))


def summary(articles: DataFrame, by: str) -> DataFrame:
    """(by, articles, confidence, uncertain, without_text): counts, the least confidence (0 without any), ids with uncertainties."""
    listed = F.array_sort(F.collect_list(F.when(F.coalesce("uncertainties_json", F.lit("[]")) != "[]", F.col("article_id"))))
    return articles.groupBy(by).agg(F.count("*").alias("articles"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"), listed.alias("uncertain"), F.count_if(F.coalesce(F.length("verbatim_text"), F.lit(0)) == 0).alias("without_text"))


def two_level_order(regions: DataFrame, articles: DataFrame, by: str) -> DataFrame:
    """(by, region_id, position): regions of the page itself first, then article by article, then those of unknown articles; by reading order and id within."""
    a = articles.select(by, F.col("id").alias("article_id"), F.col("reading_order").alias("article_order")).groupBy(by, "article_id").agg(F.min("article_order").alias("article_order"))
    joined = regions.join(a, [by, "article_id"], "left")
    rank = F.when(F.col("article_id").isNull(), 0).when(F.col("article_order").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy(by).orderBy(rank, F.asc_nulls_last("article_order"), F.when(rank == 1, F.col("article_id")), F.asc_nulls_last("reading_order"), "region_id", "pos")
    return joined.select(by, "region_id", "pos", F.row_number().over(order).alias("position"))


def plan_violations(headings: DataFrame, articles: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, rule, key): a plan's headings (page_id, id, article_id, reading_order, polygon) and articles (page_id, id, reading_order, polygon, heading_ids, columns) against each other and against regions (page_id, id, article_id, heading_id, column_index)."""

    def rule(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select("page_id", F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))

    def twice(df: DataFrame, key: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy("page_id", key).agg(F.count("*").alias("n")).where("n > 1")

    known = articles.select("page_id", F.col("id").alias("article_id")).distinct()
    named = articles.select("page_id", F.explode("heading_ids").alias("id"))
    placed = regions.where("heading_id is not null").groupBy("page_id", F.col("heading_id").alias("id")).agg(F.count("*").alias("n"), F.min("article_id").alias("owner"))
    both = headings.join(placed, ["page_id", "id"], "left")
    columns = regions.where("column_index is not null").groupBy("page_id", F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("column_index")).alias("found"))
    expected = articles.where("columns > 0").join(columns, ["page_id", "id"], "left").where(~F.col("found").eqNullSafe(F.sequence(F.lit(1), F.col("columns"))))
    found = [
        rule(twice(headings, "id"), "duplicate_heading_id", "id"), rule(twice(articles, "id"), "duplicate_article_id", "id"), rule(twice(headings, "reading_order"), "duplicate_heading_order", "reading_order"),
        rule(twice(articles, "reading_order"), "duplicate_article_order", "reading_order"), rule(headings.join(known, ["page_id", "article_id"], "left_anti"), "unknown_article", "article_id"),
        rule(headings.where(F.coalesce(F.size("polygon"), F.lit(-1)) != 4), "heading_not_four_corners", "id"), rule(articles.where(F.coalesce(F.size("polygon"), F.lit(-1)) < 3), "envelope_too_small", "id"),
        rule(named.join(headings.select("page_id", "id"), ["page_id", "id"], "left_anti"), "unknown_heading", "id"), rule(articles.join(regions.select("page_id", F.col("article_id").alias("id")), ["page_id", "id"], "left_anti"), "article_without_region", "id"),
        rule(both.where("n is null"), "heading_without_region", "id"), rule(both.where("n > 1"), "heading_with_several_regions", "id"), rule(both.where("n = 1 and not (owner <=> article_id)"), "heading_of_other_article", "id"), rule(expected, "column_indices", "id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def draft_errors(role: Column, start_line: Column, end_line: Column, start_quote: Column, end_quote: Column, polygon: Column) -> Column:
    """Names of what is wrong with a drafted block: its corners, or how it selects its text: a heading not at all, any other block by lines or by quotes."""
    lines, quotes = start_line.isNotNull() | end_line.isNotNull(), start_quote.isNotNull() | end_quote.isNotNull()
    heading = role == "heading"
    bad_lines = lines & ~F.coalesce((start_line >= 0) & (end_line >= start_line), F.lit(False))
    bad_quotes = quotes & ~F.coalesce((start_quote != "") & (end_quote != ""), F.lit(False))
    return F.array_compact(F.array(
        F.when(~F.coalesce((F.size(polygon) == 4) & in_range(polygon), F.lit(False)), "polygon"), F.when(heading & (lines | quotes), "heading_selects_text"), F.when(~heading & (lines == quotes), "one_selector"),
        F.when(~heading & (lines != quotes) & bad_lines, "line_range"), F.when(~heading & (lines != quotes) & bad_quotes, "quotes"),
    ))


def undecided(changes: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of changes without a decision, of decisions without a change, and of either that occur more than once."""
    c, d = changes.groupBy(*keys).agg(F.count("*").alias("c")), decisions.groupBy(*keys).agg(F.count("*").alias("d"))
    return c.join(d, keys, "full").where("c is null or d is null or c > 1 or d > 1").select(*keys, F.coalesce("c", F.lit(0)).alias("changes"), F.coalesce("d", F.lit(0)).alias("decisions"))


def fingerprint(*columns: str) -> Column:
    """sha256 of a row's fields as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def bands(height: Column, part: float, step: float, least: float) -> Column:
    """(begin, end) of overlapping bands down a page, each `part` of its height, `step` apart, none shorter than `least` of it; a last one ends at the foot."""
    size, by = F.floor(height * part).cast("int"), F.greatest(F.lit(1), F.floor(height * step)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), height - size), by)
    made = F.filter(F.transform(starts, lambda s: F.struct(s.alias("begin"), F.least(height, s + size).alias("end"))), lambda b: (b["end"] - b["begin"]) >= height * least)
    tail = F.array(F.struct(F.greatest(F.lit(0), height - size).alias("begin"), height.alias("end")))
    return F.when((F.size(made) > 0) & (F.element_at(made, -1)["end"] < height), F.concat(made, tail)).otherwise(made)


def rendered(metrics: DataFrame, block: str) -> DataFrame:
    """What is worst about each block over all widths that it was rendered at."""
    ratio = lambda px, side: F.max(F.col(px) / F.greatest(F.lit(1.0), F.col(side)))
    return metrics.groupBy(block).agg(
        F.bool_or("overflow").alias("overflow"), F.max("bottom_overflow_px").alias("bottom_overflow_px"), F.max("right_overflow_px").alias("right_overflow_px"), ratio("bottom_overflow_px", "box_height_px").alias("bottom_overflow_ratio"),
        ratio("right_overflow_px", "box_width_px").alias("right_overflow_ratio"), F.min("fill_ratio").alias("minimum_fill_ratio"), F.max("fill_ratio").alias("maximum_fill_ratio"), F.min("box_height_px").alias("minimum_box_height_px"),
    )


def embedded(passages: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "passage_id", text: str = "normalized_text", batch: int = 64) -> DataFrame:
    """(key, embedding): vectors of passages by an encoder that is given up to `batch` texts at a time and must return as many vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                vectors = encode([t or "" for t in some.column(1).to_pylist()])
                if len(vectors) != some.num_rows:
                    raise ValueError("the encoder returned another number of vectors")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["k", "embedding"])

    kept = passages.select(key, text)
    return kept.mapInArrow(run, f"k {kept.schema[0].dataType.simpleString()}, embedding array<double>").withColumnRenamed("k", key)


def answer_events(answers: DataFrame, found: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, seq, event, payload): what a reader of a streamed answer gets, in order: resources, the parts of the answer, done; an error in place of the answer if there is none."""
    first = found.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list("resource_id"))).alias("payload")).select(by, F.lit(0).alias("seq"), F.lit("resources").alias("event"), "payload")
    parts = answers.select(by, F.posexplode(F.split("answer", r"(?<=[.!?]) ")).alias("n", "payload")).select(by, (F.col("n") + 1).alias("seq"), F.lit("answer_delta").alias("event"), "payload")
    failed = answers.where("answer is null").select(by, F.lit(1).alias("seq"), F.lit("answer_error").alias("event"), F.lit(None).cast("string").alias("payload"))
    last = answers.select(by, F.lit(1 << 30).alias("seq"), F.lit("done").alias("event"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(parts).unionByName(failed).unionByName(last)

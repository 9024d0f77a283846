"""Checks and measures of page layouts: violations of their rules, spans, coverage, reading order, assignment of regions, reconstruction of articles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.geometry import box, box_iou, in_range
from folio.functions.text import normalize_store

LEAST_IOU = 0.5


def exploded(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions and articles of layouts (see nested.whole_layouts), each delivery once: (layout_id, pos, r) and (layout_id, pos, a)."""
    once = layouts.select("layout_id", "regions", "articles").distinct()
    regions = once.select("layout_id", F.posexplode("regions").alias("pos", "r")).where("r is not null")
    return regions, once.select("layout_id", F.posexplode("articles").alias("pos", "a")).where("a is not null")


def violations(layouts: DataFrame) -> DataFrame:
    """(layout_id, rule, key): which rules a layout breaks, and by what. Everything is joined within a layout."""
    regions, articles = exploded(layouts)
    r = regions.select("layout_id", "pos", F.col("r.id").alias("id"), F.col("r.article_id").alias("article_id"), F.col("r.parent_id").alias("parent_id"), F.col("r.reading_order").alias("reading_order"), F.col("r.polygon").alias("polygon"))
    a = articles.select("layout_id", "pos", F.col("a.id").alias("id"), F.col("a.region_ids").alias("region_ids"), F.col("a.reading_order").alias("reading_order"))
    ids, article_ids = r.select("layout_id", "id").distinct(), a.select("layout_id", "id").distinct()
    members = a.select("layout_id", F.col("id").alias("article"), F.explode("region_ids").alias("id")).distinct()

    def rule(df: DataFrame, name: str, key: str | Column) -> DataFrame:
        return df.select("layout_id", F.lit(name).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))

    def repeated(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy("layout_id", *by).agg(F.count("*").alias("n")).where("n > 1")

    owner = members.join(r.where("article_id is not null").select("layout_id", "id", "article_id").distinct(), ["layout_id", "id"])
    local = members.join(r.where("reading_order is not null").select("layout_id", "id", "reading_order", "pos"), ["layout_id", "id"])
    found = [
        rule(repeated(r, "id"), "duplicate_region_id", "id"),
        rule(r.where(F.coalesce(F.size("polygon"), F.lit(-1)) != 4), "not_four_corners", "id"),
        rule(r.where(~F.coalesce(in_range(F.col("polygon")), F.lit(True))), "invalid_polygon", "id"),
        rule(r.where("parent_id = id"), "own_parent", "id"),
        rule(r.where("parent_id is not null").join(ids.withColumnRenamed("id", "parent_id"), ["layout_id", "parent_id"], "left_anti"), "unknown_parent", "parent_id"),
        rule(repeated(a, "id"), "duplicate_article_id", "id"),
        rule(a.where(F.coalesce(F.size("region_ids"), F.lit(0)) < 1), "article_without_regions", "id"),
        rule(members.join(ids, ["layout_id", "id"], "left_anti"), "unknown_region", "id"),
        rule(repeated(members, "id"), "region_of_several_articles", "id"),
        rule(repeated(a.where("reading_order is not null"), "reading_order"), "duplicate_article_order", "reading_order"),
        rule(r.where("article_id is not null").join(article_ids.withColumnRenamed("id", "article_id"), ["layout_id", "article_id"], "left_anti"), "unknown_article", "article_id"),
        rule(owner.where("article_id <> article"), "membership_disagrees", "id"),
        rule(repeated(local, "article", "reading_order"), "duplicate_local_order", F.concat_ws(":", "article", "reading_order")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def span_violations(spans: DataFrame) -> DataFrame:
    """(id, span_no, rule) of (id, verbatim_text, uncertain_spans): out_of_bounds, text_mismatch, overlap. Spans are taken in order of their starts."""
    one = spans.select("id", F.col("verbatim_text").alias("t"), F.posexplode("uncertain_spans").alias("given", "s")).where("s is not null")
    order = Window.partitionBy("id").orderBy("s.start_offset", "given")
    numbered = one.withColumn("span_no", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.max("s.end_offset").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start, end = F.col("s.start_offset"), F.col("s.end_offset")
    outside = (end < start) | (end > F.length("t"))
    differs = F.substring(F.col("t"), start + 1, end - start) != F.col("s.text")
    rules = F.array_compact(F.array(F.when(outside, "out_of_bounds").when(differs, "text_mismatch"), F.when(start < F.col("before"), "overlap")))
    return numbered.select("id", "span_no", F.explode(rules).alias("rule"))


def coverage(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(article_id, rule) where blocks (article_id, begin, end) don't cover (article_id, body) once and in order: gap, overlap, incomplete."""
    order = Window.partitionBy("article_id").orderBy("begin", "end")
    seen = blocks.join(texts, "article_id").withColumn("before", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gap = F.trim(F.regexp_replace(F.substring(F.col("body"), F.col("before") + 1, F.greatest(F.lit(0), F.col("begin") - F.col("before"))), r"\s+", "")) != ""
    between = seen.select("article_id", F.explode(F.array_compact(F.array(F.when(gap, "gap"), F.when(F.col("begin") < F.col("before"), "overlap")))).alias("rule"))
    ends = texts.join(blocks.groupBy("article_id").agg(F.max("end").alias("end")), "article_id", "left")
    rest = F.regexp_replace(F.substring(F.col("body"), F.coalesce("end", F.lit(0)) + 1, F.length("body")), r"\s+", "") != ""
    return between.unionByName(ends.where(rest).select("article_id", F.lit("incomplete").alias("rule"))).distinct()


def reconstructed(regions: DataFrame) -> DataFrame:
    """(page_id, article_id, title, verbatim_text, normalized_text, confidence, region_ids) from (page_id, article_id, region_id, type, reading_order, text, confidence, pos).

    Regions go in reading order (those without one last), then by type, text and id; without an article they form the page's ungrouped one.
    The title is the first headline with a text; the confidence the least; texts are divided by blank lines.
    """
    article = F.coalesce(F.nullif(F.col("article_id"), F.lit("")), F.concat("page_id", F.lit(":ungrouped")))
    item = F.struct(F.coalesce("reading_order", F.lit(9999)).alias("o"), F.coalesce("type", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("region_id", F.lit("")).alias("id"), "pos")
    grouped = regions.groupBy("page_id", article.alias("article_id")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("confidence").alias("confidence"))
    text = F.array_join(F.transform(F.filter("items", lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n")
    title = F.get(F.transform(F.filter("items", lambda x: (x["kind"] == "headline") & (x["text"] != "")), lambda x: x["text"]), F.lit(0))
    made = grouped.select("page_id", "article_id", title.alias("title"), text.alias("verbatim_text"), "confidence", F.transform("items", lambda x: x["id"]).alias("region_ids"))
    return made.withColumn("normalized_text", normalize_store(F.col("verbatim_text"), compose=False))


def iou_pairs(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """(by, gold_id, predicted_id, iou) of (by, id, polygon): pairs of the same page and label only."""
    g = gold.select(*by, F.col("id").alias("gold_id"), box(F.col("polygon")).alias("g"))
    p = predicted.select(*by, F.col("id").alias("predicted_id"), box(F.col("polygon")).alias("p"))
    return g.join(p, by).select(*by, "gold_id", "predicted_id", box_iou(F.col("g"), F.col("p")).alias("iou"))


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """The pairing of rows and columns with the greatest total, by shortest augmenting paths."""
    n = max(weight.shape)
    cost = np.zeros((n, n))
    cost[: weight.shape[0], : weight.shape[1]] = -weight
    row_of, row_price, column_price = np.full(n, -1), np.zeros(n), np.zeros(n)
    for start in range(n):
        least, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, column = start, -1
        while True:
            slack = cost[row] - row_price[row] - column_price
            base = least[column] if column >= 0 else 0.0
            better = ~done & (base + slack < least)
            least[better], via[better] = base + slack[better], column
            open_ = np.where(done, np.inf, least)
            column = int(open_.argmin())
            done[column] = True
            if row_of[column] < 0:
                break
            row = int(row_of[column])
        reach = least[column]
        visited = done.copy()
        visited[column] = False
        row_price[start] += reach
        for c in np.flatnonzero(visited):
            row_price[row_of[c]] += reach - least[c]
            column_price[c] -= reach - least[c]
        while column >= 0:
            before = int(via[column])
            row_of[column] = row_of[before] if before >= 0 else start
            column = before
    return [(int(r), c) for c, r in enumerate(row_of) if r < weight.shape[0] and c < weight.shape[1]]


def _assign(table: pa.Table) -> pa.Table:
    page = table.column("page_id")[0].as_py()
    rows = table.to_pylist()
    gold = sorted((r["id"], r["label"], r["box"]) for r in rows if r["kind"] == "gold")
    predicted = sorted((r["id"], r["label"], r["box"]) for r in rows if r["kind"] == "pred")
    weight = np.zeros((len(gold), len(predicted)))
    for i, (_, gl, a) in enumerate(gold):
        for j, (_, pl, b) in enumerate(predicted):
            if gl == pl:
                w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
                weight[i, j] = w * h / union if union else 0.0
    hits = sum(weight[i, j] >= LEAST_IOU for i, j in best_assignment(weight)) if weight.size else 0
    return pa.table({"page_id": [page], "true_positive": pa.array([int(hits)], pa.int32()), "false_negative": pa.array([len(gold) - int(hits)], pa.int32()), "false_positive": pa.array([len(predicted) - int(hits)], pa.int32())})


def assignment(regions: DataFrame) -> DataFrame:
    """(page_id, true_positive, false_negative, false_positive) of (page_id, kind gold or pred, id, label, polygon): the best one-to-one pairing of each page."""
    b = box(F.col("polygon"))
    kept = regions.select("page_id", "kind", "id", "label", F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("box"))
    return kept.groupBy("page_id").applyInArrow(_assign, "page_id string, true_positive int, false_negative int, false_positive int")


def precedence(order: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, score): the share of edges (by, before, after) whose ends stand in that order in (by, item, pos); 1 where none can be judged."""
    a, b = (order.select(by, F.col("item").alias(n), F.col("pos").alias(f"{n}_pos")) for n in ("before", "after"))
    judged = edges.join(a, [by, "before"]).join(b, [by, "after"]).groupBy(by).agg(F.avg((F.col("before_pos") < F.col("after_pos")).cast("double")).alias("score"))
    return order.select(by).distinct().join(judged, by, "left").select(by, F.coalesce("score", F.lit(1.0)).alias("score"))


def accepted(plans: DataFrame, verdicts: list[str]) -> DataFrame:
    """Plans whose every verdict is true (null is not), without issues, whose blocks were each checked once and have typography."""
    ok = F.coalesce(F.size("issues"), F.lit(0)) == 0
    for v in verdicts:
        ok = ok & F.coalesce(F.col(v), F.lit(False))
    ids = F.transform("blocks", lambda b: b["block_id"])
    exact = (F.size("checked_block_ids") == F.size(F.array_distinct(ids))) & (F.array_sort(F.array_distinct("checked_block_ids")) == F.array_sort(F.array_distinct(ids)))
    checked = (F.coalesce("schema_version", F.lit(1)) < 3) | F.coalesce(exact, F.lit(False))
    typed = F.forall("blocks", lambda b: F.coalesce((b["font_size_ratio"] > 0) & (b["line_height"] > 0), F.lit(False)))
    return plans.where(ok & checked & F.coalesce(typed, F.lit(True)))


def without_doubled_captions(blocks: DataFrame) -> DataFrame:
    """Blocks but for headings that a caption of the same article and polygon begins with."""
    heads = blocks.where("role = 'heading'").select("block_id", "article_id", "polygon", F.coalesce("text", F.lit("")).alias("t"))
    captions = blocks.where("role = 'caption'").select(F.col("article_id").alias("ca"), F.col("polygon").alias("cp"), F.coalesce("text", F.lit("")).alias("ct"))
    doubled = heads.join(captions, (F.col("article_id") == F.col("ca")) & (F.col("polygon") == F.col("cp")) & F.startswith("ct", F.col("t")) & (F.col("t") != ""), "left_semi")
    return blocks.join(doubled.select("block_id"), "block_id", "left_anti")

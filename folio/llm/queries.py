"""The queries of this subpackage's operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm import ann, mixing, neardup, ocr, spam, splitting, tokenize, truncation, unify
from folio.session import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.pairs(read(spark, sf_dir, "passages"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.neighbours(read(spark, sf_dir, "passages"))
    return found.select(F.col("id").alias("passage_id"), "rank", F.col("neighbour").alias("neighbour_id"), "similarity")


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search: every vec_id divisible by 20 as a query, against all rows of embeddings."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("embeddings").alias("model"), "embedding")
    members, nodes = ann.nodes_of(ann.usable(vectors, "id", "model", "embedding"))
    centres = ann.centroids(nodes)
    graph = ann.graph_of(nodes, centres=centres)
    asked = members.where(F.col("id").cast("bigint") % 20 == 0)
    queries = asked.join(nodes.select("node", "model", "vec"), "node").select(F.col("node").alias("query"), "model", "vec").distinct()
    found = ann.search(queries, nodes, graph, centres, k=11)
    one = found.join(asked.select(F.col("node").alias("query"), F.col("id").cast("bigint").alias("vec_id")), "query")
    both = one.join(members.select("node", F.col("id").cast("bigint").alias("neighbour_id")), "node").where("vec_id <> neighbour_id")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 5)), "neighbour_id"))).where(F.col("rank") <= 10)
    return ranked.select("vec_id", "rank", "neighbour_id", F.round(F.col("sim").cast("double"), 4).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read(spark, sf_dir, "passages")).select("passage_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = read(spark, sf_dir, "passages").select("passage_id", "article_id", "passage_order", "normalized_text", "start_offset")
    return splitting.split_oversized(splitting.recovered_offsets(passages, read(spark, sf_dir, "articles")))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gold_reads")


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.classes_and_links(read(spark, sf_dir, "articles"), _gold(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(*_links(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*_links(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.noise(read(spark, sf_dir, "articles"), read(spark, sf_dir, "pages"), _gold(spark, sf_dir))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.corrected(read(spark, sf_dir, "articles"), _gold(spark, sf_dir), fields=("verbatim_text", "normalized_text"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of articles and article_input with the workflow of the latter, the page of the former."""
    articles, reads = (read(spark, sf_dir, t) for t in ("articles", "article_input"))
    one = articles.select(F.lit("articles").alias("table_name"), F.col("article_id").alias("record_key"), F.col("page_id").alias("source"), F.col("verbatim_text").alias("text"))
    two = reads.select(F.lit("article_input").alias("table_name"), F.col("read_id").alias("record_key"), "source", F.col("verbatim_text").alias("text"))
    return one.unionByName(two)


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records; pages are joined last, without the texts."""
    found = truncation.truncated(_records(spark, sf_dir), _gold(spark, sf_dir))
    workflows = read(spark, sf_dir, "pages").where("page_id is not null").groupBy("page_id").agg(F.min("workflow").alias("workflow"))
    both = found.join(workflows, (F.col("table_name") == "articles") & (F.col("source") == F.col("page_id")), "left")
    return both.withColumn("source", F.when(F.col("table_name") == "articles", F.col("workflow")).otherwise(F.col("source"))).drop("page_id", "workflow")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = truncation.truncated(_records(spark, sf_dir), _gold(spark, sf_dir))
    return found.where("truncated").select("table_name", "record_key").distinct()


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(p6_records(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.cases(read(spark, sf_dir, "articles")).select("article_id", "field").distinct()


def p7_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.unify(read(spark, sf_dir, "articles"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(read(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.measure_pages(read(spark, sf_dir, "documents")).where("spam").select("doc_id").distinct()


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.measure_pages(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_neighbours, p2_search, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_repaired, p6_found, p6_records, p6_sources, p7_found, p7_unified, p8_ids, p9_mix, p9_shares, p10_found, p10_measures)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": "SELECT DISTINCT passage_id FROM passages WHERE ceil(length(normalized_text) / 3.2) > 900",
    }

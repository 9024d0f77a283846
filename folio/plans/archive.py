"""Pipelines: from artifacts to the tables of the index, from a question to its evidence, and the catalogue."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import normalize_index, trimmed
from folio.operators import passages as packing
from folio.operators import search
from folio.operators.tables import first_by
from folio.sources.files import filled


def filename_metadata(path: Column, hints: Column) -> Column:
    """publication, publication_code, issue_date and page_number that a file name tells; null for what it doesn't. hints: a map of codes to names.

    Tokens are divided by anything but letters and digits. The first known code counts, the first month, day and four-digit year that
    make a date, and the first pageN.
    """
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    tokens = F.filter(F.split(stem, r"[^0-9A-Za-zА-Яа-я]+"), lambda t: t != "")
    lowered = F.transform(tokens, F.lower)
    code = F.get(F.filter(lowered, lambda t: F.map_contains_key(hints, t)), F.lit(0))
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - 3)), lambda i: F.slice(tokens, i + 1, 3))
    dates = F.transform(
        F.filter(triples, lambda t: (F.size(t) == 3) & F.forall(t, lambda x: x.rlike(r"^\d+$")) & (F.length(F.get(t, F.lit(2))) == 4) & (F.length(F.get(t, F.lit(0))) <= 2) & (F.length(F.get(t, F.lit(1))) <= 2)),
        lambda t: F.try_to_date(F.concat_ws("-", F.get(t, F.lit(2)), F.lpad(F.get(t, F.lit(0)), 2, "0"), F.lpad(F.get(t, F.lit(1)), 2, "0")), "yyyy-MM-dd"),
    )
    page = F.get(F.filter(lowered, lambda t: t.rlike(r"^page\d+$")), F.lit(0))
    return F.struct(
        F.try_element_at(hints, code).alias("publication"), code.alias("publication_code"), F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)).alias("issue_date"),
        F.regexp_extract(page, r"(\d+)", 1).cast("int").alias("page_number"),
    )


def index_tables(artifacts: DataFrame) -> dict[str, DataFrame]:
    """pages, articles and passages of the strongest artifacts: texts in search form, articles without a text left out, ids from page hash and position."""
    page_id = F.concat(F.lit("page:"), "source_sha256")
    pages = artifacts.select(page_id.alias("page_id"), "source_sha256", F.col("source").alias("source_path"), "articles_path", "workflow", F.to_json("metadata").alias("metadata_json"))
    items = artifacts.select(page_id.alias("page_id"), F.posexplode("articles").alias("pos", "a"))
    text = filled("a.verbatim_text", "a.text")
    source_id = F.coalesce(F.nullif(F.col("a.article_id"), F.lit("")), F.concat(F.lit("article-"), F.col("pos") + 1))
    articles = items.where(trimmed(text) != "").select(
        F.concat("page_id", F.lit(":"), source_id).alias("article_id"), "page_id", source_id.alias("source_article_id"), F.coalesce("a.article_order", F.col("pos") + 1).alias("article_order"),
        filled("a.heading", "a.label").alias("heading"), text.alias("verbatim_text"), normalize_index(text).alias("normalized_text"), F.col("a.confidence").alias("confidence"),
        F.to_json(F.coalesce("a.uncertainties", F.array().cast("array<string>"))).alias("uncertainties_json"),
    )
    return {"pages": pages, "articles": articles, "passages": packing.passages(articles)}


POSTINGS = "term string, passage_id string, tf int, dl int, bucket int"
RUN = "run_id string, started_at timestamp, finished_at timestamp, counts map<string,bigint>"


def write_index(tables: dict[str, DataFrame], path: str, buckets: int = 16) -> dict[str, int]:
    """The tables, and the postings of passages with their statistics, as a new run of the index at path; returns the number of rows of each.

    All goes to a folder of the run's own; only when it is complete, a row is added to path/runs, and from then on searches read this
    run. Should anything fail before, the last run stays what is searched. Postings are partitioned by a hash of the term and sorted by it, so a
    search reads the row groups of its terms only; `buckets` grows with the archive, and each run has its own, which readers find in the data.
    """
    spark = tables["pages"].sparkSession
    run, started = uuid.uuid4().hex, datetime.datetime.now(datetime.UTC)
    to = f"{path}/run-{run}"
    for name, df in tables.items():
        df.write.parquet(f"{to}/{name}")
    # Tables without rows may have no files that tell their schema.
    made = {name: spark.read.schema(df.schema).parquet(f"{to}/{name}") for name, df in tables.items()}
    passages = made["passages"].join(made["articles"].select("article_id", "heading"), "article_id")
    index = search.postings(passages, "passage_id", "heading", "normalized_text").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    index.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    search.corpus_stats(passages, "passage_id", "heading", "normalized_text").withColumn("buckets", F.lit(buckets)).write.parquet(f"{to}/stats")
    counts = {name: df.count() for name, df in {**made, "postings": spark.read.schema(POSTINGS).parquet(f"{to}/postings")}.items()}
    spark.createDataFrame([(run, started, datetime.datetime.now(datetime.UTC), counts)], RUN).coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return counts


def current_index(spark, path: str) -> str:
    """The folder of the last complete run."""
    return f"{path}/run-{spark.read.schema(RUN).parquet(f'{path}/runs').agg(F.max_by('run_id', F.struct('finished_at', 'run_id')).alias('run')).first()['run']}"


def indexed_search(spark, path: str, query: str, k: int = 10) -> DataFrame:
    """The k best (passage_id, score) from the last complete run of a written index: only the buckets of the terms are read."""
    terms = search.expand_terms(query)
    at = current_index(spark, path)
    stats = spark.read.parquet(f"{at}/stats")
    buckets = stats.first()["buckets"]
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()] if terms else []
    index = spark.read.schema(POSTINGS).parquet(f"{at}/postings").where(F.col("bucket").isin(wanted))
    return search.bm25(index, stats, terms, "passage_id").orderBy("score", "passage_id").limit(k)


def archive_passages(passages: DataFrame, articles: DataFrame, pages: DataFrame | None = None, vectors: bool = False, once: bool = True) -> DataFrame:
    """Passages, each delivery once unless the reader takes care of that, with the heading of their article, the publication of its page, and their vectors only if asked for: those are most of the file."""
    columns = ["passage_id", "article_id", "normalized_text", *(["embedding_model", "embedding_json"] if vectors else [])]
    chosen = passages.select(*columns)
    out = (chosen.distinct() if once else chosen).join(articles.select("article_id", "page_id", "heading"), "article_id")
    return out if pages is None else out.join(pages.select("page_id", "publication", "issue_date", "page_number"), "page_id")


def catalogue(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """(publication_code, issue_date, page_number, page_id, n_articles): the pages of each paper, the latest of those with the same issue and number by id."""
    once = first_by(pages.where("publication_code is not null"), ["publication_code", "issue_date", "page_number"], F.desc("page_id"))
    n = articles.groupBy("page_id").agg(F.count("*").alias("n_articles"))
    return once.join(n, "page_id", "left").select("publication_code", "issue_date", "page_number", "page_id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))

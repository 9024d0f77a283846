"""Sources and sinks: artifacts, manifests, images, exports. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import trimmed
from folio.operators.tables import strongest

ARTICLE = "struct<article_id:string,article_order:int,heading:string,label:string,verbatim_text:string,text:string,confidence:double,uncertainties:array<string>,source_anchor:string,regions:string>"
ARTIFACT = f"schema_version string, workflow string, source string, source_sha256 string, metadata map<string,string>, articles array<{ARTICLE}>, _corrupt string"
REGION = "struct<id:string,type:string,article_id:string,parent_id:string,reading_order:int,polygon:array<array<double>>,confidence:double,status:string,accepted_text:string,text:string,read_a:struct<verbatim_text:string>>"
WRAPPED = REGION[:-1] + f",region:{REGION}>"
MANIFEST = (
    f"schema_version string, run_id string, status string, created_at string, pages array<struct<page_id:string,source:struct<path:string,sha256:string,width:int,height:int,qc_status:string>,"
    f"regions:array<{WRAPPED}>>>, review_queue array<struct<page_id:string,region_id:string,reasons:array<string>>>, _corrupt string"
)
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp")


def _json(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)


def filled(*columns: str):
    """The first of several fields that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """One row for each page hash under a folder: the artifact with most articles, then text, confidence and the latest change; unreadable files and ones without a hash are passed over."""
    raw = _json(spark, root, ARTIFACT, "*.articles.json").select("*", F.col("_metadata.file_path").alias("articles_path"), F.col("_metadata.file_modification_time").alias("changed"))
    text = F.transform(F.coalesce("articles", F.array().cast(f"array<{ARTICLE}>")), lambda a: F.coalesce(F.nullif(a["verbatim_text"], F.lit("")), a["text"], F.lit("")))
    kept = F.filter(text, lambda t: trimmed(t) != "")
    scored = raw.where("_corrupt is null and source_sha256 <> ''").select(
        "*", F.size(kept).alias("n_articles"), F.aggregate(F.transform(kept, F.length), F.lit(0), lambda s, x: s + x).alias("n_chars"),
        F.aggregate(F.transform(F.filter("articles", lambda a: trimmed(F.coalesce(F.nullif(a["verbatim_text"], F.lit("")), a["text"], F.lit(""))) != ""), lambda a: F.coalesce(a["confidence"], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x).alias("sum_confidence"),
    )
    return strongest(scored, "source_sha256", ["n_articles", "n_chars", "sum_confidence", "changed"], "articles_path").drop("_corrupt")


def manifests(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """Run manifests that are complete JSON, but for runs that `done` has."""
    found = _json(spark, root, MANIFEST, "*.json").where("_corrupt is null and run_id is not null").drop("_corrupt").dropDuplicates(["run_id"])
    return found if done is None else found.join(done.select("run_id"), "run_id", "left_anti")


def manifest_regions(found: DataFrame) -> DataFrame:
    """(page_id, region_id, article_id, type, reading_order, text, confidence, status, polygon, pos) of manifests: regions flat or under region, the accepted text first."""
    pages = found.select("run_id", F.posexplode("pages").alias("n", "p"))
    stable = F.coalesce(F.nullif("p.page_id", F.lit("")), F.regexp_extract(F.coalesce("p.source.path", F.concat(F.lit("page-"), "n")), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1))
    items = pages.select(F.concat("run_id", F.lit(":"), stable).alias("page_id"), F.posexplode("p.regions").alias("pos", "i"))
    def either(name: str):
        return F.coalesce(F.col(f"i.region.{name}"), F.col(f"i.{name}"))
    return items.select(
        "page_id", F.concat("page_id", F.lit(":"), either("id")).alias("region_id"), F.when(either("article_id") != "", F.concat("page_id", F.lit(":"), either("article_id"))).alias("article_id"),
        either("type").alias("type"), either("reading_order").alias("reading_order"), filled("i.accepted_text", "i.text", "i.read_a.verbatim_text").alias("text"),
        either("confidence").alias("confidence"), F.coalesce("i.status", F.lit("automatic")).alias("status"), either("polygon").alias("polygon"), "pos",
    )


def reviews(found: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, region_id, reasons): regions that wait for their crop to be read, and the manifests' own queue."""
    waiting = regions.where("status = 'needs_crop_transcription'").select("page_id", "region_id", F.array(F.lit("needs_crop_transcription")).alias("reasons"))
    queue = found.select("run_id", F.explode("review_queue").alias("q"))
    page = F.concat("run_id", F.lit(":"), "q.page_id")
    return waiting.unionByName(queue.select(page.alias("page_id"), F.when(F.col("q.region_id") != "", F.concat(page, F.lit(":"), "q.region_id")).alias("region_id"), F.col("q.reasons").alias("reasons")))


def images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, name, bytes, changed, sha256): image files under a folder, by suffix; hashed only if asked to, for that reads them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))
    base = [F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed")]
    return kept.select(*base, F.sha2("content", 256).alias("sha256")) if content else kept.select(*base, F.lit(None).cast("string").alias("sha256"))


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """A stream of images as they land in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGES))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, in place of what was there; the committer makes it visible at once."""
    df.write.mode("overwrite").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A table that may never be written over."""
    df.write.mode("errorifexists").parquet(path)


def markdown(articles: DataFrame, by: str = "page_id") -> DataFrame:
    """(by, value): a page's articles as sections, in order of (article_order, article_id); a first paragraph that repeats the heading is left out."""
    text = F.coalesce("verbatim_text", F.lit(""))
    first = F.split_part(text, F.lit("\n\n"), F.lit(1))
    body = F.when(trimmed(first) == trimmed(F.coalesce("heading", F.lit(""))), F.substring(text, F.length(first) + 3, F.length(text))).otherwise(text)
    section = F.concat(F.when(trimmed(F.coalesce("heading", F.lit(""))) != "", F.concat(F.lit("## "), trimmed(F.col("heading")), F.lit("\n\n"))).otherwise(F.lit("")), body)
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("article_order", F.lit(1 << 30)).alias("o"), "article_id", section.alias("s"))))
    return articles.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n\n").alias("value"))


def inside(root: str, path: str) -> str:
    """The real path, if it lies under root."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base:
        raise ValueError("the path leads out of the archive")
    return real

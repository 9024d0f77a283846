"""Entities by pattern, and the graph of their mentions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import slug

#: Names of two to four capitalized words, quoted names in capitals, dates.
NAME = re.compile(r"\b[А-ЯѢ][а-яѣъь]+(?:\s+[А-Я][а-яѣъь]+){1,3}\b")
QUOTED = re.compile(r"[„\"]([А-ЯѢ]{2,}(?:\s+[А-ЯѢ]{2,}){1,3})[“\"]")
DATE = re.compile(r"\b(?:[0-3]?\d[.\-/][01]?\d[.\-/](?:18|19|20)\d{2}|(?:18|19|20)\d{2}\s*г\.)\b")
#: What the first two need, so that texts without it stay in the JVM.
_WORTH = r"[А-ЯѢ]|\d{4}"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, kind, name, begin, end = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for what, pattern, group in (("named_entity", NAME, 0), ("named_entity", QUOTED, 1), ("date", DATE, 0)):
                for m in pattern.finditer(text):
                    row.append(i)
                    kind.append(what)
                    name.append(m[group])
                    begin.append(m.start(group))
                    end.append(m.end(group))
        made = [pa.array(kind, pa.string()), pa.array(name, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *made], ["article_id", "kind", "name", "start_offset", "end_offset"])


def mentions(articles: DataFrame, text: str = "verbatim_text") -> DataFrame:
    """(article_id, kind, name, start_offset, end_offset, entity_id): every mention, with its place in the text."""
    kept = articles.where(F.col(text).rlike(_WORTH)).select("article_id", text)
    found = kept.mapInArrow(_extract, "article_id string, kind string, name string, start_offset int, end_offset int")
    return found.withColumn("entity_id", F.concat_ws(":", "kind", slug(F.col("name"))))


def entities(found: DataFrame) -> DataFrame:
    """(entity_id, kind, canonical_name, mentions, articles): one row for each entity; its name is the smallest that it was found under."""
    return found.groupBy("entity_id").agg(F.min("kind").alias("kind"), F.min("name").alias("canonical_name"), F.count("*").alias("mentions"), F.count_distinct("article_id").alias("articles"))


def neighbourhood(found: DataFrame, entity_id: str) -> DataFrame:
    """The mentions of one entity, in order."""
    return found.where(F.col("entity_id") == entity_id).select("entity_id", F.lit("mentioned_in").alias("predicate"), F.col("article_id").alias("object_id"), "name", "start_offset", "end_offset")


def together(found: DataFrame) -> DataFrame:
    """(a, b, articles): in how many articles two entities occur. Pairs are formed within each article only, over its distinct entities."""
    once = found.select("article_id", "entity_id").distinct()
    other = once.withColumnRenamed("entity_id", "other")
    return once.join(other, "article_id").where("entity_id < other").groupBy(F.col("entity_id").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("articles"))

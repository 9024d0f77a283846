"""Packing paragraphs into passages for retrieval, with offsets into the article."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.2
_WORDS, _BREAK = re.compile(r"\S+"), re.compile(r"\n\n")


def tokens(n: int) -> int:
    return math.ceil(n / CHARS_PER_TOKEN)


def hard_split(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Spans of a paragraph with as many words as fit into `most` tokens; a longer word is a span of its own."""
    out: list[list[int]] = []
    for m in _WORDS.finditer(text, start, end):
        if out and tokens(m.end() - out[-1][0]) <= most:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    return [(a, b) for a, b in out]


def pack(text: str, least: int = 500, most: int = 900) -> list[tuple[str, int, int]]:
    """(passage, begin, end): paragraphs packed in order as long as they fit, joined by blank lines; a last one under `least` goes to the one before if it fits."""
    begin, stop = len(text) - len(text.lstrip()), len(text.rstrip())
    if begin >= stop:
        return []
    if tokens(len(text)) <= most:
        return [(text[begin:stop], begin, stop)]
    units: list[tuple[int, int]] = []
    at = 0
    for edge in [*(m.span() for m in _BREAK.finditer(text)), (len(text), len(text))]:
        raw = text[at : edge[0]]
        a, b = at + len(raw) - len(raw.lstrip()), at + len(raw.rstrip())
        at = edge[1]
        if a < b:
            units += hard_split(text, a, b, most) if tokens(b - a) > most else [(a, b)]
    groups: list[list[tuple[int, int]]] = []
    size = 0
    for a, b in units:
        grown = size + 2 + b - a
        if groups and tokens(grown) <= most:
            groups[-1].append((a, b))
            size = grown
        else:
            groups.append([(a, b)])
            size = b - a

    def length(group: list[tuple[int, int]]) -> int:
        return sum(b - a for a, b in group) + 2 * (len(group) - 1)

    if len(groups) > 1 and tokens(length(groups[-1])) < least and tokens(length(groups[-2]) + 2 + length(groups[-1])) <= most:
        groups[-2] += groups.pop()
    return [("\n\n".join(text[a:b] for a, b in g), g[0][0], g[-1][1]) for g in groups]


def _pack(least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, order, begin, end, out = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, (passage, a, b) in enumerate(pack(text or "", least, most), 1):
                    row.append(i)
                    order.append(n)
                    begin.append(a)
                    end.append(b)
                    out.append(passage)
            keys = batch.column(0).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(order, pa.int32()), pa.array(out, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["article_id", "passage_order", "normalized_text", "start_offset", "end_offset"])

    return run


def passages(articles: DataFrame, least: int = 500, most: int = 900) -> DataFrame:
    """(passage_id, article_id, passage_order, normalized_text, start_offset, end_offset, estimated_tokens) of (article_id, normalized_text)."""
    done = articles.select("article_id", "normalized_text").mapInArrow(_pack(least, most), "article_id string, passage_order int, normalized_text string, start_offset int, end_offset int")
    return done.select(F.concat("article_id", F.lit(":passage:"), "passage_order").alias("passage_id"), "*", F.ceil(F.length("normalized_text") / F.lit(CHARS_PER_TOKEN)).cast("int").alias("estimated_tokens"))

"""Splitting texts over a token limit at natural boundaries, into pieces of about equal length."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Estimated tokens: length in code points divided by this, rounded up.
CHARS_PER_TOKEN = 3.2
#: Boundaries by falling strength: what ends at each, and how strong it is. The cut is after the match.
BOUNDARIES = (
    (re.compile(r"\n[^\S\n]*\n\s*"), 6.0),
    (re.compile(r"[.!?…][\"'”“»’)\]]*\s+(?=[^\W_a-zа-я]|[„“«\"'(])"), 4.0),
    (re.compile(r"[.!?…;:][\"'”“»’)\]]*\s+"), 3.0),
    (re.compile(r"\n\s*"), 2.5),
    (re.compile(r"[,–—][\"'”“»’)\]]*\s+"), 2.0),
    (re.compile(r"\s+"), 1.0),
)


def boundaries(text: str) -> tuple[list[int], list[float]]:
    """Places to cut in order, and the strength of each."""
    found: dict[int, float] = {}
    for pattern, strength in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            found[m.end()] = strength
    found.pop(len(text), None)
    found.pop(0, None)
    at = sorted(found)
    return at, [found[i] for i in at]


def _snap(at: list[int], strength: list[float], target: float, low: float, high: float, reach: float) -> int | None:
    """The strongest boundary between low and high, of which distance from the target takes away."""
    best, place = -math.inf, None
    for k in range(bisect_left(at, low), len(at)):
        if at[k] > high:
            break
        score = strength[k] - 3.0 * abs(at[k] - target) / reach
        if score > best:
            best, place = score, at[k]
    return place


def pieces(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of at most `most` characters that cover the text; successive ones share about `overlap` characters.

    The fewest possible pieces are tried first: equal targets, each snapped to the strongest boundary near it. As long as the last
    piece gets too long, for the others are kept short enough, there are more pieces, so the targets lie closer. Where there is no
    boundary at all, the cut is at the target itself. Targets move by a quarter of what a piece has beside its overlap at most, so all
    pieces fit at four times the least count if not before.
    """
    n = len(text)
    if n <= most:
        return [(0, n)]
    overlap = max(0, min(overlap, most // 2 - 1))
    at, strength = boundaries(text)
    count = math.ceil((n - overlap) / (most - overlap))
    while True:
        out = _placed(at, strength, n, most, overlap, count)
        if out[-1][1] - out[-1][0] <= most:
            return out
        # Very long texts take more pieces at a time.
        count += max(1, count // 64)


def _placed(at: list[int], strength: list[float], n: int, most: int, overlap: int, count: int) -> list[tuple[int, int]]:
    """So many pieces, all but the last of at most `most` characters."""
    step = (n - overlap) / count
    reach, back = min((step + overlap) / 4, (most - overlap) / 4), min(overlap / 2, (most - overlap) / 4)
    out: list[tuple[int, int]] = []
    start = 0
    for i in range(count - 1):
        target = (i + 1) * step + overlap
        low, high = max(start + overlap + 1, target - reach), min(start + most, target + reach)
        end = _snap(at, strength, target, low, high, reach) if high > low else None
        end = max(start + 1, min(end if end is not None else round(target), start + most))
        out.append((start, end))
        again = _snap(at, strength, end - overlap, max(start + 1, end - overlap - back), end - overlap + back, max(back, 1)) if overlap else end
        start = max(start + 1, again if again is not None else end - overlap)
    return [*out, (start, n)]


def _split(most: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, number, begin, end, text = [], [], [], [], []
            for row, whole in enumerate(batch.column(1).to_pylist()):
                for k, (s, e) in enumerate(pieces(whole, most, overlap)):
                    parent.append(row)
                    number.append(k)
                    begin.append(s)
                    end.append(e)
                    text.append(whole[s:e])
            keys = batch.column(0).take(pa.array(parent, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(number, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string()),
                 pa.array([math.ceil(len(t) / CHARS_PER_TOKEN) for t in text], pa.int32())],
                ["__key", "piece_no", "__from", "__to", "piece_text", "piece_tokens"],
            )

    return run


def split_oversized(passages: DataFrame, limit: int = 900, overlap: int = 50) -> DataFrame:
    """(passage_id, article_id, piece_no, start_offset, end_offset, piece_text, piece_tokens) of the passages over the limit.

    A passage is oversized if its text has more than `limit` estimated tokens, whatever its own estimate says. Offsets are those
    of the piece in the article: null where the passage's are. Null and empty texts, and texts at the limit, give no rows;
    identical deliveries count once; an empty table gives none; other columns are not read. Only oversized rows leave the JVM.
    A text without any boundary is cut at the even targets. The overlap is exact up to half of it, for the sake of a boundary.
    """
    most = math.floor(limit * CHARS_PER_TOKEN)
    kept = passages.where(F.length("normalized_text") > most).select(
        F.struct("passage_id", "article_id", F.col("start_offset").cast("int").alias("start_offset")).alias("__key"), F.col("normalized_text").alias("__text")
    )
    schema = f"__key {kept.schema['__key'].dataType.simpleString()}, piece_no int, __from int, __to int, piece_text string, piece_tokens int"
    done = kept.mapInArrow(_split(most, math.floor(overlap * CHARS_PER_TOKEN), limit), schema)
    start = F.col("__key.start_offset")
    return done.select(
        "__key.passage_id", "__key.article_id", "piece_no", (start + F.col("__from")).alias("start_offset"), (start + F.col("__to")).alias("end_offset"), "piece_text", "piece_tokens"
    ).distinct()


def recovered_offsets(passages: DataFrame, articles: DataFrame) -> DataFrame:
    """The passages, null start offsets filled in where the passage's text stands word for word in its article. Passages that have one pass by.

    A text that its article has several times is looked for from the start of the last passage before it, by passage_order, whose offset is
    known; without a passage_order, and where nothing is found from there on, the first place counts.
    """
    order = Window.partitionBy("article_id").orderBy("passage_order").rangeBetween(Window.unboundedPreceding, -1)
    before = passages.select("passage_id", "article_id", "passage_order", "start_offset").distinct().withColumn("__after", F.max("start_offset").over(order))
    before = before.where("start_offset is null and __after is not null").groupBy(F.col("passage_id").alias("__id"), F.col("article_id").alias("__of")).agg(F.max("__after").alias("__after"))
    unknown = passages.where(F.col("start_offset").isNull())
    texts = articles.select(F.col("article_id").alias("__of"), F.col("normalized_text").alias("__article"))
    known = unknown.join(texts, F.col("article_id") == F.col("__of"), "left").drop("__of").join(before, (F.col("passage_id") == F.col("__id")) & (F.col("article_id") == F.col("__of")), "left")
    place = F.expr("locate(normalized_text, __article, coalesce(__after, -1) + 2)")
    place = F.when(place > 0, place).otherwise(F.expr("instr(__article, normalized_text)"))
    found = known.withColumn("start_offset", F.when(place > 0, (place - 1).cast("int")))
    return passages.where(F.col("start_offset").isNotNull()).unionByName(found.select(passages.columns))

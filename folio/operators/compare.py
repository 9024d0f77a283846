"""Comparing two reads of a text: differences, edits, agreement, overlap, truncation. Rows are (id, a, b); Arrow batches go to Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Differences kept, words and characters shown around one, and words that tell of a lost ending.
MOST_DIFFERENCES, WORDS_AROUND, CHARACTERS_AROUND, ENDING_WORDS = 80, 5, 80, 8
#: A block that leaked across articles has so many words, such a part of the shorter text, so near an end.
BLOCK_WORDS, BLOCK_PART, BLOCK_REACH = 60, 0.35, 8
_OWN = re.compile(r"\w+")
_ABRUPT = re.compile(r"\w-$|[,;:—–(\[«]$")


def _over(df: DataFrame, columns: list[str | Column], row: Callable, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """df's first column, and what `row` makes of the others: one tuple, or a list of them.

    A row costs far more time than its size tells, so rows are spread over all cores first, which adaptive execution doesn't undo.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, values in enumerate(zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)):
                made = row(*values)
                for x in made if isinstance(made, list) else [made]:
                    at.append(i)
                    out.append(x)
            columns_ = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(list(c), k) for c, k in zip(columns_, kinds, strict=True)]], ["id", *names])

    spark = df.sparkSession
    kept = df.select(*columns).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return kept.mapInArrow(run, f"id {kept.schema[0].dataType.simpleString()}, {schema}")


def comparison_form(text: str) -> str:
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in unicodedata.normalize("NFC", text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return "\n".join(lines).strip("\n")


def differences(a: str, b: str) -> tuple[bool, float, int, list[dict]]:
    """(equal, similarity, how many differences, the first of them)."""
    a, b = comparison_form(a), comparison_form(b)
    x, y = a.split(), b.split()
    found = [op for op in SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes() if op[0] != "equal"]
    around = WORDS_AROUND
    kept = [
        {"kind": kind, "a": " ".join(x[i:j]), "b": " ".join(y[k:l]), "a_window": " ".join(x[max(0, i - around) : j + around]), "b_window": " ".join(y[max(0, k - around) : l + around])}
        for kind, i, j, k, l in found[:MOST_DIFFERENCES]
    ]
    if not found and a != b:
        return False, SequenceMatcher(a=a, b=b, autojunk=False).ratio(), 1, [{"kind": "line_or_paragraph_break", "a": a, "b": b, "a_window": None, "b_window": None}]
    return a == b, SequenceMatcher(a=a, b=b, autojunk=False).ratio() if a != b else 1.0, len(found), kept


_DIFFERENCE = pa.struct([(n, pa.string()) for n in ("kind", "a", "b", "a_window", "b_window")])


def text_comparison(reads: DataFrame) -> DataFrame:
    """(id, lexically_equal, similarity, difference_count, differences) of (id, a, b); null counts as ''."""
    schema = "lexically_equal boolean, similarity double, difference_count int, differences array<struct<kind:string,a:string,b:string,a_window:string,b_window:string>>"
    return _over(reads, ["id", "a", "b"], differences, schema, ["lexically_equal", "similarity", "difference_count", "differences"], [pa.bool_(), pa.float64(), pa.int32(), pa.list_(_DIFFERENCE)])


def edits(a: str, b: str) -> list[tuple]:
    """Exact character edits that turn a into b."""
    a, b, n = a or "", b or "", CHARACTERS_AROUND
    found = [op for op in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if op[0] != "equal"]
    return [(m, kind, a[i:j], b[k:l], a[max(0, i - n) : j + n], b[max(0, k - n) : l + n], i, j, k, l) for m, (kind, i, j, k, l) in enumerate(found)]


def edit_script(reads: DataFrame) -> DataFrame:
    """One row for each edit of (id, a, b): (id, edit_no, kind, a, b, a_window, b_window, a_from, a_to, b_from, b_to)."""
    names = ["edit_no", "kind", "a", "b", "a_window", "b_window", "a_from", "a_to", "b_from", "b_to"]
    kinds = [pa.int32(), *[pa.string()] * 5, *[pa.int32()] * 4]
    schema = ", ".join(f"{n} {'int' if k == pa.int32() else 'string'}" for n, k in zip(names, kinds, strict=True))
    return _over(reads, ["id", "a", "b"], edits, schema, names, kinds)


def applied(reads: DataFrame, script: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, text): a with the edits (id, edit_no) that were accepted; pieces of a between edits stay."""
    chosen = script.join(accepted.select("id", "edit_no").distinct().withColumn("yes", F.lit(True)), ["id", "edit_no"], "left")
    listed = chosen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a_from", "a_to", F.when(F.col("yes"), F.col("b")).otherwise(F.col("a")).alias("piece")))).alias("es"))
    both = reads.select("id", F.coalesce("a", F.lit("")).alias("a")).join(listed, "id", "left").withColumn("es", F.coalesce("es", F.array().cast("array<struct<a_from:int,a_to:int,piece:string>>")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    built = F.aggregate(
        "es", start, lambda s, e: F.struct(F.concat(s["text"], F.substring(F.col("a"), s["at"] + 1, e["a_from"] - s["at"]), e["piece"]).alias("text"), e["a_to"].alias("at")),
        lambda s: F.concat(s["text"], F.substring(F.col("a"), s["at"] + 1, F.length("a"))),
    )
    return both.select("id", built.alias("text"))


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def error_rates(reads: DataFrame) -> DataFrame:
    """(id, cer, wer) of (id, a, b): a is the reference. Edit distance of characters (in the JVM) and of words, by the reference's length, 1 at least."""
    plain = reads.select("id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    chars = plain.select("id", "a", "b", (F.levenshtein("a", "b") / F.greatest(F.lit(1), F.length("a"))).alias("cer"))
    return _over(chars, ["id", "a", "b", "cer"], lambda a, b, cer: (cer, distance(a.split(), b.split()) / max(1, len(a.split()))), "cer double, wer double", ["cer", "wer"], [pa.float64(), pa.float64()])


def agreement(reads: DataFrame) -> DataFrame:
    """(id, agreement) of (id, a, b): the share of matching blocks, case and white space ignored."""

    def one(a: str, b: str) -> tuple[float]:
        x, y = (" ".join((t or "").lower().split()) for t in (a, b))
        return (1.0 if x == y else SequenceMatcher(None, x, y).ratio(),)

    return _over(reads, ["id", "a", "b"], one, "agreement double", ["agreement"], [pa.float64()])


def _tokens(text: str) -> list[str]:
    return _OWN.findall(unicodedata.normalize("NFC", text or "").casefold())


def signals(a: str, b: str) -> tuple[list[str]]:
    out = [f"{n}_ends_abruptly" for n, t in (("a", a), ("b", b)) if _ABRUPT.search((t or "").rstrip())]
    x, y = _tokens(a), _tokens(b)
    for kind, i, j, k, l in SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
        if kind != "equal" and j >= len(x) - 3 and l >= len(y) - 3 and abs((l - k) - (j - i)) >= ENDING_WORDS:
            more = (l - k) - (j - i)
            out.append(f"b_has_{more}_more_ending_words" if more > 0 else f"a_has_{-more}_more_ending_words")
    return (list(dict.fromkeys(out)),)


def truncation_signals(reads: DataFrame) -> DataFrame:
    """(id, signals) of (id, a, b)."""
    return _over(reads, ["id", "a", "b"], signals, "signals array<string>", ["signals"], [pa.list_(pa.string())])


def shared_block(a: str, b: str) -> list[tuple[int, float]]:
    x, y = _tokens(a), _tokens(b)
    shorter = min(len(x), len(y))
    if shorter < BLOCK_WORDS:
        return []
    m = SequenceMatcher(a=x, b=y, autojunk=False).find_longest_match()
    near = min(m.a, len(x) - m.a - m.size, m.b, len(y) - m.b - m.size) <= BLOCK_REACH
    return [(m.size, round(m.size / shorter, 3))] if m.size >= BLOCK_WORDS and m.size >= BLOCK_PART * shorter and near else []


def boundary_overlap(articles: DataFrame, page: str = "page_id", key: str = "article_id", text: str = "verbatim_text") -> DataFrame:
    """(id: struct<page, first, second>, words, shorter_fraction): long blocks that two articles of a page share near an end.

    Only pairs that share a run of eight words are compared; articles shorter than a block never are.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = articles.select(page, F.col(key).alias("k"), F.col(text).alias("t"), words.alias("w")).where(F.size("w") >= BLOCK_WORDS)
    # A block of BLOCK_WORDS words holds a whole run at a multiple of eight of either text.
    marks = kept.select(page, "k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " "))))).alias("h"), F.lit(0).alias("z"))
    steps = kept.select(page, F.col("k").alias("k2"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7, F.lit(8)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " "))))).alias("h"))
    met = marks.join(steps, [page, "h"]).where("k <> k2").select(page, F.least("k", "k2").alias("first"), F.greatest("k", "k2").alias("second")).distinct()
    texts = kept.select(page, "k", "t")
    both = met.join(texts.select(page, F.col("k").alias("first"), F.col("t").alias("a")), [page, "first"]).join(texts.select(page, F.col("k").alias("second"), F.col("t").alias("b")), [page, "second"])
    return _over(both, [F.struct(page, "first", "second").alias("id"), "a", "b"], shared_block, "words int, shorter_fraction double", ["words", "shorter_fraction"], [pa.int32(), pa.float64()])

"""Finding texts that stop before they end, and how often each source truncates.

Evidence comes from a self-join by prefix: all texts, reduced to letters and digits, are sorted across the cluster; a value is a
strict prefix of a longer one exactly if it begins its successor, so neighbours are all that is compared, whatever the number of
copies or of texts with the same beginning. Where a longer copy is known, it decides, by how it goes on there: in the same word or the same
sentence, and the text was cut. How a text ends decides where none is known, or where the copy goes on with another sentence; an ending that
whole texts also have (a signature, verse, a list) counts only with a longer copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.ocr import HYPHENS, Model, plain, read_page, trained
from folio.session import written

#: Marks that are left where a text was cut; an ellipsis at the very end is one.
MARK = re.compile(r"(?:\[[^\]\n]{0,40}(?:truncated|cut off|съкратено|отрязано)[^\]\n]{0,20}\]|<[^>\n]{0,30}truncated[^>\n]{0,20}>|�|…|\.{3}\s?[)\]]?)\W*$", re.I)
#: A mark or a note at the end, and a line of a list, are no longer than this.
REACH = 200
#: Endings of whole texts without a full stop.
INSTALMENT = re.compile(r"\((?:[^()\n]{0,40}\b)?(?:следва\w*|продълж\w*|край\w*|to be continued|continued|fortsetzung\b[^()\n]*|schlu(?:ss|ß)\b[^()\n]*|à suivre|a suivre|suite\b[^()\n]*|fin)\.?\)?\W*$", re.I)
_END = re.compile(r"[.!?][\"'”“»’)\]]*$")
_INITIAL = re.compile(r"(?:^|[\s„“«\"(])[^\W\d_]\.$")
_SIGNATURE = re.compile(r"(?:[—–-]\s*)?(?:[^\W\d_a-zа-я]\.\s?){1,2}[^\W\d_a-zа-я][^\W\d_]+(?:-[^\W\d_]+)?")
_LIST_LINE = re.compile(r".*\S\s+\d+(?:[.,:]\d+)?\D{0,4}$")
_DONE = re.compile(r"[.!?…:;][\"'”“»’)\]]*$")


def ending(text: str, model: Model) -> str:
    """How a text ends: marked or open, which is cut; done; or, possibly whole, instalment, signature, list or verse."""
    text = plain(text).rstrip()
    if not text:
        return "done"
    if MARK.search(text[-REACH:]):
        return "marked"
    paragraphs, _, _ = read_page(text, model)
    if not paragraphs:
        return "done"
    blocks = [[x.strip() for x in p] for p in paragraphs]
    last = blocks[-1][-1]
    if INSTALMENT.search(last[-REACH:]):
        return "instalment"
    if _END.search(last) and not _INITIAL.search(last):
        return "done"
    if _SIGNATURE.fullmatch(" ".join(blocks[-1])):
        return "signature"
    lines = [x for b in blocks for x in b]
    listed = [len(x) <= REACH and len(x.split()) <= 6 and bool(_LIST_LINE.fullmatch(x)) for x in lines]
    if sum(listed) * 2 > len(lines) and listed[-1]:
        return "list"
    # Verse: short lines, and most stanzas before the last, which is no shorter than they, end without a full stop.
    before = blocks[:-1]
    if len(before) >= 1 and sum(not _DONE.search(b[-1]) for b in before) * 2 > len(before) and len(lines) > len(blocks) and len(blocks[-1]) >= min(map(len, before)):
        return "verse"
    return "open"


#: Endings that are cut in themselves, and ones that are if a longer copy goes on.
CUT, PERHAPS = ("marked", "open"), ("signature", "list", "verse")


_LETTERS = re.compile(r"[^\W_]+")
_SAME_WORD = re.compile(rf"[{HYPHENS}]\s*\n\s*|[^\s!-/:-@\[-`{{-~–—„“”«»‘’…]*")


def following(text: str, n: int) -> str:
    """How a text goes on after its first n letters and digits: in the same word, sentence or abbreviation's sentence; with a new paragraph; or it is the end of a sentence."""
    seen = 0
    last = None
    for m in _LETTERS.finditer(text):
        if last is not None:
            gap = text[last:m.start()]
            if _SAME_WORD.fullmatch(gap):
                return "word"
            if re.search("[.!?…]", gap):
                return "abbreviation" if m[0][0].islower() else "end"
            return "paragraph" if re.search(r"\n\s*\n", gap) else "sentence"
        seen += len(m[0])
        if seen > n:
            return "word"
        if seen == n:
            last = m.end()
    return "end"


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [following(t, n) for t, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string())], ["a", "b", "follows"])


def _endings(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ending(t, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["__key", "ending"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value once for each task: however many copies a text has, no task gets more of them than there are tasks."""
    known: set[tuple[int, int]] = set()
    for batch in batches:
        first = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first.append(key not in known)
            known.add(key)
        yield batch.filter(pa.array(first, pa.bool_()))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of values in order: the ids of those that begin their successor, and the successor's, and the first and last value of the partition."""
    last = first = None
    part = TaskContext.get().partitionId()
    names = ["a", "b", "a2", "b2", "part", "first", "last", "first_a", "first_b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        found = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if last is None:
                first = row
            elif len(row[2]) > len(last[2]) and row[2].startswith(last[2]):
                found.append((*last[:2], *row[:2], None, None, None, None, None))
            last = row
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True)], names)
    if last is not None:
        edge = (*last[:2], None, None, part, first[2], last[2], *first[:2])
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(edge, kinds, strict=True)], names)


def begun_elsewhere(texts: DataFrame) -> DataFrame:
    """(a, b, a2, b2): of (a, b, value), the ids of the values that are strict prefixes of another value, and of the next such one."""
    ordered = texts.mapInArrow(_once, texts.schema).repartitionByRange("value").sortWithinPartitions("value")
    schema = "a bigint, b bigint, a2 bigint, b2 bigint, part int, first string, last string, first_a bigint, first_b bigint"
    found = written(ordered.mapInArrow(_neighbours, schema), "prefixes")
    # Values at the edges of partitions: one row for each partition.
    order = Window.orderBy("part")
    edges = found.where("part is not null").select("a", "b", "last", *[F.lead(c).over(order).alias(c) for c in ("first", "first_a", "first_b")])
    across = edges.where(F.col("first").startswith(F.col("last")) & (F.length("first") > F.length("last"))).select("a", "b", F.col("first_a").alias("a2"), F.col("first_b").alias("b2"))
    return found.where("part is null").select("a", "b", "a2", "b2").unionByName(across)


def truncated(records: DataFrame, gold: DataFrame) -> DataFrame:
    """(table_name, record_key, source, ending, longer_copy, follows, truncated, evidence) of records (table_name, record_key, source, text).

    Every distinct record gives a row. ending: see ending(); null and blank texts are done and not truncated, whatever stands elsewhere.
    longer_copy: another record's text begins with all of this one's letters and digits and goes on; follows: how (see following()). A text
    is truncated by evidence of its copy if that goes on in the same word or sentence, and this one doesn't close with a full stop that the copy
    hasn't there; by evidence of its ending if that is open or marked, or, with a longer copy, another than a full stop. Null keys and sources
    are kept; repeated rows count once; no records give no rows. Texts that plainly end with a full stop are told in the JVM. Only letters and
    digits are written and sorted; texts are read again where they are needed.
    """
    value = F.regexp_replace(F.lower("text"), r"(?:\[[^\]\n]{0,40}truncated[^\]\n]{0,20}\]|<[^>\n]{0,30}truncated[^>\n]{0,20}>)\s*$", "")
    value = F.coalesce(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""), F.lit(""))
    keyed = records.select(F.xxhash64("text").alias("t"), value.alias("value"))
    kept = written(keyed.where("value <> ''").select("t", "value", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b")), "values")
    prefixes = written(begun_elsewhere(kept.select("a", "b", "value")).distinct(), "begun")
    # The texts of both sides, by their hashes; of the longer ones any will do.
    shorter = kept.join(prefixes, ["a", "b"]).groupBy("t", "a", "b", "a2", "b2").agg(F.max(F.length("value")).alias("n"))
    shorter = written(shorter, "shorter")
    longer = kept.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("t").alias("t2")).join(prefixes.select("a2", "b2").distinct(), ["a2", "b2"]).groupBy("a2", "b2").agg(F.min("t2").alias("t2"))
    pairs = shorter.select("a", "b", "a2", "b2", "n").distinct().join(longer, ["a2", "b2"])
    read_again = records.select(F.xxhash64("text").alias("t2"), "text").join(pairs, "t2").select("a", "b", "n", "text")
    follows = read_again.mapInArrow(_followed, "a bigint, b bigint, follows string").groupBy("a", "b").agg(F.min("follows").alias("follows"))
    known = shorter.join(follows, ["a", "b"]).groupBy("t").agg(F.min("follows").alias("follows"))
    done = F.coalesce(F.trim("text"), F.lit("")).rlike(r"(^|[\p{L}\d]{2}[\"'”“»’)\]]{0,2}[.!?][\"'”“»’)\]]{0,2})$")
    columns = ["table_name", "record_key", "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t")]
    plainly = records.where(done).select(*columns, F.lit("done").alias("ending"))
    rest = records.where(~done).select(F.struct(*columns).alias("__key"), "text")
    looked = rest.mapInArrow(_endings(trained(gold)), f"__key {rest.schema['__key'].dataType.simpleString()}, ending string").select("__key.*", "ending")
    joined = plainly.unionByName(looked).distinct().join(known, "t", "left")
    copied, stops = F.col("follows").isNotNull(), F.col("ending").isin("done", "instalment")
    by_copy = copied & ((F.col("follows") == "abbreviation") | (F.col("follows").isin("word", "sentence") & ~stops))
    by_ending = F.col("ending").isin(*CUT) | (F.col("ending").isin(*PERHAPS) & copied)
    evidence = F.when(by_copy, F.lit("copy")).when(by_ending, F.lit("ending"))
    return joined.select("table_name", "record_key", "source", "ending", copied.alias("longer_copy"), "follows", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"))


def by_source(found: DataFrame) -> DataFrame:
    """(table_name, source, records, truncated, share): how often each source truncates."""
    return found.groupBy("table_name", "source").agg(F.count("*").alias("records"), F.count_if("truncated").alias("truncated")).withColumn("share", F.col("truncated") / F.col("records"))

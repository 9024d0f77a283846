"""Near-duplicate articles by anchor points of a covering code.

A text becomes BLOCKS fingerprints, each a word of SYMBOLS min-hash values modulo 2^16 of its runs of three words. The anchors are the
words of the parity-check code, whose symbols sum to 0: changing any one symbol of a word can make the sum 0, so the code covers
every word with radius 1, and a word has SYMBOLS anchors at that radius. Two words that differ in one symbol (the threshold) become the
same anchor when that symbol is changed in both; so it suffices to send each word to the anchors within the radius, and the ring of
anchors at radius plus threshold, 2, need not be filled. Texts that meet at an anchor are compared by their sets of runs.

A pair of similarity J meets in a block with probability J^4 + 4 J^3 (1 - J), so it is missed by all 20 with 0.02 at J = 0.4, 0.0005 at 0.5
and 2e-6 at 0.6. Texts with the same set of runs are one class, which is compared once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.llm.batches import sliced
from folio.llm.ocr import SIGNS, Model, repaired, trained
from folio.llm.unify import AS_LATIN, CYRILLIC, GREEK, GREEK_AS_LATIN
from folio.session import written

RUN, BLOCKS, SYMBOLS, SIMILARITY = 3, 20, 4, 0.4
#: At an anchor with more classes than this, pairs are found by their rarest runs instead.
CROWD = 1_000

_LOOKS = str.maketrans(CYRILLIC + GREEK, AS_LATIN + GREEK_AS_LATIN)
#: Signs and digits that scanners read for Latin and for Cyrillic letters of their shape. To compare texts, it doesn't matter which are.
_SIGNED = [str.maketrans("015¦†~|", "oisrtal"), str.maketrans("08^|•634", "оатлмбзч")]
_WORDS = re.compile(rf"[\w{re.escape(SIGNS)}]+")
_PLAIN = re.compile(r"[^\W_]+")
_CYRILLIC = re.compile("[а-я]")
_RNG = np.random.default_rng(20_240_611)
_MULTIPLY = _RNG.integers(1, 1 << 63, BLOCKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BLOCKS * SYMBOLS, dtype=np.uint64)
_BLOCK = _RNG.integers(1, 1 << 63, BLOCKS, dtype=np.uint64)
_RUN = _RNG.integers(1, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a repaired text, case ignored."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    out = []
    for w in found:
        if w.isalpha() or w.isdigit():
            out.append(w)
        else:
            # Signs and digits among letters are the letters they were taken from.
            out += _PLAIN.findall(w.translate(_SIGNED[bool(_CYRILLIC.search(w))]) if any(map(str.isalpha, w)) else w)
    return out


def runs(found: list[str], known: dict[str, int]) -> np.ndarray:
    """The distinct runs of three words, look-alike letters being the same, as sorted hashes; of a text with fewer words all of it is the one run."""
    import xxhash

    if not found:
        return np.empty(0, np.uint64)
    ids = []
    for w in found:
        i = known.get(w)
        if i is None:
            if len(known) > 500_000:
                known.clear()
            i = known[w] = xxhash.xxh3_64_intdigest(w.translate(_LOOKS))
        ids.append(i)
    n = max(1, len(ids) - RUN + 1)
    ids += [0] * (RUN - len(ids))
    code = np.array(ids, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out = (out ^ code[k : k + n]) * _RUN[k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def anchors(found: np.ndarray) -> np.ndarray:
    """The anchors of a set of runs, within radius 1 of its fingerprints."""
    low = np.empty(BLOCKS * SYMBOLS, np.uint64)
    found = (found ^ (found << np.uint64(21))) * _MIX
    for k in range(0, len(found), 4096):
        hashed = (found[None, k : k + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1)
        low = hashed if k == 0 else np.minimum(low, hashed)
    low = (low ^ (low >> np.uint64(31))) * _MIX
    word = (low >> np.uint64(48)).astype(np.int64).reshape(BLOCKS, SYMBOLS)
    sums = word.sum(axis=1)
    out = []
    for k in range(SYMBOLS):
        moved = word.copy()
        moved[:, k] = (word[:, k] - sums) % 65_536
        packed = (moved.astype(np.uint64) << (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64)
        out.append((packed ^ _BLOCK) * _MIX)
    return np.unique(np.concatenate(out)).view(np.int64)


def _fingerprints(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, int] = {}
        for batch in sliced(batches):
            rows, a, b, kept = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = runs(words(repaired(text, model)), known)
                if len(found):
                    raw = found.tobytes()
                    rows.append(i)
                    a.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    b.append(xxhash.xxh3_64_intdigest(raw, 7) - (1 << 63))
                    kept.append(np.unique((found >> np.uint64(32)).astype(np.uint32)).tobytes())
            made = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *made], ["article_id", "a", "b", "runs"])

    return run


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sent = [anchors(np.frombuffer(r, np.uint32).astype(np.uint64)) for r in batch.column(1).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(sent)), [len(x) for x in sent]))
        found = pa.array(np.concatenate(sent) if sent else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), found], ["a", "anchor"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(p), len(q)) < least * max(len(p), len(q)):
                    found.append(0.0)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                found.append(both / (len(p) + len(q) - both))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.float64())], ["a", "b", "a2", "b2", "similarity"])
            yield out.filter(pa.array([s >= least for s in found], pa.bool_()))

    return run


def _single_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(r, np.uint32) for r in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in found], np.int32)
        rows = pa.array(np.repeat(np.arange(len(found)), sizes))
        flat = np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(flat), pa.array(np.repeat(sizes, sizes), pa.int32())], ["a", "run", "size"])


def _crowded(one: DataFrame, crowd: DataFrame, similarity: float) -> DataFrame:
    """(a, a2): pairs among the classes that stand at a crowded anchor, exactly, without forming all pairs there.

    Two sets that are similar enough share at least one of the rarest size - ceil(similarity * size) + 1 runs of either, so classes are
    joined on those alone. What crowds an anchor, a text that many articles have in common, is not among a class's rarest runs.
    """
    single = one.join(crowd, "a", "left_semi").select("a", "runs").mapInArrow(_single_runs, "a bigint, run bigint, size int")
    df = single.groupBy("run").agg(F.count("*").alias("df"))
    order = Window.partitionBy("a").orderBy("df", "run")
    rare = single.join(df, "run").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size")) + 1)
    rare = rare.where("df > 1").select("a", "run", "size", "r")
    other = rare.select(F.col("a").alias("a2"), "run", F.col("size").alias("size2"), F.col("r").alias("r2"))
    near = (F.col("a") < F.col("a2")) & (F.least("size", "size2") >= similarity * F.greatest("size", "size2"))
    # The first run in this order that both have leaves no more than this for them to share: what many have in common stands at the end.
    left = F.least(F.col("size") - F.col("r"), F.col("size2") - F.col("r2")) + F.least("r", "r2")
    near = near & (left >= similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-9)
    return rare.join(other, "run").where(near).select("a", "a2")


def classes_and_links(articles: DataFrame, gold: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(article_id, a, b): the class of each article with a text, a class being the articles with the same runs; and (a, b, a2, b2, similarity): every link between two classes.

    Both are written to the shared folder. Null, empty and wordless texts have no class; repeated rows count once; a null article_id is
    a member like others; no articles give no rows; other columns are not read. Of a class only one text is compared. Classes meet
    pairwise at anchors of up to CROWD of them; those at larger ones are joined on their rarest runs, which loses no pair.
    """
    kept = articles.where(F.length(F.trim("verbatim_text")) > 0).select("article_id", "verbatim_text")
    kind = articles.schema["article_id"].dataType.simpleString()
    marks = written(kept.mapInArrow(_fingerprints(trained(gold)), f"article_id {kind}, a bigint, b bigint, runs binary"), "runs")
    members = marks.select("article_id", "a", "b").distinct()
    one = marks.groupBy("a", "b").agg(F.any_value("runs").alias("runs"))
    one = written(one, "classes")
    met = one.select("a", "runs").mapInArrow(_anchored, "a bigint, anchor bigint")
    shared = written(met.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1"), "shared")
    cool = shared.where(F.col("n") <= CROWD).select("a", "anchor")
    pairs = cool.join(cool.withColumnRenamed("a", "a2"), "anchor").where("a < a2").select("a", "a2")
    pairs = pairs.unionByName(_crowded(one, shared.where(F.col("n") > CROWD).select("a").distinct(), similarity)).distinct()
    both = pairs.join(one.select("a", "b", "runs"), "a").join(one.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("runs").alias("runs2")), "a2")
    links = both.select("a", "b", "a2", "b2", "runs", "runs2").mapInArrow(_similar(similarity), "a bigint, b bigint, a2 bigint, b2 bigint, similarity double")
    return members, written(links, "links")


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(article_id_a, article_id_b): every pair of different articles with the same story, the smaller id first."""
    left, right = members.withColumnRenamed("article_id", "x"), members.withColumnRenamed("article_id", "y")
    within = left.join(right, ["a", "b"]).where("x < y").select("x", "y")
    across = links.join(left, ["a", "b"]).join(right.withColumnsRenamed({"a": "a2", "b": "b2"}), ["a2", "b2"]).where("x <> y").select("x", "y")
    both = within.unionByName(across)
    return both.select(F.least("x", "y").alias("article_id_a"), F.greatest("x", "y").alias("article_id_b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(article_id, class_id, group_id, group_name, class_size, links): one row for each member: the class of its text and that class's size and links, and its story.

    Stories are the components of the links over classes, never over article ids, so articles without an id, or with the same one, stay
    apart: each class takes the smallest class among its own label and its neighbours', then the label which that one has, until none
    changes; every round is written to the shared folder, and only the number of changes reaches the driver. group_id is the smallest class
    of the story, group_name its smallest article id (null if none has one). Without members there are no rows.
    """
    sizes = written(members.groupBy("a", "b").agg(F.min("article_id").alias("name"), F.count("*").alias("class_size")), "sizes")
    back = links.select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    edges = written(links.select("a", "b", "a2", "b2").unionByName(back), "edges")
    now = sizes.select("a", "b", F.struct("a", "b").alias("label"))
    while True:
        offered = edges.join(now.select(F.col("a").alias("a2"), F.col("b").alias("b2"), "label"), ["a2", "b2"]).groupBy("a", "b").agg(F.min("label").alias("offer"))
        least = now.join(offered, ["a", "b"], "left").select("a", "b", F.col("label").alias("was"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        giver = least.select(F.col("a").alias("label_a"), F.col("b").alias("label_b"), F.col("label").alias("further"))
        jumped = least.join(giver, (F.col("label.a") == F.col("label_a")) & (F.col("label.b") == F.col("label_b"))).select("a", "b", "was", F.least("label", "further").alias("label"))
        after = written(jumped, "labels")
        changed = after.where("label <> was").limit(1).count()
        now = after.select("a", "b", "label")
        if not changed:
            break
    degree = edges.groupBy("a", "b").agg(F.count("*").alias("links"))
    known = now.join(sizes, ["a", "b"]).join(degree, ["a", "b"], "left")
    names = known.groupBy("label").agg(F.min("name").alias("group_name"))
    shown = known.join(names, "label").select(
        "a", "b", F.concat_ws(":", "a", "b").alias("class_id"), F.concat_ws(":", "label.a", "label.b").alias("group_id"), "group_name", "class_size", F.coalesce("links", F.lit(0)).alias("links")
    )
    return members.join(shown, ["a", "b"]).select("article_id", "class_id", "group_id", "group_name", "class_size", "links")

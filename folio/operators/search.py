"""Ranked retrieval: an inverted index as tables, BM25, boolean, vector and fused search, and evidence for answers.

Every ranking is ordered by score and then by id. The index is two tables, postings and one row of statistics; a search reads only the
postings of its terms, so written postings should be partitioned or sorted by term.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import SPACE, expand_terms, index_tokens

#: BM25's parameters, the least weight of a term, and the constant of reciprocal-rank fusion.
K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60


def tokenized(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, tokens): the tokens of all indexed columns, one after the other."""
    return docs.select(key, F.concat(*[index_tokens(F.col(c)) for c in columns]).alias("tokens"))


def postings(docs: DataFrame, key: str, *columns: str, terms: list[str] | None = None) -> DataFrame:
    """(term, key, tf, dl), of the given terms or all. Counted before the shuffle; a text without tokens has no postings."""
    tokens = tokenized(docs, key, *columns)
    # With terms, the others are left out while they are still in the array, before it becomes rows.
    kept = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(terms))
    one = tokens.select(key, F.size("tokens").alias("dl"), F.explode(kept).alias("term"))
    return one.groupBy("term", key, "dl").agg(F.count("*").alias("tf")).select("term", key, F.col("tf").cast("int").alias("tf"), "dl")


def corpus_stats(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: n_docs and avgdl, over all texts, those without tokens included."""
    return tokenized(docs, key, *columns).select(F.size("tokens").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(LEAST_IDF), F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5))))


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, score) of the documents with any of the terms; scores are negative, the best is the least."""
    found = index.where(F.col("term").isin(terms))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    # The list of terms is short, and the statistics are one row.
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    scored = found.join(F.broadcast(weights), "term").select(key, (F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("s"))
    return scored.groupBy(key).agg((-F.sum("s")).alias("score"))


def lexical(docs: DataFrame, query: str, k: int, key: str, *columns: str) -> DataFrame:
    """The k best (key, score, rank) for a question in ordinary words; none for a question without words. The same text delivered twice under one key counts once.

    Texts are read and divided once: what is shuffled of each is its length and its occurrences of the terms, which both the statistics and
    the postings come from.
    """
    terms = expand_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    tokens = docs.select(key, F.xxhash64(*columns).alias("__text"), F.concat(*[index_tokens(F.col(c)) for c in columns]).alias("tokens"))
    once = tokens.select(key, "__text", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(terms)).alias("hits")).distinct()
    stats = once.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    index = once.select(key, "dl", F.explode("hits").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    best = bm25(index, stats, terms, key).orderBy("score", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("score", key)))


def parse_boolean(query: str) -> list[list[tuple[bool, str]]] | None:
    """Alternatives of conjunctions of (negated, phrase) from words, "phrases", prefix*, AND, OR and NOT; a phrase ends in * for a prefix. None for other syntax."""
    parts = re.findall(r'"[^"]*"|\S+', query)
    out: list[list[tuple[bool, str]]] = [[]]
    negated = False
    for p in parts:
        if p == "OR":
            if negated or not out[-1]:
                return None
            out.append([])
        elif p == "AND":
            if negated or not out[-1]:
                return None
        elif p == "NOT":
            if negated or not out[-1]:
                return None
            negated = True
        else:
            quoted = len(p) > 1 and p[0] == p[-1] == '"'
            if not quoted and not re.fullmatch(r"\w+\*?", p):
                return None
            words = re.findall(r"[^\W_]+", p.lower())
            if not words:
                return None
            out[-1].append((negated, " ".join(words) + ("*" if p.endswith("*") else "")))
            negated = False
    return None if negated or not out[-1] else out


def boolean(docs: DataFrame, query: str, k: int, key: str, *columns: str) -> DataFrame:
    """The k best (key, score, strategy) for a query in search syntax, ranked by how often its phrases occur.

    A query in any other syntax is looked for as it stands, ASCII case ignored, in the indexed columns; its score is 0.
    """
    parsed = parse_boolean(query)
    if parsed is None:
        plain = F.lit(query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        cased = [F.translate(F.coalesce(F.col(c), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for c in columns]
        hit = cased[0].contains(plain)
        for c in cased[1:]:
            hit = hit | c.contains(plain)
        return docs.where(hit).select(key, F.lit(0.0).alias("score"), F.lit("like_fallback").alias("strategy")).orderBy(key).limit(k)
    text = tokenized(docs, key, *columns).select(key, F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" ")).alias("t"), F.size("tokens").alias("dl"))

    def pattern(phrase: str) -> str:
        open_ = phrase.endswith("*")
        return " " + "  ".join(phrase.rstrip("*").split()) + ("" if open_ else " ")

    wanted = list(dict.fromkeys(p for alternative in parsed for negated, p in alternative if not negated))
    counts = {p: (F.length("t") - F.length(F.replace("t", F.lit(pattern(p)), F.lit("")))) / F.lit(len(pattern(p))) for p in wanted}
    hit = F.lit(False)
    for alternative in parsed:
        one = F.lit(True)
        for negated, p in alternative:
            has = F.col("t").contains(pattern(p))
            one = one & (~has if negated else has)
        hit = hit | one
    counted = text.select(key, "dl", hit.alias("hit"), *[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    stats = counted.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    score = sum((idf(F.col("n_docs"), F.col(f"d{i}")) * _weight(F.col(f"c{i}"), F.col("dl"), F.col("avgdl")) for i in range(len(wanted))), F.lit(0.0))
    return counted.where("hit").crossJoin(F.broadcast(stats)).select(key, (-score).alias("score"), F.lit("boolean").alias("strategy")).orderBy("score", key).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for empty vectors, different lengths and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(ok & (norm > 0), dot(a, b) / norm).otherwise(F.lit(-1.0))


def usual_model(passages: DataFrame, model: str = "embedding_model", embedding: str = "embedding_json") -> DataFrame:
    """One row: the model that most embedded passages are of, the smaller name on ties."""
    return passages.where(F.col(model).isNotNull() & F.col(embedding).isNotNull()).groupBy(model).agg(F.count("*").alias("n")).orderBy(F.desc("n"), model).limit(1)


def semantic(docs: DataFrame, vector: list[float], k: int, key: str, embedding: str) -> DataFrame:
    """The k best (key, score, rank) by cosine with a vector: one pass, a top-k in each task, one merge."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    best = docs.where(F.col(embedding).isNotNull()).select(key, cosine(F.col(embedding).cast("array<double>"), query).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fused(lexical_: DataFrame, semantic_: DataFrame, k: int, key: str) -> DataFrame:
    """The k best (key, score, match_type, lexical_score, semantic_score) of two rankings by reciprocal-rank fusion; ties by lexical, then semantic rank."""
    one = lexical_.select(key, "rank", F.col("score").alias("lexical_score"), F.lit(None).cast("double").alias("semantic_score"), F.lit("lexical").alias("strategy"))
    two = semantic_.select(key, "rank", F.lit(None).cast("double").alias("lexical_score"), F.col("score").alias("semantic_score"), F.lit("semantic").alias("strategy"))
    joined = one.unionByName(two).groupBy(key).agg(
        F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("strategy")), "+").alias("match_type"),
        F.max("lexical_score").alias("lexical_score"), F.max("semantic_score").alias("semantic_score"),
        F.min(F.when(F.col("strategy") == "lexical", F.col("rank"))).alias("l"), F.min(F.when(F.col("strategy") == "semantic", F.col("rank"))).alias("s"),
    )
    return joined.orderBy(F.desc("score"), F.asc_nulls_last("l"), F.asc_nulls_last("s"), key).limit(k).drop("l", "s")


def hybrid(docs: DataFrame, query: str, vectors: DataFrame, vector: list[float], k: int, key: str, columns: list[str], embedding: str) -> DataFrame:
    """The k best by both: words of docs, and vectors, which may be of some docs only; each ranking gives three times as many, or twenty."""
    most = max(3 * k, 20)
    return fused(lexical(docs, query, most, key, *columns), semantic(vectors, vector, most, key, embedding), k, key)


def resources(ranked: DataFrame, passages: DataFrame, size: int, key: str = "passage_id", group: str = "article_id", text: str = "normalized_text", excerpt: int = 1_600) -> DataFrame:
    """(resource_id, group, key, relevant_excerpt, score): the best passage of each article, in order of rank, as R1 to at most R`size`."""
    shown = ranked.join(passages.select(key, group, F.left(F.col(text), F.lit(excerpt)).alias("relevant_excerpt")), key).distinct()
    best = shown.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where("n = 1").orderBy("rank").limit(size)
    return best.withColumn("r", F.row_number().over(Window.orderBy("rank"))).select(F.concat(F.lit("R"), "r").alias("resource_id"), group, key, "relevant_excerpt", "score")


def overfetch(size: int) -> int:
    return max(12, min(size * 3, 50))


def cited(answers: DataFrame, found: DataFrame, answer: str = "answer", by: str = "question_id") -> DataFrame:
    """The resources each answer cites; all of its question's where it cites none of them."""
    marks = answers.select(by, F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(r"\[(R\d+)\]"), F.lit(1))).alias("marks"))
    both = found.join(marks, by, "left").withColumn("hit", F.coalesce(F.array_contains("marks", F.col("resource_id")), F.lit(False)))
    any_ = F.max("hit").over(Window.partitionBy(by))
    return both.withColumn("any", any_).where(F.col("hit") | ~F.col("any")).drop("marks", "hit", "any")


#: The months as they are written in dates.
MONTHS = ("януари", "февруари", "март", "април", "май", "юни", "юли", "август", "септември", "октомври", "ноември", "декември")


def age_at_death(found: DataFrame, by: str = "question_id") -> DataFrame:
    """(by, age, birth_resource, death_resource) from excerpts: the earliest date of birth, and the death nearest after that year.

    The year of a death stands in the words before the verb, or is that of the issue. Questions whose resources lack either give no row.
    """
    months = "|".join(MONTHS)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.col("m"))).cast("int")
    text = F.coalesce("relevant_excerpt", F.lit(""))
    born = found.select(by, "resource_id", F.explode(F.regexp_extract_all(text, F.lit(rf"(?iu)роден{SPACE}+на{SPACE}+\d{{1,2}}{SPACE}+(?:{months}){SPACE}+\d{{4}}"), F.lit(0))).alias("x"))
    pattern = rf"(?iu)(\d{{1,2}}){SPACE}+({months}){SPACE}+(\d{{4}})$"
    born = born.select(by, "resource_id", F.regexp_extract("x", pattern, 3).cast("int").alias("y"), F.regexp_extract("x", pattern, 2).alias("m"), F.regexp_extract("x", pattern, 1).cast("int").alias("d"))
    birth = born.groupBy(by).agg(F.min(F.struct("y", number.alias("mo"), "d", "resource_id")).alias("b"))
    died = found.select(by, "resource_id", "issue_date", F.explode(F.regexp_extract_all(text, F.lit(rf"(?s)[Нн]а{SPACE}+\d{{1,2}}{SPACE}+(?:{months}).{{0,180}}?(?:почина|умира)"), F.lit(0))).alias("x"))
    year = F.coalesce(F.try_element_at(F.regexp_extract_all("x", F.lit(r"(?:^|\D)((?:18|19|20)\d{2})(?!\d)"), F.lit(1)), F.lit(1)).cast("int"), F.try_to_number(F.left("issue_date", F.lit(4)), F.lit("9999")).cast("int"))
    day = rf"(?s)^[Нн]а{SPACE}+(\d{{1,2}}){SPACE}+({months})"
    died = died.select(by, "resource_id", year.alias("y"), F.regexp_extract("x", day, 2).alias("m"), F.regexp_extract("x", day, 1).cast("int").alias("d")).where("y > 0")
    died = died.join(birth, by).withColumn("gap", F.when(F.col("y") >= F.col("b.y"), F.col("y") - F.col("b.y")).otherwise(9999))
    death = died.groupBy(by).agg(F.min(F.struct("gap", "y", number.alias("mo"), "d", "resource_id")).alias("e"), F.any_value("b").alias("b"))
    early = F.struct("e.mo", "e.d") < F.struct("b.mo", "b.d")
    return death.select(by, (F.col("e.y") - F.col("b.y") - early.cast("int")).alias("age"), F.col("b.resource_id").alias("birth_resource"), F.col("e.resource_id").alias("death_resource"))

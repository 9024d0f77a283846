"""Queries of the core operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import geometry, text
from folio.operators import compare, entities, layout, nested, passages, quality, reads, search, tables
from folio.plans import archive
from folio.session import read
from folio.streaming import progress

#: The questions that the search queries ask.
QUESTION, BOOLEAN, LITERAL = "къде е общинската болница и the municipal hospital", 'мелница NOT "градската мелница" OR hospit*', "100%?"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if SQL can express it over whole tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL fragments ---------------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


def _search_sql(x: str) -> str:
    """The search form of a text; words are joined twice, as a joined word may end in another hyphen."""
    t = f"replace(replace(nfc_normalize(coalesce({x}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_])-[ \t]*(?:\n[ \t]*)+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    for pattern, to in ((r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        t = f"regexp_replace({t}, '{pattern}', {to}, 'g')"
    return _trim(t)


_PASSAGES = "(SELECT DISTINCT p.passage_id, p.article_id, p.normalized_text, p.embedding_model, p.embedding_json, a.heading, a.page_id FROM (SELECT DISTINCT passage_id, article_id, normalized_text, embedding_model, embedding_json FROM passages) p JOIN articles a USING (article_id))"
_TOKENIZED = f"t AS (SELECT passage_id, {_tokens('heading')} || {_tokens('normalized_text')} AS tokens FROM {_PASSAGES})"
_STATS = "s AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM t)"
_POSTINGS = "x AS (SELECT passage_id, len(tokens) AS dl, unnest(tokens) AS term FROM t), post AS (SELECT term, passage_id, dl, count(*) AS tf FROM x GROUP BY ALL)"
#: The terms that QUESTION comes to, written out: its words without stop words, then those in Latin letters in Cyrillic ones.
EXPECTED = ("общинската", "болница", "municipal", "hospital", "муниcипал", "хоспитал")
_TERMS = ", ".join("'" + t + "'" for t in EXPECTED)


def _lexical_sql(k: int) -> str:
    return (
        f"WITH {_TOKENIZED}, {_STATS}, {_POSTINGS}, f AS (SELECT * FROM post WHERE term IN ({_TERMS})), df AS (SELECT term, count(*) AS n FROM f GROUP BY term), "
        "w AS (SELECT term, greatest(1e-6, ln((n_docs - n + 0.5) / (n + 0.5))) AS idf FROM df, s), "
        "sc AS (SELECT passage_id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM f JOIN w USING (term), s GROUP BY passage_id) "
        f"SELECT passage_id, score FROM sc ORDER BY score, passage_id LIMIT {k}"
    )


_VECTOR = [0.01 * ((i * 37) % 23 - 11) for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(f"{x:.17g}" for x in _VECTOR) + "]::DOUBLE[]"


def _semantic_sql(k: int) -> str:
    return (
        "WITH m AS (SELECT embedding_model FROM (SELECT DISTINCT passage_id, embedding_model, embedding_json FROM passages) WHERE embedding_model IS NOT NULL AND embedding_json IS NOT NULL "
        "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
        f"v AS (SELECT passage_id, TRY_CAST(embedding_json AS DOUBLE[]) AS e FROM {_PASSAGES} WHERE embedding_model = (SELECT embedding_model FROM m) AND embedding_json IS NOT NULL), "
        f"d AS (SELECT passage_id, e, list_sum(list_transform(range(1, 65), lambda i: e[i] * ({_VECTOR_SQL})[i])) AS dot, sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform({_VECTOR_SQL}, lambda x: x * x))) AS norm FROM v) "
        f"SELECT passage_id, CASE WHEN len(e) = 64 AND norm > 0 THEN dot / norm ELSE -1.0 END AS score FROM d WHERE e IS NOT NULL ORDER BY score DESC, passage_id LIMIT {k}"
    )


def _passages(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    return archive.archive_passages(read(spark, sf_dir, "passages"), read(spark, sf_dir, "articles"), once=once)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the usual model with their vectors; incomplete lists are null."""
    once = archive.archive_passages(read(spark, sf_dir, "passages"), read(spark, sf_dir, "articles"), vectors=True)
    model = search.usual_model(once).select("embedding_model")
    return once.join(F.broadcast(model), "embedding_model", "left_semi").withColumn("vector", F.from_json("embedding_json", "array<double>")).where(F.col("embedding_json").rlike(r"\]\s*$"))


# Retrieval -------------------------------------------------------------------------------------------------------------------


@query(_lexical_sql(10))
def bm25_topk(spark, sf_dir):
    return search.lexical(_passages(spark, sf_dir, once=False), QUESTION, 10, "passage_id", "heading", "normalized_text").select("passage_id", "score")


@query(f"WITH {_TOKENIZED}, {_STATS} SELECT n_docs, avgdl FROM s")
def bm25_corpus_stats(spark, sf_dir):
    return search.corpus_stats(_passages(spark, sf_dir), "passage_id", "heading", "normalized_text")


@query(f"WITH {_TOKENIZED}, {_POSTINGS} SELECT term, passage_id, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM post")
def postings_build(spark, sf_dir):
    return search.postings(_passages(spark, sf_dir), "passage_id", "heading", "normalized_text")


@query(f"WITH {_TOKENIZED}, {_POSTINGS} SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term")
def document_frequency(spark, sf_dir):
    index = search.postings(_passages(spark, sf_dir), "passage_id", "heading", "normalized_text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    rf"""WITH t AS (SELECT doc_id, ' ' || array_to_string({_tokens('heading')} || {_tokens('text')}, '  ') || ' ' AS t, len({_tokens('heading')} || {_tokens('text')}) AS dl FROM documents),
    c AS (SELECT doc_id, dl, t LIKE '% мелница %' AND t NOT LIKE '% градската  мелница %' OR t LIKE '% hospit%' AS hit,
      (length(t) - length(replace(t, ' мелница ', ''))) / 9.0 AS c0, (length(t) - length(replace(t, ' hospit', ''))) / 7.0 AS c1 FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (c0 > 0) AS d0, count(*) FILTER (c1 > 0) AS d1 FROM c)
    SELECT doc_id, -(greatest(1e-6, ln((n - d0 + 0.5) / (d0 + 0.5))) * c0 * 2.2 / (c0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(1e-6, ln((n - d1 + 0.5) / (d1 + 0.5))) * c1 * 2.2 / (c1 + 1.2 * (0.25 + 0.75 * dl / a))) AS score
    FROM c, s WHERE hit ORDER BY score, doc_id LIMIT 20"""
)
def boolean_search(spark, sf_dir):
    return search.boolean(read(spark, sf_dir, "documents"), BOOLEAN, 20, "doc_id", "heading", "text").select("doc_id", "score")


@query("SELECT doc_id, 'like_fallback' AS strategy FROM documents WHERE translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%: 2%' ORDER BY doc_id LIMIT 25")
def like_fallback(spark, sf_dir):
    return search.boolean(read(spark, sf_dir, "documents"), ": 2", 25, "doc_id", "text").select("doc_id", "strategy")


@query("SELECT unnest([" + _TERMS + "]) AS term, unnest(range(" + str(len(EXPECTED)) + ")) AS pos")
def query_expand(spark, sf_dir):
    return spark.createDataFrame([(t, i) for i, t in enumerate(text.expand_terms(QUESTION))], "term string, pos bigint")


@query(
    f"WITH d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_VECTOR_SQL})[i])) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({_VECTOR_SQL}, lambda x: x * x))) AS norm FROM embeddings) "
    "SELECT vec_id, CASE WHEN norm > 0 THEN dot / norm ELSE -1.0 END AS score FROM d ORDER BY score DESC, vec_id LIMIT 20"
)
def cosine_topk(spark, sf_dir):
    return search.semantic(read(spark, sf_dir, "embeddings"), _VECTOR, 20, "vec_id", "embedding").select("vec_id", "score")


@query("SELECT embedding_model, count(*) AS n FROM (SELECT DISTINCT passage_id, embedding_model, embedding_json FROM passages) WHERE embedding_model IS NOT NULL AND embedding_json IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def embedding_model_mode(spark, sf_dir):
    return search.usual_model(read(spark, sf_dir, "passages").select("passage_id", "embedding_model", "embedding_json").distinct())


@query(_semantic_sql(10))
def semantic_topk(spark, sf_dir):
    return search.semantic(_vectors(spark, sf_dir), _VECTOR, 10, "passage_id", "vector").select("passage_id", "score")


def _hybrid_sql(k: int) -> str:
    most = max(3 * k, 20)
    return (
        f"WITH l AS (SELECT *, row_number() OVER (ORDER BY score, passage_id) AS r FROM ({_lexical_sql(most)})), m AS (SELECT *, row_number() OVER (ORDER BY score DESC, passage_id) AS r FROM ({_semantic_sql(most)})), "
        "u AS (SELECT passage_id, r, 'lexical' AS strategy, score AS ls, NULL AS ss FROM l UNION ALL SELECT passage_id, r, 'semantic', NULL, score FROM m), "
        "g AS (SELECT passage_id, sum(1.0 / (60 + r)) AS score, string_agg(strategy, '+' ORDER BY strategy) AS match_type, max(ls) AS lexical_score, max(ss) AS semantic_score, min(r) FILTER (strategy = 'lexical') AS l, min(r) FILTER (strategy = 'semantic') AS s FROM u GROUP BY passage_id) "
        f"SELECT passage_id, score, match_type, lexical_score, semantic_score FROM g ORDER BY score DESC, l NULLS LAST, s NULLS LAST, passage_id LIMIT {k}"
    )


@query(_hybrid_sql(10))
def rrf_hybrid(spark, sf_dir):
    return search.hybrid(_passages(spark, sf_dir, once=False), QUESTION, _vectors(spark, sf_dir), _VECTOR, 10, "passage_id", ["heading", "normalized_text"], "vector")


@query(
    f"WITH b AS (SELECT *, row_number() OVER (ORDER BY score, passage_id) AS rank FROM ({_lexical_sql(15)})), p AS (SELECT rank, b.passage_id, article_id, left(normalized_text, 1600) AS relevant_excerpt, score, row_number() OVER (PARTITION BY article_id ORDER BY rank) AS n FROM b JOIN {_PASSAGES} q USING (passage_id)) "
    "SELECT 'R' || row_number() OVER (ORDER BY rank) AS resource_id, article_id, passage_id, relevant_excerpt, score FROM p WHERE n = 1 ORDER BY rank LIMIT 5"
)
def evidence_resources(spark, sf_dir):
    all_ = _passages(spark, sf_dir, once=False)
    return search.resources(search.lexical(all_, QUESTION, search.overfetch(5), "passage_id", "heading", "normalized_text"), all_, 5)


@query(
    "SELECT heading, CASE "
    + " ".join(rf"WHEN regexp_matches(lower(heading), '(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])') THEN {n}" for n, p in text.BUDGETS)
    + " ELSE 3 END AS budget FROM documents WHERE heading IS NOT NULL"
)
def budget_classify(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("heading is not null").select("heading", text.budget(F.col("heading")).alias("budget"))


_ANSWERS = "(VALUES (1, 'one [R2] and [R3] [R2]'), (2, 'none'), (3, 'wrong [R9]'), (4, NULL)) AS a(question_id, answer)"
_FOUND = "(SELECT q AS question_id, 'R' || r AS resource_id FROM range(1, 5) t(q), range(1, 4) u(r))"


@query(
    f"WITH x AS (SELECT f.question_id, f.resource_id, list_contains(regexp_extract_all(coalesce(answer, ''), '\\[(R\\d+)\\]', 1), resource_id) AS hit FROM {_FOUND} f JOIN {_ANSWERS} USING (question_id)), "
    "y AS (SELECT *, max(hit) OVER (PARTITION BY question_id) AS a FROM x) SELECT question_id, resource_id FROM y WHERE hit OR NOT a"
)
def cited_filter(spark, sf_dir):
    answers = spark.createDataFrame([(1, "one [R2] and [R3] [R2]"), (2, "none"), (3, "wrong [R9]"), (4, None)], "question_id int, answer string")
    found = spark.createDataFrame([(q, f"R{r}") for q in range(1, 5) for r in range(1, 4)], "question_id int, resource_id string")
    return search.cited(answers, found).select("question_id", "resource_id")


@query("SELECT * FROM (VALUES (1, 67, 'R1', 'R2'), (2, 66, 'R1', 'R2')) AS v(question_id, age, birth_resource, death_resource)")
def age_answer(spark, sf_dir):
    rows = [
        (1, "R1", "Той е роден на 18 юни 1882 в града.", "1949-07-03"), (1, "R2", "На 2 юли 1949 той почина.", "1949-07-03"), (2, "R1", "роден на 3 август 1882", "1949-07-03"),
        (2, "R2", "На 2 юли следобед почина", "1949-07-03"), (3, "R1", "няма дати", None),
    ]
    return search.age_at_death(spark.createDataFrame(rows, "question_id int, resource_id string, relevant_excerpt string, issue_date string"))


# Text ------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT article_id, {_search_sql('verbatim_text')} AS normalized FROM articles")
def normalize_index(spark, sf_dir):
    return read(spark, sf_dir, "articles").select("article_id", text.normalize_index(F.col("verbatim_text")).alias("normalized"))


_STORE = _trim(f"regexp_replace(regexp_replace(nfc_normalize(verbatim_text), '-{_SPACE}*\\n{_SPACE}*', '', 'g'), '{_SPACE}+', ' ', 'g')")


@query(f"SELECT article_id, {_STORE} AS normalized FROM articles")
def normalize_store(spark, sf_dir):
    return read(spark, sf_dir, "articles").select("article_id", text.normalize_store(F.col("verbatim_text")).alias("normalized"))


_LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_SCORING = _trim(
    f"regexp_replace(replace(lower(array_to_string(list_transform(regexp_split_to_array(nfc_normalize(prediction_text), '{_LINE_END}'), lambda x: CASE WHEN x LIKE '%-' THEN left(x, length(x) - 1) ELSE x || ' ' END), '')), 'ß', 'ss'), '{_SPACE}+', ' ', 'g')"
)


@query(f"SELECT gold_id, {_SCORING} AS normalized FROM gold_reads")
def normalize_scoring(spark, sf_dir):
    return read(spark, sf_dir, "gold_reads").select("gold_id", text.normalize_scoring(F.col("prediction_text"), "search").alias("normalized"))


_COMPARED = "regexp_replace(array_to_string(list_transform(string_split(replace(replace(nfc_normalize(verbatim_text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: " + _trim("regexp_replace(x, '[ \\t]+', ' ', 'g')") + "), chr(10)), '^\\n+|\\n+$', '', 'g')"


@query(f"SELECT DISTINCT read_id, {_COMPARED} AS normalized FROM article_input")
def normalize_comparison(spark, sf_dir):
    return read(spark, sf_dir, "article_input").select("read_id", text.normalize_comparison(F.col("verbatim_text")).alias("normalized")).distinct()


@query("SELECT passage_id, CASE WHEN length(normalized_text) > 0 THEN CAST(ceil(length(normalized_text) / 3.2) AS INTEGER) ELSE 0 END AS estimate, estimated_tokens FROM passages")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "passages").select("passage_id", text.token_estimate(F.col("normalized_text")).alias("estimate"), "estimated_tokens")


@query(r"SELECT article_id, regexp_replace(regexp_replace(replace(lower(heading), 'ß', 'ss'), '[^a-z0-9а-яѣ]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM articles WHERE heading IS NOT NULL")
def heading_slugs(spark, sf_dir):
    return read(spark, sf_dir, "articles").where("heading is not null").select("article_id", text.slug(F.col("heading")).alias("slug"))


_CYR = "translate(" + "replace(" * 7 + "lower(heading)" + "".join(f", '{a}', '{b}')" for a, b in text.LATIN_GROUPS) + f", '{text.LATIN_LETTERS}', '{text.CYRILLIC_LETTERS}')"


@query(f"SELECT doc_id, {_CYR} AS cyrillic FROM documents WHERE heading IS NOT NULL")
def transliterated_headings(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("heading is not null").select("doc_id", text.transliterated(F.col("heading")).alias("cyrillic"))


@query(rf"WITH t AS (SELECT article_id, list_distinct(regexp_extract_all(replace(lower(verbatim_text), 'ß', 'ss'), '\p{{L}}{{3,}}')) AS a, list_distinct(regexp_extract_all(replace(lower(normalized_text), 'ß', 'ss'), '\p{{L}}{{3,}}')) AS b FROM articles WHERE verbatim_text IS NOT NULL AND normalized_text IS NOT NULL) "
       "SELECT article_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS coverage, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing FROM t")
def token_coverage(spark, sf_dir):
    both = read(spark, sf_dir, "articles").where("verbatim_text is not null and normalized_text is not null").select("article_id", text.coverage_tokens(F.col("verbatim_text")).alias("a"), text.coverage_tokens(F.col("normalized_text")).alias("b"))
    return both.select("article_id", (F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"))).alias("coverage"), F.size(F.array_except("a", "b")).cast("bigint").alias("missing"))


_MARK = text.TRUNCATION_MARK.replace("'", "''")


@query(f"WITH t AS (SELECT 'articles' AS t, article_id AS k, verbatim_text AS v FROM articles UNION SELECT 'article_input', read_id, verbatim_text FROM article_input) "
       f"SELECT t AS table_name, k AS record_key, regexp_matches(v, '{_MARK}') AS marked, contains(v, chr(65533)) AS replaced, coalesce(regexp_matches({_trim('v')}, '[\\p{{L}}\\p{{N}}_]-$|[,;:—–(\\[«]$'), false) AS abrupt FROM t WHERE v IS NOT NULL")
def text_integrity(spark, sf_dir):
    both = read(spark, sf_dir, "articles").select(F.lit("articles").alias("table_name"), F.col("article_id").alias("record_key"), F.col("verbatim_text").alias("v"))
    both = both.unionByName(read(spark, sf_dir, "article_input").select(F.lit("article_input").alias("table_name"), F.col("read_id").alias("record_key"), F.col("verbatim_text").alias("v"))).where("v is not null").distinct()
    errors = text.integrity_errors(F.col("v"))
    return both.select("table_name", "record_key", F.array_contains(errors, "truncation_marker").alias("marked"), F.array_contains(errors, "replacement_character").alias("replaced"), text.abrupt_ending(F.col("v")).alias("abrupt"))


_ANCHOR = f"replace(lower({_trim(f'''regexp_replace(nfc_normalize(source_anchor), '{_SPACE}+', ' ', 'g')''')}), 'ß', 'ss')"


@query(f"WITH k AS (SELECT DISTINCT article_id, {_ANCHOR} AS anchor FROM article_input WHERE source_anchor IS NOT NULL) SELECT anchor, count(*) AS articles, min(article_id) AS first_article FROM k WHERE anchor <> '' GROUP BY anchor HAVING count(*) > 1")
def duplicate_anchor(spark, sf_dir):
    keys = read(spark, sf_dir, "article_input").where("source_anchor is not null").select("article_id", text.anchor_key(F.col("source_anchor")).alias("anchor")).distinct()
    return keys.where("anchor <> ''").groupBy("anchor").agg(F.count("*").alias("articles"), F.min("article_id").alias("first_article")).where("articles > 1")


@query(r"SELECT article_id, starts_with(l, h) AND h <> '' AND NOT (length(l) > length(h) AND NOT regexp_matches(substr(l, length(h) + 1), '^[\r\n]')) AS repeats FROM "
       f"(SELECT article_id, regexp_replace(verbatim_text, '^{_SPACE}+', '') AS l, coalesce({_trim('heading')}, '') AS h FROM articles WHERE verbatim_text IS NOT NULL)")
def heading_in_body(spark, sf_dir):
    df = read(spark, sf_dir, "articles").where("verbatim_text is not null")
    split = text.body_without_heading(F.col("verbatim_text"), F.col("heading"))
    return df.select("article_id", (split["body"] != F.col("verbatim_text")).alias("repeats"))


@query()
def passages_chunk(spark, sf_dir):
    return passages.passages(read(spark, sf_dir, "articles"))


_META = r"regexp_extract_all(regexp_replace(regexp_extract(source_path, '[^/\\]*$'), '[.][^.]*$', ''), '[0-9A-Za-zА-Яа-я]+')"


@query(
    f"WITH h AS (SELECT publication_code, publication FROM publication_hints), t AS (SELECT page_id, {_META} AS tok, codes FROM pages, (SELECT list(publication_code) AS codes FROM h)), "
    "c AS (SELECT page_id, tok, list_filter(list_transform(tok, lambda x: lower(x)), lambda x: list_contains(codes, x))[1] AS code, "
    "list_filter(list_transform(range(1, len(tok) - 1), lambda i: CASE WHEN regexp_full_match(tok[i], '\\d{1,2}') AND regexp_full_match(tok[i + 1], '\\d{1,2}') AND regexp_full_match(tok[i + 2], '\\d{4}') "
    "THEN try_cast(tok[i + 2] || '-' || lpad(tok[i], 2, '0') || '-' || lpad(tok[i + 1], 2, '0') AS DATE) END), lambda d: d IS NOT NULL)[1] AS issue_date, "
    "try_cast(regexp_extract(list_filter(list_transform(tok, lambda x: lower(x)), lambda x: regexp_full_match(x, 'page\\d+'))[1], '\\d+') AS INTEGER) AS page_number FROM t) "
    "SELECT page_id, h.publication, code AS publication_code, CAST(issue_date AS VARCHAR) AS issue_date, page_number FROM c LEFT JOIN h ON h.publication_code = code"
)
def filename_metadata(spark, sf_dir):
    hints = read(spark, sf_dir, "publication_hints").agg(F.map_from_entries(F.collect_list(F.struct("publication_code", "publication"))).alias("hints"))
    known = read(spark, sf_dir, "pages").select("page_id", "source_path").crossJoin(F.broadcast(hints))
    m = known.select("page_id", archive.filename_metadata(F.col("source_path"), F.col("hints")).alias("m"))
    return m.select("page_id", "m.publication", "m.publication_code", F.col("m.issue_date").cast("string").alias("issue_date"), "m.page_number")


# Entities --------------------------------------------------------------------------------------------------------------------


@query()
def entity_mentions(spark, sf_dir):
    return entities.mentions(read(spark, sf_dir, "articles"))


@query(r"WITH m AS (SELECT article_id, unnest(regexp_extract_all(verbatim_text, '(?:18|19|20)\d{2}\s*г\.|[0-3]?\d[.\-/][01]?\d[.\-/](?:18|19|20)\d{2}')) AS name FROM articles) SELECT name, count(*) AS mentions FROM m GROUP BY name")
def date_mentions(spark, sf_dir):
    found = read(spark, sf_dir, "articles").select(F.explode(F.regexp_extract_all("verbatim_text", F.lit(r"(?:18|19|20)\d{2}\s*г\.|[0-3]?\d[.\-/][01]?\d[.\-/](?:18|19|20)\d{2}"), F.lit(0))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("mentions"))


@query()
def entity_nodes(spark, sf_dir):
    return entities.entities(entities.mentions(read(spark, sf_dir, "articles")))


@query()
def entity_pairs(spark, sf_dir):
    return entities.together(entities.mentions(read(spark, sf_dir, "articles")))


@query()
def entity_neighbourhood(spark, sf_dir):
    found = entities.mentions(read(spark, sf_dir, "articles"))
    first = found.agg(F.min("entity_id").alias("entity_id"))
    return found.join(F.broadcast(first), "entity_id").select("entity_id", F.lit("mentioned_in").alias("predicate"), F.col("article_id").alias("object_id"), "name", "start_offset", "end_offset")


# Comparison ------------------------------------------------------------------------------------------------------------------


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a, b): both readers' texts of each article that both have read, the first read of each by id."""
    once = tables.first_by(read(spark, sf_dir, "article_input").where("verbatim_text is not null"), ["article_id", "reader"], F.asc("read_id"), F.asc("received_at"))
    a, b = (once.where(F.col("reader") == r).select(F.col("article_id").alias("id"), F.col("verbatim_text").alias(c)) for r, c in (("A", "a"), ("B", "b")))
    return a.join(b, "id")


@query()
def text_comparison(spark, sf_dir):
    return compare.text_comparison(_reads(spark, sf_dir))


@query()
def edit_script(spark, sf_dir):
    return compare.edit_script(_reads(spark, sf_dir))


@query()
def edits_applied(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    script = compare.edit_script(reads)
    return compare.applied(reads, script, script.where("edit_no % 2 = 0"))


@query()
def truncation_signals(spark, sf_dir):
    return compare.truncation_signals(_reads(spark, sf_dir))


@query()
def boundary_overlap(spark, sf_dir):
    return compare.boundary_overlap(read(spark, sf_dir, "articles"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gold_reads").select(F.col("gold_id").alias("id"), F.col("reference_text").alias("a"), F.col("prediction_text").alias("b"))


@query()
def error_rates(spark, sf_dir):
    return compare.error_rates(_gold(spark, sf_dir))


@query()
def agreement_ratio(spark, sf_dir):
    return compare.agreement(_gold(spark, sf_dir))


_LOW = "lower(a.verbatim_text)"


@query(
    f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY article_id, reader ORDER BY read_id, received_at) AS n FROM article_input WHERE verbatim_text IS NOT NULL), a AS (SELECT * FROM o WHERE n = 1 AND reader = 'A'), b AS (SELECT * FROM o WHERE n = 1 AND reader = 'B'), "
    f"j AS (SELECT a.article_id AS id, {_trim('a.verbatim_text')} = {_trim('b.verbatim_text')} AS same, a.confidence AS ca, b.confidence AS cb, coalesce(len(a.uncertainties), 0) + coalesce(len(b.uncertainties), 0) AS u, contains({_LOW}, '[неясно') OR contains({_LOW}, '[нечетливо') AS marked FROM a JOIN b USING (article_id)) "
    "SELECT id, CASE WHEN same AND ca IS NOT NULL AND cb IS NOT NULL AND least(ca, cb) >= 0.9 AND u = 0 AND NOT marked THEN 'agreement' ELSE 'adjudicate' END AS route, "
    "list_filter([CASE WHEN NOT same THEN 'reader_disagreement' END, CASE WHEN least(ca, cb) < 0.85 THEN 'low_confidence' END, CASE WHEN u > 0 THEN 'reported_uncertainty' END], lambda x: x IS NOT NULL) AS reasons FROM j"
)
def read_routing(spark, sf_dir):
    once = tables.first_by(read(spark, sf_dir, "article_input").where("verbatim_text is not null"), ["article_id", "reader"], F.asc("read_id"), F.asc("received_at"))
    n = F.coalesce(F.size("uncertainties"), F.lit(0))
    a = once.where("reader = 'A'").select(F.col("article_id").alias("id"), F.col("verbatim_text").alias("a"), F.col("confidence").alias("a_confidence"), n.alias("n"))
    b = once.where("reader = 'B'").select(F.col("article_id").alias("id"), F.col("verbatim_text").alias("b"), F.col("confidence").alias("b_confidence"), n.alias("m"))
    return reads.routed(a.join(b, "id").withColumn("uncertain", F.greatest(F.col("n"), F.lit(0)) + F.greatest(F.col("m"), F.lit(0))))


@query("SELECT page_id, count(*) AS articles, coalesce(min(confidence), 0) AS confidence, coalesce(list(article_id ORDER BY article_id) FILTER (coalesce(uncertainties_json, '[]') <> '[]'), []) AS uncertain, count(*) FILTER (coalesce(length(verbatim_text), 0) = 0) AS without_text FROM articles GROUP BY page_id")
def page_summary(spark, sf_dir):
    return reads.summary(read(spark, sf_dir, "articles"), "page_id")


@query("SELECT page_id, source_sha256 FROM pages WHERE page_id <> 'page:' || source_sha256 UNION ALL SELECT a.page_id, NULL FROM (SELECT DISTINCT page_id FROM articles) a WHERE a.page_id NOT IN (SELECT page_id FROM pages)")
def source_hash_guard(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "source_sha256")
    lost = read(spark, sf_dir, "articles").select("page_id").distinct().join(pages, "page_id", "left_anti").select("page_id", F.lit(None).cast("string").alias("source_sha256"))
    return pages.where(F.col("page_id") != F.concat(F.lit("page:"), "source_sha256")).unionByName(lost)


@query("SELECT DISTINCT event_id, scan_id, stage FROM stage_events WHERE regexp_matches(stage, '^(read|crop|save|pub)')")
def stage_prefixes(spark, sf_dir):
    return read(spark, sf_dir, "stage_events").where(F.col("stage").rlike("^(read|crop|save|pub)")).select("event_id", "scan_id", "stage").distinct()


@query("SELECT page_id, lower(regexp_extract(source_path, '[.]([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'webp', 'bmp') AS image FROM pages")
def suffix_allowed(spark, sf_dir):
    from folio.sources.files import IMAGES

    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1)).isin(*IMAGES).alias("image"))


@query("SELECT l_orderkey, bool_or(l_tax > 0.05) AS overflow, max(l_quantity) AS bottom_overflow_px, max(l_discount) AS right_overflow_px, max(l_quantity / greatest(1.0, l_extendedprice)) AS bottom_overflow_ratio, max(l_discount / greatest(1.0, l_quantity)) AS right_overflow_ratio, min(l_tax) AS minimum_fill_ratio, max(l_tax) AS maximum_fill_ratio, min(l_extendedprice) AS minimum_box_height_px FROM lineitem GROUP BY l_orderkey")
def responsive_metrics(spark, sf_dir):
    """Lines of an order stand for a block's measures at several widths."""
    m = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_tax") > 0.05).alias("overflow"), F.col("l_quantity").alias("bottom_overflow_px"), F.col("l_discount").alias("right_overflow_px"), F.col("l_extendedprice").alias("box_height_px"), F.col("l_quantity").alias("box_width_px"), F.col("l_tax").alias("fill_ratio"))
    return reads.rendered(m, "l_orderkey")


@query()
def article_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "articles").select("article_id", reads.fingerprint("article_id", "article_order", "heading", "verbatim_text", "uncertainties_json").alias("sha"))


# Layouts ---------------------------------------------------------------------------------------------------------------------

#: SQL tables r (regions), a (articles) and m (members) of all layouts, typed or as JSON text.
_TYPED = """doc AS (SELECT DISTINCT layout_id, page_id, CASE WHEN json_valid(payload_json) THEN CAST(payload_json AS JSON) END AS whole FROM manual_layouts WHERE regions IS NULL AND articles IS NULL),
page AS (SELECT layout_id, page_id, coalesce(whole -> '$.pages[0]', whole) AS page FROM doc WHERE whole IS NOT NULL),
listed AS (SELECT layout_id, page_id, CAST(page -> '$.regions' AS JSON[]) AS regions FROM page),
item AS (SELECT layout_id, page_id, unnest(regions) AS outer_region, unnest(range(len(regions))) AS pos FROM listed),
region_doc AS (SELECT layout_id, page_id, pos, coalesce(outer_region -> '$.region', outer_region) AS g, coalesce(nullif(coalesce(outer_region -> '$.region', outer_region) -> '$.polygon', 'null'), coalesce(outer_region -> '$.region', outer_region) -> '$.points') AS pts FROM item),
d AS (SELECT DISTINCT layout_id, page_id, regions, articles FROM manual_layouts),
r0 AS (SELECT layout_id, page_id, unnest(regions) AS r, unnest(range(len(regions))) AS pos FROM d WHERE regions IS NOT NULL),
r AS (SELECT layout_id, page_id, pos, r.id AS id, r.type AS type, r.article_id AS article_id, r.parent_id AS parent_id, r.reading_order AS reading_order, r.polygon AS polygon, r.text AS text, r.confidence AS confidence, r.needs_enhancement AS needs_enhancement, r.read_a AS read_a
  FROM r0 WHERE r IS NOT NULL
  UNION ALL SELECT layout_id, page_id, pos, g ->> '$.id', g ->> '$.type', g ->> '$.article_id', g ->> '$.parent_id',
    CASE WHEN regexp_full_match(trim(g ->> '$.reading_order'), '[+-]?[0-9]{1,9}([.]0*)?') THEN CAST(CAST(trim(g ->> '$.reading_order') AS DOUBLE) AS INTEGER) END,
    CASE WHEN json_type(pts) = 'ARRAY' THEN list_transform(CAST(pts AS JSON[]), lambda p: CASE json_type(p) WHEN 'OBJECT' THEN [TRY_CAST(p ->> '$.x' AS DOUBLE), TRY_CAST(p ->> '$.y' AS DOUBLE)] WHEN 'ARRAY' THEN TRY_CAST(p AS DOUBLE[]) END) END,
    g ->> '$.text', CASE WHEN json_type(g, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(g ->> '$.confidence' AS DOUBLE) END, CASE WHEN json_type(g, '$.needs_enhancement') = 'BOOLEAN' THEN CAST(g ->> '$.needs_enhancement' AS BOOLEAN) END,
    CASE WHEN json_type(g, '$.read_a') = 'OBJECT' THEN struct_pack(verbatim_text := g ->> '$.read_a.verbatim_text', confidence := TRY_CAST(g ->> '$.read_a.confidence' AS DOUBLE), uncertain_spans := list_transform(CAST(g -> '$.read_a.uncertain_spans' AS JSON[]),
      lambda s: CASE WHEN json_type(s) = 'OBJECT' THEN struct_pack(text := s ->> '$.text', start_offset := TRY_CAST(s ->> '$.start_offset' AS INTEGER), end_offset := TRY_CAST(s ->> '$.end_offset' AS INTEGER), alternatives := CAST(s -> '$.alternatives' AS VARCHAR[])) END)) END
  FROM region_doc WHERE json_type(g) = 'OBJECT'),
a0 AS (SELECT layout_id, unnest(articles) AS a FROM d WHERE articles IS NOT NULL),
a1 AS (SELECT layout_id, unnest(CAST(page -> '$.articles' AS JSON[])) AS a FROM page),
a AS (SELECT layout_id, a.id AS id, a.region_ids AS region_ids, a.reading_order AS reading_order FROM a0 WHERE a IS NOT NULL
  UNION ALL SELECT layout_id, a ->> '$.id', CASE WHEN json_type(a, '$.region_ids') = 'ARRAY' THEN CAST(a -> '$.region_ids' AS VARCHAR[]) ELSE [] END,
    CASE WHEN regexp_full_match(trim(a ->> '$.reading_order'), '[+-]?[0-9]{1,9}([.]0*)?') THEN CAST(CAST(trim(a ->> '$.reading_order') AS DOUBLE) AS INTEGER) END FROM a1 WHERE json_type(a) = 'OBJECT'),
m AS (SELECT DISTINCT layout_id, id AS article, unnest(region_ids) AS id FROM a)"""


@query(
    f"WITH {_TYPED} "
    "SELECT layout_id, 'duplicate_region_id' AS rule, id AS key FROM r GROUP BY layout_id, id HAVING count(*) > 1 "
    "UNION SELECT layout_id, 'not_four_corners', id FROM r WHERE coalesce(len(polygon), -1) <> 4 "
    "UNION SELECT layout_id, 'invalid_polygon', id FROM r WHERE len(list_filter(polygon, lambda p: p IS NULL OR len(p) <> 2 OR p[1] IS NULL OR p[2] IS NULL OR p[1] < 0 OR p[1] > 1000 OR p[2] < 0 OR p[2] > 1000)) > 0 "
    "UNION SELECT layout_id, 'own_parent', id FROM r WHERE parent_id = id "
    "UNION SELECT layout_id, 'unknown_parent', parent_id FROM r WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r q WHERE q.layout_id = r.layout_id AND q.id = r.parent_id) "
    "UNION SELECT layout_id, 'duplicate_article_id', id FROM a GROUP BY layout_id, id HAVING count(*) > 1 "
    "UNION SELECT layout_id, 'article_without_regions', id FROM a WHERE coalesce(len(region_ids), 0) < 1 "
    "UNION SELECT layout_id, 'unknown_region', id FROM m WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.layout_id = m.layout_id AND q.id = m.id) "
    "UNION SELECT layout_id, 'region_of_several_articles', id FROM m GROUP BY layout_id, id HAVING count(*) > 1 "
    "UNION SELECT layout_id, 'duplicate_article_order', CAST(reading_order AS VARCHAR) FROM a WHERE reading_order IS NOT NULL GROUP BY layout_id, reading_order HAVING count(*) > 1 "
    "UNION SELECT layout_id, 'unknown_article', article_id FROM r WHERE article_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a q WHERE q.layout_id = r.layout_id AND q.id = r.article_id) "
    "UNION SELECT m.layout_id, 'membership_disagrees', m.id FROM m JOIN r USING (layout_id, id) WHERE r.article_id <> m.article "
    "UNION SELECT m.layout_id, 'duplicate_local_order', m.article || ':' || r.reading_order FROM m JOIN r USING (layout_id, id) WHERE r.reading_order IS NOT NULL GROUP BY m.layout_id, m.article, r.reading_order HAVING count(*) > 1"
)
def layout_violations(spark, sf_dir):
    return layout.violations(_layouts(spark, sf_dir))


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layouts, those delivered as JSON text in the type of the others."""
    return nested.whole_layouts(read(spark, sf_dir, "manual_layouts"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _layouts(spark, sf_dir).select("layout_id", "page_id", "regions")
    return once.select("layout_id", "page_id", F.posexplode("regions").alias("pos", "r")).where("r is not null")


@query(
    f"WITH {_TYPED}, s0 AS (SELECT layout_id || ':' || pos AS id, read_a.verbatim_text AS t, unnest(read_a.uncertain_spans) AS s, unnest(range(len(read_a.uncertain_spans))) AS given FROM r), "
    "s AS (SELECT id, t, given, s.text AS text, s.start_offset AS b, s.end_offset AS e, row_number() OVER (PARTITION BY id ORDER BY s.start_offset, given) - 1 AS n, "
    "coalesce(max(s.end_offset) OVER (PARTITION BY id ORDER BY s.start_offset, given ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s0 WHERE s IS NOT NULL) "
    "SELECT id, CAST(n AS INTEGER) AS span_no, CASE WHEN e < b OR e > length(t) THEN 'out_of_bounds' ELSE 'text_mismatch' END AS rule FROM s WHERE e < b OR e > length(t) OR substr(t, b + 1, e - b) <> text "
    "UNION ALL SELECT id, CAST(n AS INTEGER), 'overlap' FROM s WHERE b < before"
)
def span_violations(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return layout.span_violations(r.select(F.concat_ws(":", "layout_id", "pos").alias("id"), F.col("r.read_a.verbatim_text").alias("verbatim_text"), F.col("r.read_a.uncertain_spans").alias("uncertain_spans")))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with four good corners."""
    r = _regions(spark, sf_dir).select("layout_id", "page_id", "pos", F.col("r.type").alias("label"), F.col("r.polygon").alias("polygon"))
    return r.where((F.size("polygon") == 4) & geometry.in_range(F.col("polygon")))


_BOX = (
    f"WITH {_TYPED}, g AS (SELECT layout_id, page_id, pos, type AS label, list_min(list_transform(polygon, lambda p: p[1])) AS x1, list_min(list_transform(polygon, lambda p: p[2])) AS y1, list_max(list_transform(polygon, lambda p: p[1])) AS x2, list_max(list_transform(polygon, lambda p: p[2])) AS y2 "
    "FROM r WHERE len(polygon) = 4 AND len(list_filter(polygon, lambda p: p IS NULL OR len(p) <> 2 OR p[1] IS NULL OR p[2] IS NULL OR p[1] < 0 OR p[1] > 1000 OR p[2] < 0 OR p[2] > 1000)) = 0)"
)


@query(
    _BOX + ", q AS (SELECT a.layout_id, a.label, a.pos AS gold_id, b.pos AS predicted_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM g a JOIN g b ON a.layout_id = b.layout_id AND a.label = b.label AND a.pos <> b.pos) "
    "SELECT layout_id, label, CAST(gold_id AS INTEGER) AS gold_id, CAST(predicted_id AS INTEGER) AS predicted_id, CASE WHEN u - i <> 0 THEN i / (u - i) ELSE 0.0 END AS iou FROM q"
)
def iou_pairs(spark, sf_dir):
    r = _boxed(spark, sf_dir).withColumnRenamed("pos", "id")
    return layout.iou_pairs(r, r, ["layout_id", "label"]).where("gold_id <> predicted_id")


@query()
def assignment(spark, sf_dir):
    """Each page's regions against the same ones moved by a tenth of their height."""
    r = _boxed(spark, sf_dir).where("page_id is not null").select(F.concat_ws(":", "page_id", "layout_id").alias("page_id"), F.col("pos").cast("string").alias("id"), F.coalesce("label", F.lit("")).alias("label"), "polygon")
    gold = r.withColumn("kind", F.lit("gold"))
    moved = r.withColumn("polygon", geometry.lower_edge_scaled(F.col("polygon"), F.lit(1.1))).withColumn("kind", F.lit("pred"))
    return layout.assignment(gold.unionByName(moved))


@query(
    f"WITH {_TYPED}, o AS (SELECT layout_id, pos, reading_order FROM r WHERE reading_order IS NOT NULL), e AS (SELECT a.layout_id, avg(CAST(a.pos < b.pos AS INTEGER)) AS s FROM o a JOIN o b ON a.layout_id = b.layout_id AND b.reading_order = a.reading_order + 1 GROUP BY 1) "
    "SELECT DISTINCT o.layout_id, coalesce(s, 1.0) AS score FROM o LEFT JOIN e USING (layout_id)"
)
def precedence_score(spark, sf_dir):
    """How far the given order of regions follows their reading order."""
    r = _regions(spark, sf_dir).select("layout_id", F.col("pos").alias("item"), "pos", F.col("r.reading_order").alias("o")).where("o is not null")
    edges = r.select("layout_id", F.col("item").alias("before"), "o").join(r.select("layout_id", F.col("item").alias("after"), (F.col("o") - 1).alias("o")), ["layout_id", "o"])
    return layout.precedence(r.select("layout_id", "item", "pos"), edges.select("layout_id", "before", "after"), "layout_id")


@query(
    f"WITH {_TYPED}, i AS (SELECT page_id, coalesce(nullif(article_id, ''), page_id || ':ungrouped') AS article_id, coalesce(reading_order, 9999) AS o, coalesce(type, '') AS kind, coalesce(text, '') AS text, coalesce(id, '') AS id, layout_id * 1000 + pos AS pos, confidence FROM r WHERE page_id IS NOT NULL) "
    "SELECT page_id, article_id, (list(text ORDER BY o, kind, text, id, pos) FILTER (kind = 'headline' AND text <> ''))[1] AS title, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY o, kind, text, id, pos) FILTER (text <> ''), '') AS verbatim_text, min(confidence) AS confidence, "
    "list(id ORDER BY o, kind, text, id, pos) AS region_ids FROM i GROUP BY page_id, article_id"
)
def article_reconstruct(spark, sf_dir):
    r = _regions(spark, sf_dir).where("page_id is not null").select("page_id", F.col("r.article_id").alias("article_id"), F.col("r.id").alias("region_id"), F.col("r.type").alias("type"), F.col("r.reading_order").alias("reading_order"), F.col("r.text").alias("text"), F.col("r.confidence").alias("confidence"), (F.col("layout_id") * 1000 + F.col("pos")).alias("pos"))
    return layout.reconstructed(r).drop("normalized_text")


@query(_BOX + " SELECT layout_id, CAST(pos AS INTEGER) AS pos, x1 * 3.024 AS left_px, y1 * 4.032 AS top_px, least(1000.0, y1 + (y2 - y1) * 1.25) AS lower_edge, CASE WHEN label = 'headline' THEN 0.9 ELSE 0.93 END AS floor FROM g")
def polygon_scale(spark, sf_dir):
    r = _boxed(spark, sf_dir)
    px = geometry.box(geometry.to_pixels(F.col("polygon"), F.lit(3024), F.lit(4032)))
    scaled = geometry.box(geometry.lower_edge_scaled(F.col("polygon"), F.lit(1.25)))
    role = F.when(F.col("label") == "headline", "other").otherwise("body")
    return r.select("layout_id", "pos", px["x1"].alias("left_px"), px["y1"].alias("top_px"), scaled["y2"].alias("lower_edge"), geometry.fill_floor(role).alias("floor"))


_TURN = "sign((q[{1}][1] - q[{0}][1]) * (q[{2}][2] - q[{1}][2]) - (q[{1}][2] - q[{0}][2]) * (q[{2}][1] - q[{1}][1]))"
_AREA = " + ".join(f"(q[{i}][1] * q[{j}][2] - q[{j}][1] * q[{i}][2])" for i, j in ((1, 2), (2, 3), (3, 4), (4, 1)))


@query(
    f"WITH {_TYPED}, q AS (SELECT layout_id, pos, 'given' AS corners, polygon AS q FROM r UNION ALL SELECT layout_id, pos, 'crossed', [polygon[1], polygon[3], polygon[2], polygon[4]] FROM r) "
    f"SELECT layout_id, CAST(pos AS INTEGER) AS pos, corners, coalesce(len(q) = 4 AND len(list_distinct(q)) = 4 AND len(list_filter(q, lambda p: len(p) = 2 AND isfinite(p[1]) AND isfinite(p[2]))) = 4 "
    f"AND abs({' + '.join(_TURN.format(*t) for t in ((1, 2, 3), (2, 3, 4), (3, 4, 1), (4, 1, 2)))}) = 4 AND abs({_AREA}) / 2 >= 25, false) AS valid FROM q"
)
def quad_validity(spark, sf_dir):
    """Of the corners of every region, as they are given and with the second and third exchanged, which no convex shape survives."""
    p = F.col("r.polygon")
    rows = _regions(spark, sf_dir).select("layout_id", "pos", F.explode(F.map_from_arrays(F.array(F.lit("given"), F.lit("crossed")), F.array(p, F.array(*[F.get(p, F.lit(i)) for i in (0, 2, 1, 3)])))).alias("corners", "quad"))
    return rows.select("layout_id", "pos", "corners", F.coalesce(geometry.quad_valid(F.col("quad")), F.lit(False)).alias("valid"))


@query(
    f"WITH {_TYPED}, o AS (SELECT layout_id, id AS article_id, min(reading_order) AS ao FROM a GROUP BY 1, 2), j AS (SELECT r.*, o.ao, CASE WHEN r.article_id IS NULL THEN 0 WHEN o.ao IS NOT NULL THEN 1 ELSE 2 END AS rank FROM r LEFT JOIN o USING (layout_id, article_id)) "
    "SELECT layout_id, id AS region_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY layout_id ORDER BY rank, ao NULLS LAST, CASE WHEN rank = 1 THEN article_id END NULLS FIRST, reading_order NULLS LAST, id NULLS FIRST, pos) AS INTEGER) AS position FROM j"
)
def flatten_order(spark, sf_dir):
    regions, articles = layout.exploded(_layouts(spark, sf_dir))
    r = regions.select("layout_id", "pos", F.col("r.id").alias("region_id"), F.col("r.article_id").alias("article_id"), F.col("r.reading_order").alias("reading_order"))
    return reads.two_level_order(r, articles.select("layout_id", "a.id", "a.reading_order"), "layout_id")


@query(f"WITH {_TYPED} SELECT layout_id, CAST(pos AS INTEGER) AS pos, coalesce(needs_enhancement, false) OR coalesce(confidence < 0.85, true) AS hard FROM r")
def reader_choice(spark, sf_dir):
    return _regions(spark, sf_dir).select("layout_id", "pos", reads.hard(F.col("r.needs_enhancement"), F.col("r.confidence")).alias("hard"))


# Scans -----------------------------------------------------------------------------------------------------------------------


@query(
    "SELECT vec_id, list_filter([CASE WHEN embedding[1] * 100 < -5 THEN 'blur' END, CASE WHEN abs(embedding[2] * 20) > 2 AND abs(embedding[3]) >= 0.2 THEN 'skew' END, CASE WHEN abs(embedding[4]) < 0.002 THEN 'blank_page' END, CASE WHEN label < 3 THEN 'insufficient_resolution' END], lambda x: x IS NOT NULL) AS flags FROM embeddings"
)
def qc_flags(spark, sf_dir):
    """Features stand in for those of scans: there are no images here."""
    e = lambda i: F.get("embedding", F.lit(i))
    scans = read(spark, sf_dir, "embeddings").select(
        "vec_id", (e(0) * 100).alias("blur_laplacian_variance"), (e(1) * 20).alias("skew_degrees"), F.abs(e(2)).alias("skew_confidence"), F.lit(1.0).alias("orientation_gradient_ratio"), F.lit(0.0).alias("illumination_grid_range"),
        (F.abs(e(3)) + F.lit(0.001)).alias("ink_coverage"), F.lit(0.0).alias("edge_ink_ratio"), (F.col("label") * 600 + 1).alias("width"), (F.col("label") * 600 + 1).alias("height"),
    )
    return quality.flags(scans, {"blur": -5.0, "blank": 0.003}).select("vec_id", "flags")


@query(
    "WITH h AS (SELECT vec_id AS idx, list_reduce(list_transform(range(0, 64), lambda i: CASE WHEN embedding[CAST(i // 4 + 1 AS BIGINT)] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END), lambda a, b: a + b) AS h FROM embeddings), "
    "p AS (SELECT b.idx, a.idx AS other, bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) AS d FROM h a JOIN h b ON a.idx < b.idx WHERE bit_count(CAST(xor(a.h, b.h) AS HUGEINT)) <= 3) "
    "SELECT idx, min(other) AS duplicate_of, CAST(arg_min(d, other) AS INTEGER) AS hash_distance FROM p GROUP BY idx"
)
def near_duplicates(spark, sf_dir):
    """Hashes of the signs of the first sixteen numbers of each vector, four bits for each."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("embedding", F.floor(i / 4).cast("int")) > 0, F.expr("1L")).otherwise(F.expr("0L")))
    folded = F.aggregate(F.reverse(bits), F.expr("0L"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    scans = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), folded.alias("hash"), F.lit(None).cast("string").alias("sha256"))
    return quality.duplicates(scans)


# Tables and events -----------------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, length(coalesce(heading, '')) DESC, doc_id) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(text) AS sha FROM s WHERE n = 1")
def dedup_strongest(spark, sf_dir):
    df = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.coalesce("n_chars", F.lit(-1)).alias("n"), F.length(F.coalesce("heading", F.lit(""))).alias("h"))
    return tables.strongest(df, "sha", ["n", "h"], "doc_id").select("doc_id", "sha")


@query(
    "SELECT * FROM (SELECT 'pages' AS table_name, count(*) AS n FROM pages UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'manual_layouts', count(*) FROM manual_layouts "
    "UNION ALL SELECT 'article_input', count(*) FROM article_input UNION ALL SELECT 'batches', count(*) FROM batches UNION ALL SELECT 'stage_events', count(*) FROM stage_events UNION ALL SELECT 'documents', count(*) FROM documents)"
)
def table_stats(spark, sf_dir):
    return tables.counts({t: read(spark, sf_dir, t) for t in ("pages", "articles", "passages", "manual_layouts", "article_input", "batches", "stage_events", "documents")})


_LATEST = "SELECT scan_id, event_id, stage, status FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY event_id DESC) AS n FROM (SELECT DISTINCT * FROM stage_events)) WHERE n = 1"


@query(_LATEST)
def latest_per_key(spark, sf_dir):
    return tables.first_by(read(spark, sf_dir, "stage_events"), ["scan_id"], F.desc("event_id")).select("scan_id", "event_id", "stage", "status")


@query("WITH e AS (SELECT DISTINCT scan_id, event_id, stage, lower(trim(coalesce(status, 'unknown'))) AS s FROM stage_events) SELECT scan_id, arg_max(CASE WHEN s = 'complete' THEN stage ELSE concat_ws('_', stage, s) END, event_id) AS status, max(event_id) AS event_id FROM e GROUP BY scan_id")
def stage_status_latest(spark, sf_dir):
    return progress.current_status(read(spark, sf_dir, "stage_events"))


@query(
    "WITH e AS (SELECT DISTINCT scan_id, event_id, stage, lower(trim(status)) = 'complete' AS c FROM stage_events), n AS (SELECT *, CASE WHEN c AND row_number() OVER (PARTITION BY scan_id, stage, coalesce(c, false) ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS f FROM e) "
    "SELECT scan_id, event_id, CAST(sum(f) OVER (PARTITION BY scan_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM n"
)
def progress_monotonic(spark, sf_dir):
    return progress.running_steps(read(spark, sf_dir, "stage_events"))


#: The stages of a scan as stages of a job, with a detail made from the number of the event where the stage has one.
_JOB_STAGES = {
    "queued": "Thinking", "inspect": "Page", "quality": "Preprocessing", "layout": "Detected reading regions", "crop": "Building article columns", "read_a": "Transcribing regions",
    "read_b": "Independent article read", "compare": "Independent reads agree", "reconcile": "Verifying proposed text edits", "article": "Discovering articles and headings",
    "save_article": "Article saved", "overlay": "Reconstructing document", "audit": "Some other stage", "index": "Saved Markdown", "publish": "Agentic page complete", "complete": "Complete",
}
_JOB_SQL = (
    "j AS (SELECT DISTINCT scan_id AS job_id, event_id AS seq, CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _JOB_STAGES.items()) + " ELSE stage END AS stage, "
    "CASE WHEN stage = 'inspect' AND event_id % 4 > 0 THEN (event_id % 4) || '/' || (event_id % 3) WHEN stage IN ('read_a', 'read_b') THEN (event_id % 13) || ' / ' || (event_id % 11) WHEN stage = 'save_article' THEN (event_id % 17) || ' articles' "
    "WHEN stage = 'complete' AND event_id % 3 = 0 THEN 'saved' WHEN event_id % 5 > 0 THEN '' END AS detail FROM stage_events)"
)


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_JOB_SQL} SELECT * FROM j".replace("FROM stage_events", "FROM {events}"), events=read(spark, sf_dir, "stage_events"))


@query(
    f"""WITH RECURSIVE {_JOB_SQL},
    e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS n, coalesce(detail, '') AS d, regexp_extract(coalesce(detail, ''), '(\\d+)\\s*/\\s*(\\d+)', 1) AS x, regexp_extract(coalesce(detail, ''), '(\\d+)\\s*/\\s*(\\d+)', 2) AS y FROM j),
    f AS (SELECT job_id, seq, stage, detail, n, try_cast(x AS DOUBLE) AS a, try_cast(y AS DOUBLE) AS b, stage = 'Complete' AND d = '' AS ended, CASE
      {" ".join(f"WHEN stage = '{s}' THEN {p}" for s, p in progress.STAGE_PERCENT.items())} WHEN stage = 'Page' THEN 2 WHEN stage = 'Complete' THEN 96
      WHEN stage = 'Transcribing regions' THEN 30 + 42 * (CASE WHEN try_cast(y AS DOUBLE) > 0 THEN least(1.0, try_cast(x AS DOUBLE) / try_cast(y AS DOUBLE)) ELSE 0.0 END)
      WHEN stage = 'Independent article read' THEN 64 + 15 * (CASE WHEN try_cast(y AS DOUBLE) > 0 THEN least(1.0, try_cast(x AS DOUBLE) / try_cast(y AS DOUBLE)) ELSE 0.0 END)
      WHEN stage = 'Article saved' THEN least(49, 10 + 4 * try_cast(regexp_extract(d, '^(\\d+)', 1) AS DOUBLE)) END::DOUBLE AS now FROM e),
    r AS (SELECT job_id, n, CASE WHEN stage = 'Page' AND a IS NOT NULL THEN greatest(1.0, a) ELSE 1.0 END AS i, CASE WHEN stage = 'Page' AND a IS NOT NULL THEN greatest(1.0, a, b) ELSE 1.0 END AS t,
        CASE WHEN ended THEN NULL ELSE coalesce(now, 6.0) END AS page FROM f WHERE n = 1
      UNION ALL SELECT f.job_id, f.n, CASE WHEN f.stage = 'Page' AND a IS NOT NULL THEN greatest(1.0, a) ELSE r.i END, CASE WHEN f.stage = 'Page' AND a IS NOT NULL THEN greatest(1.0, a, b) ELSE r.t END,
        CASE WHEN ended THEN r.page WHEN f.stage = 'Page' AND a IS NOT NULL AND greatest(1.0, a) > r.i THEN 2.0 ELSE greatest(coalesce(r.page, 0.0), coalesce(now, r.page, 6.0)) END
      FROM r JOIN f ON f.job_id = r.job_id AND f.n = r.n + 1),
    o AS (SELECT f.*, CASE WHEN ended THEN 100.0 ELSE round_even(least(96.0, 96.0 * (i - 1 + page / 100.0) / t), 1) END AS reached FROM f JOIN r USING (job_id, n))
    SELECT job_id, seq, stage, detail, max(reached) OVER (PARTITION BY job_id ORDER BY seq) AS percent, NOT ended AS estimated FROM o"""
)
def progress_fold(spark, sf_dir):
    return progress.progress_batch(_job_events(spark, sf_dir))


@query()
def progress_stream(spark, sf_dir):
    """The events of a table as a stream of files, folded by the stateful operator until none is left; the result is a table in the shared folder."""
    import uuid

    from folio.session import shared_dir, written_path

    source = _job_events(spark, sf_dir)
    path = written_path(source, "events")
    out, state = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("progress", "state"))
    stream = progress.progress_stream(spark.readStream.schema(source.schema).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(progress.OUTPUT).parquet(out)


@query("SELECT time_bucket(INTERVAL 1 DAY, received_at) AS window_start, stage, count(*) AS n FROM (SELECT DISTINCT * FROM stage_events) WHERE received_at IS NOT NULL GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return progress.windowed_counts(read(spark, sf_dir, "stage_events").distinct().where("received_at is not null"), "received_at", "1 day")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")


@query("SELECT page_id, coalesce(json_extract_string(metadata_json, '$.publication'), publication) AS publication, json_extract_string(metadata_json, '$.reel') AS reel, len(json_keys(metadata_json)) AS n_keys FROM pages WHERE metadata_json IS NOT NULL")
def map_merge(spark, sf_dir):
    """Metadata of the file name with the page's own over it."""
    pages = read(spark, sf_dir, "pages").where("metadata_json is not null").select("page_id", F.create_map(F.lit("publication"), "publication").alias("own"), F.from_json("metadata_json", "map<string,string>").alias("given"))
    merged = F.map_concat(F.map_filter("own", lambda k, v: ~F.map_contains_key("given", k)), F.col("given"))
    return pages.select("page_id", F.try_element_at(merged, F.lit("publication")).alias("publication"), F.try_element_at(merged, F.lit("reel")).alias("reel"), F.size("given").cast("bigint").alias("n_keys"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def recent_n(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def last_20(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return read(spark, sf_dir, "events").withColumn("n", n).where("n <= 20").select("user_id", "event_id")


@query("WITH c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer), l AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) SELECT k, coalesce(l.v, c.v) AS v FROM c FULL JOIN l USING (k)")
def upsert_latest(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("bigint").alias("version"))
    changes = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("version"))
    return tables.upserted(base, changes, ["k"], "version").select("k", "v")


@query("WITH b AS (SELECT user_id AS k, min(event_id) AS first FROM events WHERE event_type = 'signup' GROUP BY 1), n AS (SELECT user_id AS k, min(event_id) AS first FROM events WHERE event_type = 'click' GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM b)")
def insert_or_ignore(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    base = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("k")).agg(F.min("event_id").alias("first"))
    return tables.inserted(base, e.where("event_type = 'click'").select(F.col("user_id").alias("k"), F.col("event_id").alias("first")), ["k"], F.asc("first"))


@query("SELECT page_id, article_id, CASE WHEN article_order >= 2 THEN article_order + 1 ELSE article_order END AS article_order FROM articles UNION ALL SELECT DISTINCT page_id, page_id || ':new', 2 FROM articles")
def order_insert_shift(spark, sf_dir):
    return tables.order_with_insert(read(spark, sf_dir, "articles"), "page_id", "article_id", "article_order", F.concat("page_id", F.lit(":new")), F.lit(2))


@query("SELECT page_id, article_id, CASE WHEN article_order = 1 THEN 3 WHEN article_order > 1 AND article_order <= 3 THEN article_order - 1 ELSE article_order END AS article_order FROM articles")
def order_move(spark, sf_dir):
    return tables.order_with_move(read(spark, sf_dir, "articles").select("page_id", "article_id", "article_order"), "article_order", F.lit(1), F.lit(3))


@query("SELECT b.batch_id, b.name, count(DISTINCT scan_id) AS scans, count(DISTINCT event_id) AS events FROM batches b LEFT JOIN stage_events e USING (batch_id) GROUP BY b.batch_id, b.name")
def batch_scan_counts(spark, sf_dir):
    e = read(spark, sf_dir, "stage_events").select("batch_id", "scan_id", "event_id").distinct()
    per_scan = e.groupBy("batch_id", "scan_id").agg(F.count("*").alias("events"))
    n = per_scan.groupBy("batch_id").agg(F.count("*").alias("scans"), F.sum("events").alias("events"))
    return read(spark, sf_dir, "batches").join(n, "batch_id", "left").select("batch_id", "name", F.coalesce("scans", F.lit(0)).alias("scans"), F.coalesce("events", F.lit(0)).alias("events"))


@query("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM articles a WHERE a.page_id = p.page_id) OR NOT EXISTS (SELECT 1 FROM stage_events e WHERE e.scan_id = 'scan:' || p.source_sha256)")
def exists_not_exists(spark, sf_dir):
    text = "SELECT page_id FROM {pages} p WHERE EXISTS (SELECT 1 FROM {articles} a WHERE a.page_id = p.page_id) OR NOT EXISTS (SELECT 1 FROM {events} e WHERE e.scan_id = concat('scan:', p.source_sha256))"
    return spark.sql(text, pages=read(spark, sf_dir, "pages"), articles=read(spark, sf_dir, "articles"), events=read(spark, sf_dir, "stage_events"))


@query("SELECT page_id, 'needs_transcription' AS reason FROM pages WHERE page_id NOT IN (SELECT page_id FROM articles)")
def review_backfill_anti(spark, sf_dir):
    return read(spark, sf_dir, "pages").join(read(spark, sf_dir, "articles"), "page_id", "left_anti").select("page_id", F.lit("needs_transcription").alias("reason"))


@query("SELECT article_id FROM articles WHERE page_id IN (SELECT page_id FROM pages WHERE workflow = 'manual')")
def in_subquery_semi(spark, sf_dir):
    return read(spark, sf_dir, "articles").join(read(spark, sf_dir, "pages").where("workflow = 'manual'"), "page_id", "left_semi").select("article_id")


@query("SELECT p.page_id, coalesce(l.coordinate_system, 'unreviewed') AS status FROM pages p LEFT JOIN (SELECT page_id, min(coordinate_system) AS coordinate_system FROM manual_layouts GROUP BY 1) l USING (page_id)")
def approval_left_join(spark, sf_dir):
    reviewed = read(spark, sf_dir, "manual_layouts").where("page_id is not null").groupBy("page_id").agg(F.min("coordinate_system").alias("c"))
    return read(spark, sf_dir, "pages").join(reviewed, "page_id", "left").select("page_id", F.coalesce("c", F.lit("unreviewed")).alias("status"))


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY publication_code, issue_date, page_number ORDER BY page_id DESC) AS n FROM pages WHERE publication_code IS NOT NULL) SELECT publication_code, issue_date, page_number, page_id, (SELECT count(*) FROM articles a WHERE a.page_id = o.page_id) AS n_articles FROM o WHERE n = 1")
def library_catalog(spark, sf_dir):
    return archive.catalogue(read(spark, sf_dir, "pages"), read(spark, sf_dir, "articles"))


@query(
    "WITH l AS (SELECT article_id, unnest(string_split(verbatim_text, chr(10))) AS line, unnest(range(len(string_split(verbatim_text, chr(10))))) AS line_no FROM articles), k AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS n, row_number() OVER (PARTITION BY article_id ORDER BY line_no) - 1 AS i FROM l WHERE trim(line) <> '') "
    "SELECT article_id, CAST(line_no AS INTEGER) AS line_no, CAST(CASE WHEN i < (3 - n % 3) * (n // 3) THEN i // greatest(n // 3, 1) ELSE 3 - n % 3 + (i - (3 - n % 3) * (n // 3)) // (n // 3 + 1) END AS INTEGER) AS column_no FROM k"
)
def line_bucket_split(spark, sf_dir):
    lines = read(spark, sf_dir, "articles").select("article_id", F.posexplode(F.split("verbatim_text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return tables.even_split(lines, "article_id", "line_no", 3).select("article_id", "line_no", "column_no")

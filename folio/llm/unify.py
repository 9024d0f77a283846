"""Bringing visually identical text to one form.

Fields with suspicious characters are cut into words; the distinct suspicious words are exploded to positioned code points, which
are joined with broadcast tables of forms, decompositions and look-alike letters; combining marks are put into the order of their
classes and recomposed, all of them, by a table of compositions; then the words are rebuilt and put back into their fields. The tables, and
what is suspicious, come from the Unicode character data and are bounded by it. What is composed otherwise than by marks (syllables of Hangul and
the like) is composed by an exact check at the end.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions.text import nfc
from folio.session import written

FIELDS = ("heading", "verbatim_text", "normalized_text")
#: Letters of one script that look like those of another, position by position.
LATIN, AS_CYRILLIC = "aceopxyABCEHKMOPTXY", "асеорхуАВСЕНКМОРТХУ"
CYRILLIC, AS_LATIN = "асеорхуАВСЕНКМОРТХУіѕјІЅЈһԛԝԁӏ", "aceopxyABCEHKMOPTXYisjISJhqwdl"
GREEK, GREEK_AS_LATIN = "οανριυκχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavpiukxcjABEZHIKMNOPTYX"
GREEK_C, GREEK_AS_CYRILLIC = "οαρεκχϲΑΒΕΗΚΜΟΡΤΥΧΓΠΦ", "оарекхсАВЕНКМОРТУХГПФ"
_INVISIBLE = (0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF)
_SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"


def ranges(points: set[int]) -> str:
    """Code points as the inside of a character class, in characters, which all engines read alike; none may be special there."""
    out, start = [], None
    for o in sorted(points):
        if start is None or o != end + 1:
            if start is not None:
                out.append(chr(start) + ("-" + chr(end) if end > start else ""))
            start = o
        end = o
    return "".join([*out, chr(start) + ("-" + chr(end) if end > start else "")] if start is not None else out)


def _odd() -> set[int]:
    """What may not be in the one form: all that composing changes or that may compose with what stands before it, marks, invisible characters, odd spaces, and forms of width, joined letters and styled letters."""
    out = {*_INVISIBLE, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for o in range(0x80, 0x30000):
        c = chr(o)
        form = unicodedata.decomposition(c)
        category = unicodedata.category(c)
        if unicodedata.combining(c) or category == "Zs" or not unicodedata.is_normalized("NFC", c) or _form(c, form, category):
            out.add(o)
        if form and form[0] != "<" and " " in form:
            out.add(int(form.split()[1], 16))
    return out


def _form(c: str, form: str, category: str) -> tuple[str, str] | None:
    """What a character becomes, and the kind of case, where it is one by itself."""
    if form.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", c), "width"
    if category[0] == "L" and (form.startswith("<font>") or form.startswith("<compat>") and len(unicodedata.normalize("NFKC", c)) > 1):
        return unicodedata.normalize("NFKC", c), "ligature" if form.startswith("<compat>") else "styled"
    if form and form[0] != "<" and " " not in form:
        return unicodedata.normalize("NFC", c), "combining"
    return None


_POINTS = _odd()
_ODD, _WIDE = ranges({o for o in _POINTS if o < 0x10000}), ranges({o for o in _POINTS if o >= 0x10000})
#: What makes a word worth a look, in an article in Cyrillic and in Latin letters.
SUSPICIOUS_C, SUSPICIOUS_L = rf"[{_ODD}{LATIN}\u0370-\u03ff]", rf"[{_ODD}\u0370-\u052f]"
#: The same beyond the basic plane, where few texts have anything: looking for it apart keeps the search fast.
SUSPICIOUS_WIDE = f"[{_WIDE}]"
#: Spaces other than the plain one; what words consist of, signs that are suspicious included.
_SIGNS = ranges({o for o in _POINTS if unicodedata.category(chr(o))[0] not in "LMNZ"})
_SPACE, _IN_WORD = rf"[{_SPACES}]", rf"[\p{{L}}\p{{M}}\p{{N}}{_SIGNS}]"
PIECES = rf"{_IN_WORD}+\.?|{_SPACE}|[^\p{{L}}\p{{M}}\p{{N}}{_SIGNS}{_SPACES}]+"
ROMAN = r"^(?=.{2})M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def _script(c: str) -> str:
    name = unicodedata.name(c, "")
    return next((s for s, w in (("L", "LATIN"), ("C", "CYRILLIC"), ("G", "GREEK")) if name.startswith(w)), "O")


@functools.cache
def code_points() -> tuple[list[tuple], list[tuple[str, str]]]:
    """(char, its form, kind of case, script, look in C, look in L) of letters with a script and of what is no plain character; (char, full canonical decomposition)."""
    rows, full = [], []
    looks_c = dict(zip(LATIN + GREEK_C, AS_CYRILLIC + GREEK_AS_CYRILLIC, strict=True))
    looks_l = dict(zip(CYRILLIC + GREEK, AS_LATIN + GREEK_AS_LATIN, strict=True))
    for o in range(0x30000):
        c = chr(o)
        category = unicodedata.category(c)
        if category in ("Cn", "Cs", "Co"):
            continue
        form = unicodedata.decomposition(c)
        to, kind = _form(c, form, category) or (c, None)
        if o in _INVISIBLE:
            to, kind = "", "invisible"
        elif category == "Zs" and c != " ":
            to, kind = " ", "space"
        elif not kind and form and form[0] != "<" and not 0xAC00 <= o < 0xD7A4:
            full.append((c, unicodedata.normalize("NFD", c)))
        plain = to[:1] or c
        if kind or (category[0] == "L" and _script(plain) != "O"):
            rows.append((c, to, kind, _script(plain) if plain.isalpha() else None, looks_c.get(to), looks_l.get(to)))
    return rows, full


@functools.cache
def compositions() -> list[tuple[str, str]]:
    """(base and mark, composed), as canonical composition has them."""
    out = []
    for o in range(0xC0, 0x30000):
        c = chr(o)
        form = unicodedata.decomposition(c)
        if form and form[0] != "<" and " " in form and unicodedata.is_normalized("NFC", c):
            base, mark = (chr(int(x, 16)) for x in form.split())
            if unicodedata.combining(mark):
                out.append((base + mark, c))
    return out


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables, all bounded by the Unicode character data."""
    points, full = code_points()
    classes = [(chr(o), unicodedata.combining(chr(o))) for o in range(0x300, 0x1F000) if unicodedata.combining(chr(o))]
    return tuple(
        F.broadcast(spark.createDataFrame(rows, schema))
        for rows, schema in (
            (points, "ch string, to string, kind string, of string, look_c string, look_l string"), (full, "ch string, full string"),
            (classes, "c string, class int"), ([(dict(compositions()),)], "compositions map<string,string>"),
        )
    )


def fields_of(articles: DataFrame) -> DataFrame:
    """(article_id, field, text, text_key): one row for each field that is neither null nor empty."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    return articles.select("article_id", F.explode(listed).alias("f")).select("article_id", "f.field", "f.text", F.xxhash64("f.text").alias("text_key")).where(F.length("text") > 0)


def _finder(which: str):
    """The words of a text with a suspicious character, each with a full stop after it, and its odd spaces. Words are tried at their starts only: long ones cost no more than their length."""
    import regex

    some, wide, beyond = re.compile(which).search, re.compile(SUSPICIOUS_WIDE).search, re.compile("[\U00010000-\U0010ffff]").search
    words = regex.compile(rf"{_SPACE}|(?<!{_IN_WORD}){_IN_WORD}++\.?").findall

    def find(text: str) -> list[str]:
        if beyond(text):
            return [w for w in dict.fromkeys(words(text)) if some(w) or wide(w)] if some(text) or wide(text) else []
        return [w for w in dict.fromkeys(words(text)) if some(w)] if some(text) else []

    return find


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cyrillic, latin = _finder(SUSPICIOUS_C), _finder(SUSPICIOUS_L)
    letters = bytes(range(65, 91)) + bytes(range(97, 123))
    for batch in batches:
        row, field, key, script, word = [], [], [], [], []
        texts, keys = [c.to_pylist() for c in batch.columns[1:4]], [c.to_pylist() for c in batch.columns[4:7]]
        for i, found in enumerate(zip(*texts, strict=True)):
            raw = "".join(t for t in found if t).encode()
            if not raw:
                continue
            # Cyrillic letters begin with one of three bytes in UTF-8; the ASCII letters are most of the Latin ones.
            c = raw.count(b"\xd0") + raw.count(b"\xd1") + raw.count(b"\xd2")
            of = "C" if c > len(raw) - len(raw.translate(None, letters)) else "L"
            find = cyrillic if of == "C" else latin
            for k, t in enumerate(found):
                if t and (of == "C" or not t.isascii()):
                    for w in find(t):
                        row.append(i)
                        field.append(FIELDS[k])
                        key.append(keys[k][i])
                        script.append(of)
                        word.append(w)
        made = [pa.array(field, pa.string()), pa.array(key, pa.int64()), pa.array(script, pa.string()), pa.array(word, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *made], ["article_id", "field", "text_key", "script", "word"])


def _rebuilt(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["to"]), "")


def unified_words(words: DataFrame) -> DataFrame:
    """Of distinct (id, script, word): id, fixed, the word in the one form, and kinds, the cases found in it, in order."""
    points, decompositions, classes, composed = _tables(words.sparkSession)
    known = words.select("id", "script", F.posexplode(F.split("word", "")).alias("pos", "ch")).join(points, "ch", "left")
    look = F.when(F.col("script") == "C", F.col("look_c")).otherwise(F.col("look_l"))
    letter = F.col("of").isin("L", "C", "G")
    listed = known.select(
        "id", "pos", F.coalesce("to", "ch").alias("to"), "kind", F.when(letter & (F.col("of") != F.col("script")), F.coalesce(look, F.lit(""))).alias("look"), (letter & (F.col("of") == F.col("script"))).alias("own")
    )
    # look: null in letters of the article's script and in signs, empty in letters of others that look like none of its own.
    spelled = listed.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "to", "look"))).alias("parts"), F.collect_set("kind").alias("kinds"),
        F.count("look").alias("n_foreign"), F.count_if(F.col("look") != "").alias("n_look"), F.count_if("own").alias("n_own"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["to"]), "")
    # A word of foreign letters only may be a Roman numeral; a single X without a full stop after it may be one too.
    roman = (F.col("n_own") == 0) & (whole.rlike(ROMAN) | (whole == "X"))
    spelled = spelled.withColumn("taken", (F.col("n_foreign") > 0) & (F.col("n_look") == F.col("n_foreign")) & ~roman)
    fixed = F.array_join(F.transform("parts", lambda p: F.when(F.col("taken") & p["look"].isNotNull(), p["look"]).otherwise(p["to"])), "")
    first = spelled.select("id", fixed.alias("fixed"), F.when(F.col("taken"), F.array_append("kinds", F.lit("look-alike"))).otherwise(F.col("kinds")).alias("kinds"))
    marked = F.col("fixed").rlike(r"\p{M}")
    # Words with combining marks: decomposed fully, each code point with its class; a cluster is a starter with what follows it.
    apart = first.where(marked).select("id", "kinds", F.posexplode(F.split("fixed", "")).alias("pos", "ch")).join(decompositions, "ch", "left")
    apart = apart.select("id", "kinds", "pos", F.col("full").isNull().alias("given"), F.posexplode(F.split(F.coalesce("full", "ch"), "")).alias("sub", "c"))
    apart = apart.join(classes, "c", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    apart = apart.withColumn("cluster", F.count_if(F.col("class") == 0).over(Window.partitionBy("id").orderBy("pos", "sub")))
    clusters = apart.groupBy("id", "cluster").agg(
        F.min(F.when(F.col("class") == 0, F.col("c"))).alias("base"), F.any_value("kinds").alias("kinds"),
        F.array_sort(F.collect_list(F.when(F.col("class") > 0, F.struct("class", "pos", "sub", "c", "given")))).alias("marks"),
    )
    begun = F.struct(F.coalesce("base", F.lit("")).alias("base"), F.lit("").alias("rest"), F.lit(False).alias("made"), F.lit(-1).alias("last"))
    folded = clusters.crossJoin(composed).select("id", "cluster", "kinds", F.aggregate("marks", begun, lambda s, m: _taken(s, m, F.col("compositions"))).alias("s"))
    second = folded.groupBy("id").agg(
        _rebuilt(F.collect_list(F.struct("cluster", F.concat("s.base", "s.rest").alias("to")))).alias("fixed"), F.any_value("kinds").alias("kinds"), F.bool_or("s.made").alias("made")
    ).select("id", "fixed", F.when(F.col("made"), F.array_append("kinds", F.lit("combining"))).otherwise(F.col("kinds")).alias("kinds"))
    both = first.where(~marked).unionByName(second).withColumn("exact", nfc(F.col("fixed")))
    changed = (F.col("exact") != F.col("fixed")) & ~F.array_contains("kinds", "combining")
    return both.select("id", F.col("exact").alias("fixed"), F.array_sort(F.when(changed, F.array_append("kinds", F.lit("combining"))).otherwise(F.col("kinds"))).alias("kinds"))


def _taken(s: Column, m: Column, compositions: Column) -> Column:
    """One more mark of a cluster taken into its base, unless a mark of the same class that stayed outside stands between."""
    made = F.element_at(compositions, F.concat(s["base"], m["c"]))
    takes = made.isNotNull() & (m["class"] != s["last"])
    return F.struct(
        F.when(takes, made).otherwise(s["base"]).alias("base"), F.when(takes, s["rest"]).otherwise(F.concat(s["rest"], m["c"])).alias("rest"),
        (s["made"] | (takes & m["given"])).alias("made"), F.when(takes, s["last"]).otherwise(m["class"]).alias("last"),
    )


def suspicious_words(articles: DataFrame) -> DataFrame:
    """(article_id, field, text_key, script, word), written to the shared folder; script: C or L, the one most of the article's letters are of; text_key tells rows with the same id and field apart."""
    kind = articles.schema["article_id"].dataType.simpleString()
    kept = articles.select("article_id", *FIELDS, *[F.xxhash64(f).alias(f"key_{f}") for f in FIELDS])
    return written(kept.mapInArrow(_find, f"article_id {kind}, field string, text_key bigint, script string, word string"), "words")


def cases(articles: DataFrame) -> DataFrame:
    """(article_id, field, text_key, script, word, fixed, kinds): the distinct words of each field that are not in the one form, with their forms."""
    found = suspicious_words(articles).withColumn("id", F.struct(F.xxhash64("script", "word").alias("a"), F.xxhash64(F.lit(1), "word").alias("b")))
    forms = unified_words(found.select("id", "script", "word").distinct()).where(F.size("kinds") > 0)
    return found.join(forms, "id").drop("id")


def unify(articles: DataFrame) -> DataFrame:
    """(article_id, field, unified, kinds): every heading, verbatim_text and normalized_text in one form, and what it was not.

    kinds: of width, ligature, styled (letters of mathematics), combining, invisible, space, look-alike those that occurred, in alphabetical order; empty for a field that
    was in the form already, whose text passes unchanged. A word changes script only if all its letters of other scripts look
    like letters of the article's own and it is no Roman numeral. Null and empty fields give no rows; repeated rows and a null
    article_id are kept; without rows there are none; other columns are not read. Only suspicious fields are cut into words,
    each distinct suspicious word is worked on once, and the work is in proportion to the text.
    """
    fields = fields_of(articles)
    found = cases(articles).groupBy("article_id", "field", "text_key").agg(
        F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")
    ).withColumnsRenamed({"article_id": "__id", "field": "__field", "text_key": "__key"})
    same = fields.article_id.eqNullSafe(F.col("__id")) & (fields.field == F.col("__field")) & (fields.text_key == F.col("__key"))
    pieces = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    rebuilt = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at("forms", p), p)), "")
    return fields.join(found, same, "left").select(
        "article_id", "field", F.when(F.col("forms").isNull(), F.col("text")).otherwise(rebuilt).alias("unified"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds")
    )

"""Text functions as column expressions. Offsets and lengths count code points; white space is Unicode's, letters are any script's."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, as a class that Java and RE2 read alike.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
#: Where a text is divided into lines.
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

#: Words that a search ignores.
STOP_WORDS = tuple(
    """
    а аз в във да до за и как каква какви какво кой кои колко къде кога ли на от по при се си със с тези този то тя той
    a an at did do does how in is of on the to was were what when where which who
    """.split()
)
#: Further words that a search looks for.
EXPANSIONS = {
    "умира": ("почина", "смърт"), "умрял": ("почина", "смърт"), "учил": ("образование", "университет"), "учили": ("образование", "университет"),
    "die": ("почина", "смърт", "умира"), "died": ("почина", "смърт", "умира"), "death": ("смърт", "почина"), "old": ("години", "роден"),
    "age": ("години", "роден"), "born": ("роден",), "studied": ("учил", "образование", "университет"), "sick": ("болен", "боледуване", "заболяване"),
    "ill": ("болен", "боледуване", "заболяване"), "illness": ("болест", "боледуване", "заболяване"), "joking": ("шега", "сатира", "стършел"),
    "joke": ("шега", "сатира", "стършел"), "mocking": ("подигравка", "сатира", "стършел"), "contemptuous": ("презрение", "презрително", "сатира"),
    "attitude": ("отношение",), "attitudes": ("отношение",), "usa": ("съединените", "щати", "вашингтон"), "america": ("америка", "вашингтон"),
    "american": ("американски", "вашингтон"), "foreign": ("чуждестранни", "международни"), "partners": ("партньори", "съюзници"),
}
#: Latin groups and letters, and the Cyrillic ones for them.
LATIN_GROUPS = (("sht", "щ"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"))
LATIN_LETTERS, CYRILLIC_LETTERS = "abvgdeziyklmnoprstufh", "абвгдезийклмнопрстуфх"
#: How many resources a question gets, by the first pattern that it has; else DEFAULT_BUDGET.
BUDGETS = (
    (12, "all|every|exhaustive|throughout|всички|всякъде|изчерпателно"),
    (8, "examples?|compare|comparison|different|attitudes?|joking|mocking|примери?|сравни|сравнение|отношение|подиграв|шег|презрител"),
    (5, "evidence|indications?|signs?|whether|were there|данни|доказателства|индикации|признаци|дали|имало ли"),
)
DEFAULT_BUDGET = 3
#: Marks of cut output, and signs at which an ending is abrupt.
TRUNCATION_MARK = (
    r"(?i)(truncated\s+output|output\s+(was\s+)?truncated|\b\d[\d,._ ]*\s+(tokens?|characters?|chars?|bytes?)\s+truncated\b|[\[<({]\s*(output\s+)?truncated\s*[\]>)}])"
)
ABRUPT_ENDS = ",;:—–([«"


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Composed form. Arrow's own kernel leaves some letters apart, so Python's is used; texts that are composed already pass."""
    return pa.array([t if t is None or t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def trimmed(text: Column) -> Column:
    # White space is tried at the start of a run only, so that long runs within a text cost no more than their length.
    return F.regexp_replace(text, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def folded(text: Column) -> Column:
    """Case ignored; ß is ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_index(text: Column, compose: bool = True) -> Column:
    """The search form of a text: words joined at line ends, blanks collapsed, at most one blank line. Null gives ''."""
    text = F.coalesce(text, F.lit(""))
    text = unix_lines(nfc(text) if compose else text)
    for pattern, to in ((rf"(?<={WORD})-[ \t]*(?:\n[ \t]*)+(?={WORD})", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return trimmed(text)


def normalize_store(text: Column, compose: bool = True) -> Column:
    """The stored form: any hyphen before a line end goes, all white space becomes one blank."""
    text = nfc(text) if compose else text
    return trimmed(F.regexp_replace(F.regexp_replace(text, rf"-{SPACE}*\n{SPACE}*", ""), rf"{SPACE}+", " "))


def normalize_scoring(text: Column, policy: str = "verbatim") -> Column:
    """verbatim: composed only. search: lines joined, a hyphen at a line's end dropped, case ignored, white space collapsed."""
    if policy not in ("verbatim", "search"):
        raise ValueError(f"unknown scoring policy: {policy}")
    text = nfc(text)
    if policy == "verbatim":
        return text
    lines = F.transform(F.split(text, LINE_END), lambda x: F.when(F.endswith(x, F.lit("-")), F.left(x, F.length(x) - 1)).otherwise(F.concat(x, F.lit(" "))))
    return trimmed(F.regexp_replace(folded(F.array_join(lines, "")), rf"{SPACE}+", " "))


def normalize_agreement(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.lower(text), rf"{SPACE}+", " "))


def normalize_comparison(text: Column) -> Column:
    """Blanks collapsed and trimmed within lines; line breaks kept, but for blank lines at both ends."""
    lines = F.transform(F.split(unix_lines(nfc(text)), "\n"), lambda x: trimmed(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|(?<!\n)\n+$", "")


def anchor_key(text: Column) -> Column:
    return folded(trimmed(F.regexp_replace(nfc(text), rf"{SPACE}+", " ")))


def ownership_tokens(text: Column) -> Column:
    return F.regexp_extract_all(folded(nfc(text)), F.lit(rf"{WORD}+"), F.lit(0))


def coverage_tokens(text: Column) -> Column:
    """Distinct words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"\p{L}{3,}"), F.lit(0)))


def index_tokens(text: Column) -> Column:
    """Letters and digits; everything else, underscores included, divides."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.ceil(F.length(text) / F.lit(3.2))).otherwise(F.lit(0)).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(text), r"[^a-z0-9а-яѣ]+", "-"), r"^-+|-+$", "")


def transliterated(text: Column) -> Column:
    """Latin written Bulgarian in Cyrillic letters."""
    text = F.lower(text)
    for latin, cyrillic in LATIN_GROUPS:
        text = F.replace(text, F.lit(latin), F.lit(cyrillic))
    return F.translate(text, LATIN_LETTERS, CYRILLIC_LETTERS)


def safe_file_id(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", F.lit("article")).otherwise(cleaned)


def fraction(text: Column) -> Column:
    """The first a/b in a text as a number from 0 to 1; null without one or with b = 0."""
    a = F.try_to_number(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 1), F.lit("999999999")).cast("double")
    b = F.try_to_number(F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 2), F.lit("999999999")).cast("double")
    return F.when(b > 0, F.least(F.lit(1.0), a / b))


def budget(query: Column) -> Column:
    lowered, out = F.lower(query), F.lit(DEFAULT_BUDGET)
    for size, pattern in reversed(BUDGETS):
        out = F.when(lowered.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({pattern})($|[^\p{{L}}\p{{N}}_])"), F.lit(size)).otherwise(out)
    return out


def citations(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(R\d+)\]"), F.lit(1)))


def integrity_errors(text: Column) -> Column:
    """Names of traces of transport in a text: truncation_marker, replacement_character."""
    return F.array_compact(F.array(F.when(text.rlike(TRUNCATION_MARK), "truncation_marker"), F.when(F.contains(text, F.lit("�")), "replacement_character")))


def abrupt_ending(text: Column) -> Column:
    tail = trimmed(text)
    return F.coalesce(tail.rlike(rf"{WORD}-$") | (F.length(tail) > 0) & F.contains(F.lit(ABRUPT_ENDS), F.right(tail, F.lit(1))), F.lit(False))


def unresolved(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit("[неясно")) | F.contains(low, F.lit("[нечетливо"))


def quoted_span(text: Column, start: Column, end: Column) -> Column:
    """(begin, end) of what stands from the start quote to the end quote after it, from 0 and half open; null if either is missing."""
    begin = F.position(start, text)
    stop = F.when(end == start, begin).otherwise(F.position(end, text, begin + F.length(start)))
    return F.when((begin > 0) & (stop > 0), F.struct((begin - 1).alias("begin"), (stop - 1 + F.length(end)).alias("end")))


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines from first to last, from 0 and both included."""
    return F.array_join(F.slice(F.split(text, LINE_END), first + 1, last - first + 1), "\n")


def same_without_space(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, rf"{SPACE}+", "") == F.regexp_replace(b, rf"{SPACE}+", "")


def body_without_heading(text: Column, heading: Column) -> Column:
    """(body, inline): the text without a heading that it repeats on lines of its own; inline if it goes on in the same line."""
    heading = trimmed(F.coalesce(heading, F.lit("")))
    left = F.regexp_replace(text, rf"^{SPACE}+", "")
    rest = F.substring(left, F.length(heading) + 1, F.length(left))
    starts = (heading != "") & F.startswith(left, heading)
    inline = starts & (rest != "") & ~rest.rlike(r"^[\r\n]")
    return F.struct(F.when(starts & ~inline, F.regexp_replace(rest, r"^[\r\n ]+", "")).otherwise(text).alias("body"), inline.alias("inline"))


def expand_terms(query: str) -> list[str]:
    """The words a search looks for: without stop words and single letters unless nothing is left, then expansions, then transliterations."""
    raw = re.findall(r"\w+", query.casefold())
    terms = list(dict.fromkeys([t for t in raw if t not in STOP_WORDS and len(t) > 1] or raw))
    for t in tuple(terms):
        terms += [x for x in EXPANSIONS.get(t, ()) if x not in terms]
    for t in tuple(terms):
        if t.isascii() and t.isalpha() and t not in EXPANSIONS:
            other = t
            for latin, cyrillic in LATIN_GROUPS:
                other = other.replace(latin, cyrillic)
            other = other.translate(str.maketrans(LATIN_LETTERS, CYRILLIC_LETTERS))
            if other != t and other not in terms:
                terms.append(other)
    return terms

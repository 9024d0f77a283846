"""Repair of text from scanned pages: running headers, page numbers, words cut at line ends, misread characters.

Lines are labelled body, header or break (a page number) by a hidden Markov model over layout features, whatever paper they name; its
tables are counted from gold reads, where a line of the scan none of whose words is in the correct text is no body. Paragraphs are put
together from the body lines. What scanners take for what is learned too: from gold reads, aligned with their correct texts, and from all
words of the corpus, where a confusion shows as rare words that differ from far more frequent ones always by the same characters.
Misread is a word that becomes a far more frequent one when a confusion is undone, or that has a sign between its letters.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import sliced
from folio.llm.unify import AS_CYRILLIC, AS_LATIN, CYRILLIC, GREEK, GREEK_AS_CYRILLIC, GREEK_AS_LATIN, GREEK_C, LATIN
from folio.session import written

#: Bound of what the model is trained on: gold reads, the first by a hash.
MOST_GOLD = 5_000
#: A word is misread if undoing a confusion gives one that so many times as many articles have.
TIMES = 10
#: A confusion is learned from the corpus if it explains so many different words as misread, which are so large a part of all words
#: that differ by it; the right ones stand in so many texts at least. Words longer than this teach none.
LEAST_WORDS, LEAST_SHARE, LEAST_TEXTS, LONGEST = 3, 0.8, 20, 40
#: So many characters of candidates, about, are in a worker at once.
MOST_CHARACTERS = 1_000_000
#: Signs that stand for letters inside words.
SIGNS = "^|~¦†•§¢£¥"
HYPHENS = "-‐¬=⸗\xad"

_INVISIBLE = re.compile(r"[\u180e\u200b-\u200f\u2060-\u2064\ufeff]+")
_SOFT = re.compile(r"\xad(?!\s*\n)")
_NUMBER = re.compile(r"\W{0,4}(?:(?:стр|с|page|pag|seite|p|s)\b\.?\s*)?\W{0,3}(\d{1,3})\W{0,4}", re.I)
#: The number of an issue, and a date with its year at the end of a line, each set apart from what else the line has.
_ISSUE = re.compile(r"(?:^|[,·•—–|]\s*|\s{2})(?:брой|бр\.|no\.?|nr\.?|n°|№|num[ée]ro|issue)\s*\d+(?=$|\s*[,·•—–|]|\s{2})", re.I)
_DATE = re.compile(r"(?:^|[,·•—–|]\s*|\s{2})\d{1,2}(?:\.?\s+[^\W\d_]{3,}\s+|[./-]\d{1,2}[./-])(?:1[6-9]|20)\d\d$")
_SPACED = re.compile(r"(?:[^\W\d_]\s+){4,}[^\W\d_]\b")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^\W\d_](?:[\w^|~¦†•§¢£¥'’-]*\w)?|(?<![\d^|~¦†•§¢£¥])[\d^|~¦†•§¢£¥]+[^\W\d_][\w^|~¦†•§¢£¥]*")
_TAIL = re.compile(rf"([^\W_][\w{re.escape(SIGNS)}]*)([{HYPHENS}])\s*$")
_LEAD = re.compile(rf"^\s*([^\W_][\w{re.escape(SIGNS)}]*)")
_INNER = re.compile(rf"[^\W\d_][\d{re.escape(SIGNS)}]+[^\W\d_]")
#: What no right word has.
_NO_LETTER = re.compile(rf"[\d_{re.escape(SIGNS)}]")
STATES = ("body", "header", "break")
_FINISHED = re.compile(r"[.!?…:][\"”“»’)\]]*\s*$")
_SCRIPTS_MEET = re.compile(r"[a-z][\u0370-\u04ff]|[\u0370-\u04ff][a-z]|[\u0370-\u03ff][\u0400-\u04ff]|[\u0400-\u04ff][\u0370-\u03ff]")
_TO_CYRILLIC, _TO_LATIN = str.maketrans(LATIN + GREEK_C, AS_CYRILLIC + GREEK_AS_CYRILLIC), str.maketrans(CYRILLIC + GREEK, AS_LATIN + GREEK_AS_LATIN)


def plain(text: str) -> str:
    """Compatible forms composed, invisible characters gone; soft hyphens only where they end no line."""
    if text.isascii():
        return text
    if _INVISIBLE.search(text):
        text = _INVISIBLE.sub("", text)
    if "\xad" in text:
        text = _SOFT.sub("", text)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def one_script(words: list[str]) -> list[str]:
    """Lower-case words whose letters are of several scripts in the one that most are of, as far as they look like it."""
    return [w.translate(_TO_CYRILLIC if 2 * sum("а" <= c <= "я" for c in w) > len(w) else _TO_LATIN) if not w.isascii() and _SCRIPTS_MEET.search(w) else w for w in words]


def squeezed(text: str) -> str:
    return _NOT_LETTERS.sub("", text).lower()


_GAPS = re.compile(r"\S(?:\s{2,}|\s+[·•—–|]\s+)\S")
_STOP = re.compile(r"[.!?…:;,][\"'”“»’)\]]*$")
_INNER_STOP = re.compile(r"(?:\d|[^\W\d_]{4})[.!?…:;][\"'”“»’)\]]*\s")


def features(lines: list[str]) -> list[tuple]:
    """What the layout of each line shows: the sign of a head or number that it has, whether it is short, how it starts and ends, whether it breaks into a sentence."""
    long = sorted(map(len, lines))[len(lines) // 2] if lines else 0
    out = []
    going = False
    for i, x in enumerate(lines):
        s = x.strip()
        end = "stop" if _STOP.search(s) else "hyphen" if s[-1] in HYPHENS else "open"
        lower = s[0].islower()
        sign = "number" if len(s) <= 14 and _NUMBER.fullmatch(s) else "none"
        if sign == "none":
            upper = sum(map(str.isupper, s))
            if upper > 4 and upper > sum(map(str.islower, s)):
                sign = "spaced" if _SPACED.search(s) else "caps"
            if sign != "spaced" and end == "open" and len(s) <= 90 and not _INNER_STOP.search(s):
                digits = any(map(str.isdigit, s))
                same = " ".join(one_script(s.lower().split(" "))) if digits and _SCRIPTS_MEET.search(s.lower()) else s
                sign = "issue" if digits and _ISSUE.search(same) else "date" if digits and _DATE.search(s) else "gaps" if sign == "none" and _GAPS.search(s) else sign
        after = next((y.lstrip()[0] for y in lines[i + 1 : i + 2]), "")
        out.append((sign, len(s) * 4 < long * 3, "lower" if lower else "other", end, going and after.islower()))
        going = end == "hyphen" or end == "open"
    return out


#: What the model starts from, as counts of lines, so that few gold reads do, or none: of each state, the values of each feature, and the states after it.
PRIOR = {
    "body": ({"none": 40, "gaps": 1}, {False: 28, True: 12}, {"lower": 26, "other": 14}, {"open": 24, "stop": 9, "hyphen": 7}, {False: 35, True: 5}),
    "header": ({"issue": 3, "date": 2, "spaced": 2, "caps": 2, "gaps": 1}, {True: 5, False: 5}, {"other": 9, "lower": 1}, {"open": 10}, {True: 5, False: 5}),
    "break": ({"number": 8}, {True: 6, False: 2}, {"other": 6, "lower": 2}, {"open": 4, "stop": 2, "hyphen": 2}, {True: 4, False: 4}),
}
FOLLOWS = {"body": {"body": 36, "header": 2, "break": 2}, "header": {"body": 6, "header": 1, "break": 1}, "break": {"body": 6, "header": 1, "break": 1}}


class Model:
    """A hidden Markov model of the lines of a page, and the confusions of characters in gold reads."""

    def __init__(self):
        self.counts = {s: [Counter(c) for c in PRIOR[s]] for s in STATES}
        self.first, self.next = Counter(FOLLOWS["body"]), {s: Counter(c) for s, c in FOLLOWS.items()}
        self.known: dict[tuple, tuple[float, ...]] = {}
        self.confusions: tuple[tuple[str, str], ...] = ()
        self._weigh()

    def _weigh(self) -> None:
        self.start = {s: math.log((self.first[s] + 1) / (self.first.total() + 3)) for s in STATES}
        self.move = {a: {b: math.log((self.next[a][b] + 1) / (self.next[a].total() + 3)) for b in STATES} for a in STATES}
        self.known.clear()

    def train(self, pairs: list[tuple[str, str]]) -> Model:
        """From (scanned text, correct text)."""
        for scanned, correct in pairs:
            lines = [x for x in plain(scanned or "").split("\n") if x.strip()]
            right = set(plain(correct or "").split())
            last = None
            for x, f in zip(lines, features(lines), strict=True):
                words = [w for w in x.split() if len(w) > 1]
                foreign = len(words) < 12 and right.isdisjoint(words)
                state = "body" if not foreign else "break" if f[0] == "number" else "header"
                for k, v in enumerate(f):
                    self.counts[state][k][v] += 1
                if last:
                    self.next[last][state] += 1
                else:
                    self.first[state] += 1
                last = state
        self._weigh()
        self.confusions = tuple(sorted({c for scanned, correct in pairs for c in differences(repaired(scanned or "", self), plain(correct or ""))}))
        return self

    def _emission(self, f: tuple) -> tuple[float, ...]:
        found = self.known.get(f)
        if found is None:
            found = self.known[f] = tuple(sum(math.log((c[v] + 0.2) / (c.total() + 1)) for c, v in zip(self.counts[s], f, strict=True)) for s in STATES)
        return found

    def label(self, lines: list[str]) -> list[str]:
        """The most likely states of lines that aren't blank."""
        seen = [self._emission(f) for f in features(lines)]
        # Where no line is likelier, by more than a way there could save, to be anything else, all are body: no other path can win.
        spare = 2 * self.move["body"]["body"]
        if self.start["body"] >= max(self.start.values()) and all(max(e[1:]) - spare < e[0] for e in seen):
            return ["body"] * len(lines)
        best = [self.start[s] + e for s, e in zip(STATES, seen[0], strict=True)]
        back = []
        for e in seen[1:]:
            steps = [max((best[i] + self.move[a][b], i) for i, a in enumerate(STATES)) for b in STATES]
            best = [s[0] + e[k] for k, s in enumerate(steps)]
            back.append([s[1] for s in steps])
        at = max(range(3), key=best.__getitem__)
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return [STATES[i] for i in reversed(path)]


def differences(read: str, correct: str) -> list[tuple[str, str]]:
    """(read, true): the characters that differ in the aligned words of two texts; case ignored, up to two characters for one or one for two."""
    a, b = read.lower().split(), correct.lower().split()
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "replace" or j - i != m - k:
            continue
        for u, v in zip(a[i:j], b[k:m], strict=True):
            found = [c for c in difflib.SequenceMatcher(None, u, v, autojunk=False).get_opcodes() if c[0] != "equal"]
            out += [(u[p:q], v[r:s]) for _, p, q, r, s in found if len(found) < 3 and 2 <= q - p + s - r <= 3 and q > p and s > r]
    return out


def read_page(text: str, model: Model) -> tuple[list[list[str]], list[str], list[int]]:
    """The body lines by paragraph, the running heads and the page numbers. A blank line beside a header or number divides no paragraph that goes on."""
    raw = plain(text).split("\n")
    lines = [x for x in raw if x.strip()]
    states = model.label(lines) if lines else []
    paragraphs: list[list[str]] = [[]]
    heads: list[str] = []
    numbers: list[int] = []
    blank = noise = False
    at = -1
    for x in raw:
        if not x.strip():
            blank = True
            continue
        at += 1
        state = states[at]
        before = paragraphs[-1]
        unfinished = bool(before) and not _FINISHED.search(before[-1])
        if state == "break":
            found = _NUMBER.fullmatch(x.strip())
            if found:
                numbers.append(int(found[1]))
            # A number that ends a sentence may stand alone on its last line: the text ends there, or goes on with a capital.
            if found and not blank and unfinished and x.rstrip().endswith(".") and x.strip()[0].isdigit() and (at + 1 == len(lines) or not lines[at + 1].lstrip()[0].islower()):
                state = "body"
        if state == "body":
            if blank and before and not (noise and unfinished):
                paragraphs.append([])
            paragraphs[-1].append(x)
            blank = noise = False
            continue
        noise = True
        if state == "header":
            heads.append(x.strip())
    return [p for p in paragraphs if p], heads, numbers


def pieces(lines: list[str]) -> tuple[list[str], list[str], bool]:
    """A paragraph in one line, divided where a plain hyphen cut a word; these words, as left-right; and whether another hyphen cut one."""
    done: list[str] = []
    parts = [lines[0].strip()]
    maybe: list[str] = []
    certain = False
    for x in lines[1:]:
        x = x.strip()
        before = parts[-1]
        if before and before[-1] in HYPHENS and (right := _LEAD.match(x)) and (left := _TAIL.search(before.rsplit(None, 1)[-1])) and not (right[1][0].isupper() and not left[1][-1].isupper()):
            parts[-1] = before[:-1]
            if left[2] == "-":
                maybe.append(f"{left[1]}-{right[1]}".lower())
                done.append("".join(parts))
                parts = []
            else:
                certain = True
        else:
            parts.append(" ")
        parts.append(x)
    return [*done, "".join(parts)], maybe, certain


def joined(lines: list[str]) -> tuple[str, list[str], bool]:
    """A paragraph in one line; the words that a plain hyphen cut, as left-right; and whether another hyphen cut one."""
    found, maybe, certain = pieces(lines)
    return "".join(found), maybe, certain


def repaired(text: str, model: Model) -> str:
    """The text as continuous paragraphs, divided by blank lines."""
    paragraphs, _, _ = read_page(text, model)
    return "\n\n".join(" ".join(joined(p)[0].split()) for p in paragraphs)


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cut, maybe, head, numbers, words = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                paragraphs, heads, found = read_page(text, model)
                certain, unsure, seen = False, set(), set()
                for p in paragraphs:
                    whole, m, c = joined(p)
                    certain |= c
                    unsure.update(one_script(m))
                    seen.update(one_script(_WORD.findall(whole.lower())))
                cut.append(certain)
                maybe.append(list(unsure))
                head.append(bool(heads))
                numbers.append(found)
                words.append([w for w in seen if len(w) > 2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut), pa.array(maybe, pa.list_(pa.string())), pa.array(head), pa.array(numbers, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.string()))],
                ["__key", "cut", "maybe", "head", "numbers", "words"],
            )

    return run


def trained(gold: DataFrame) -> Model:
    """The model, from at most MOST_GOLD gold reads, the first by a hash."""
    first = gold.select("prediction_text", "reference_text").distinct().orderBy(F.xxhash64("prediction_text", "reference_text")).limit(MOST_GOLD)
    return Model().train([(r[0], r[1]) for r in first.collect()])


def likely(word: str, confusions: tuple[tuple[str, str], ...], longest: int | None = None) -> Iterator[str]:
    """What the word may have been: one confusion undone, or all of its signs and digits, if that makes a word without any, no longer than the longest asked for.

    Others are no right words. So what joins the fields of a table by signs and digits, or is as long as a text, isn't written out anew for each of its places.
    """
    stops = [m.start() for m in _NO_LETTER.finditer(word)]
    for read, true in confusions:
        if longest is not None and len(word) - len(read) + len(true) > longest or _NO_LETTER.search(true) or stops and stops[-1] - stops[0] >= len(read):
            continue
        # All signs and digits must be in what is exchanged.
        least, most = (max(0, stops[-1] - len(read) + 1), stops[0]) if stops else (0, len(word))
        at = word.find(read, least)
        while 0 <= at <= most:
            yield word[:at] + true + word[at + len(read) :]
            at = word.find(read, at + 1)
    if sum(c in SIGNS or c.isdigit() for c in word) > 1:
        for script in (False, True):
            table = {a: b for a, b in confusions if len(a) == 1 and not a.isalpha() and ("а" <= b <= "я") == script}
            if all(word[i] in table for i in stops):
                found = "".join(table.get(c, c) for c in word)
                if found != word and not _NO_LETTER.search(found) and (longest is None or len(found) <= longest):
                    yield found


def _candidates(confusions: tuple[tuple[str, str], ...], longest: int | None = None):
    """(word, df) to (word, df, true_word), in batches of about MOST_CHARACTERS, however long the words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):

            def made(row: list[int], found: list[str], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array(found, pa.string())], ["word", "df", "true_word"])

            row, found, size = [], [], 0
            for i, w in enumerate(batch.column(0).to_pylist()):
                for true in likely(w, confusions, longest):
                    row.append(i)
                    found.append(true)
                    size += len(w) + len(true)
                    if size >= MOST_CHARACTERS:
                        yield made(row, found)
                        row, found, size = [], [], 0
            yield made(row, found)

    return run


def scanned(articles: DataFrame, model: Model) -> DataFrame:
    """One row for each article with a text: (article_id, page_id, h, cut, maybe, head, numbers, words), h a hash of the text; written to the shared folder. Null and blank texts give none."""
    kept = articles.where(F.length(F.trim("verbatim_text")) > 0).select(F.struct("article_id", "page_id", F.xxhash64("verbatim_text").alias("h")).alias("__key"), "verbatim_text")
    schema = f"__key {kept.schema['__key'].dataType.simpleString()}, cut boolean, maybe array<string>, head boolean, numbers array<int>, words array<string>"
    done = kept.mapInArrow(_scan(model), schema)
    return written(done.select("__key.article_id", "__key.page_id", "__key.h", "cut", "maybe", "head", "numbers", "words"), "scan")


def word_counts(scan: DataFrame) -> DataFrame:
    """(word, df): in how many different texts each word stands, over all of them; written to the shared folder. Copies count once: a misread word in a text with many copies is no more frequent for it."""
    once = scan.select("h", "words").dropDuplicates(["h"])
    return written(once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "words")


def confusions_of(counts: DataFrame, known: tuple[tuple[str, str], ...] = ()) -> tuple[tuple[str, str], ...]:
    """(read, true): the known confusions, and those learned from (word, df).

    Words that are equal but for one place within them, one or two characters there against one or one against two, meet at the hash of what they
    have in common. Of all words that differ from a frequent one (LEAST_TEXTS) in the same way, nearly all (LEAST_SHARE) must be far rarer (TIMES),
    and they must be of LEAST_WORDS different ones: forms of a word differ from one another alike, but neither is the rarer throughout. The
    last two characters and the first are left out, for there words change by inflection. What comes to the driver is bounded by the characters.
    """
    able = counts.where(F.length("word").between(5, LONGEST))

    def cut(df: DataFrame, size: int, names: tuple[str, str, str]) -> DataFrame:
        at = df.where(F.length("word") >= 3 + size).withColumn("at", F.explode(F.sequence(F.lit(2), F.length("word") - 1 - size)))
        key = F.xxhash64(F.substr("word", F.lit(1), F.col("at") - 1), F.substr("word", F.col("at") + size))
        return at.select(key.alias("key"), F.col("word").alias(names[0]), F.col("df").alias(names[1]), F.substr("word", F.col("at"), F.lit(size)).alias(names[2]))

    left, right = ("word", "df", "read"), ("right", "right_df", "true")
    usual = able.where((F.col("df") >= LEAST_TEXTS) & F.col("word").rlike(r"^\p{L}+$"))
    one, two = cut(able, 1, left), cut(able, 2, left)
    met = one.unionByName(two).join(cut(usual, 1, right), "key").unionByName(one.join(cut(usual, 2, right), "key"))
    met = met.where(~(F.contains("read", F.col("true")) | F.contains("true", F.col("read"))))
    rarer = F.when(F.col("right_df") >= TIMES * F.col("df"), F.col("right"))
    found = met.groupBy("read", "true").agg(F.count_distinct(rarer).alias("rare"), F.count_distinct("right").alias("every"))
    rows = found.where((F.col("rare") >= LEAST_WORDS) & (F.col("rare") >= LEAST_SHARE * F.col("every"))).select("read", "true").collect()
    return tuple(sorted({*known, *((r.read, r.true) for r in rows)}))


def misread_words(counts: DataFrame, confusions: tuple[tuple[str, str], ...]) -> DataFrame:
    """(word, true_word): the words of the corpus that are misread, each with the most frequent word it may stand for; null where only a single sign between its letters tells."""
    able = "[" + "".join(sorted({a[0] for a, _ in confusions} | set(SIGNS))).replace("\\", r"\\").replace("]", r"\]").replace("[", r"\[").replace("^", r"\^").replace("-", r"\-") + "]"
    # As no word is in less than one text, right ones are in TIMES at least.
    known = counts.select(F.col("word").alias("true_word"), F.col("df").alias("true_df")).where(F.col("true_word").rlike(r"^[\p{L}'’-]+$") & (F.col("true_df") >= TIMES))
    longest = known.agg(F.max(F.length("true_word"))).first()[0] or 0
    rare = counts.where(F.col("word").rlike(able)).select("word", "df").mapInArrow(_candidates(confusions, longest), "word string, df bigint, true_word string")
    long = rare.where((F.length("true_word") >= 4) | ~F.col("word").rlike(r"^\p{L}+$"))
    found = long.join(known, "true_word").where(F.col("true_df") >= TIMES * F.col("df"))
    by_word = found.groupBy("word").agg(F.max_by("true_word", F.struct("true_df", "true_word")).alias("true_word"))
    signed = counts.where(F.col("word").rlike(r"\p{L}[\d\^|~¦†•§¢£¥]\p{L}")).select("word", F.lit(None).cast("string").alias("true_word"))
    return by_word.unionByName(signed).groupBy("word").agg(F.max("true_word").alias("true_word"))


def own_hyphens(maybe: DataFrame, counts: DataFrame) -> DataFrame:
    """(word): those of (word), cut at a plain hyphen, that the corpus has with their hyphen, not less often than without."""
    whole = counts.where(F.col("word").contains("-")).select("word", F.col("df").alias("with_hyphen"), F.regexp_replace("word", "-", "").alias("without"))
    bare = counts.select(F.col("word").alias("without"), F.col("df").alias("n"))
    return maybe.select("word").distinct().join(whole, "word").join(bare, "without", "left").where(F.col("with_hyphen") >= F.coalesce("n", F.lit(0))).select("word")


def noise(articles: DataFrame, pages: DataFrame, gold: DataFrame) -> DataFrame:
    """(article_id, kind): the kinds of noise in each article's verbatim text: hyphen, misread, running_head, page_number.

    A line in the state header counts whatever paper it names; one in the state break if its number is the page's; where the page isn't
    known, any. A plain hyphen at a line end counts unless the corpus has the word with its hyphen at least as often as
    without. Null, empty and blank texts have no noise; repeated rows count once; a null article_id is kept; without rows there
    are none; other columns are not read. Words are counted over the body of all different texts, for running heads are damaged in other
    ways; only gold reads and confusions of characters reach the driver.
    """
    model = trained(gold)
    scan = scanned(articles, model)
    counts = word_counts(scan)
    numbered = pages.where("page_id is not null").groupBy("page_id").agg(F.any_value("page_number", True).alias("page_number"))
    number = scan.where(F.size("numbers") > 0).join(numbered, "page_id", "left").where(F.col("page_number").isNull() | F.array_contains("numbers", F.col("page_number")))
    maybe = scan.where(~F.col("cut")).select("article_id", F.explode("maybe").alias("word"))
    own = own_hyphens(maybe, counts)
    cut = scan.where("cut").select("article_id").unionByName(maybe.join(own, "word", "left_anti").select("article_id"))
    wrong = written(misread_words(counts, confusions_of(counts, model.confusions)).select("word"), "misread")
    misread = scan.select("article_id", F.explode("words").alias("word")).join(wrong, "word", "left_semi")
    kinds = {"hyphen": cut, "misread": misread, "running_head": scan.where("head"), "page_number": number}
    out = None
    for kind, rows in kinds.items():
        one = rows.select("article_id", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _repair(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [None if t is None else repaired(t, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__key", "__text"])

    return run


def repair(records: DataFrame, key: str, gold: DataFrame, text: str = "verbatim_text") -> DataFrame:
    """(key, repaired_text): each row's text as continuous paragraphs without running heads and page numbers, words joined; null stays null, blank gives ''."""
    kept = records.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    done = kept.mapInArrow(_repair(trained(gold)), f"__key {kept.schema['__key'].dataType.simpleString()}, __text string")
    return done.select(F.col("__key").alias(key), F.col("__text").alias("repaired_text"))


def _divide(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pieces", pa.list_(pa.string())), ("breaks", pa.list_(pa.string()))]))
        for batch in sliced(batches, 500):
            made, words = [], []
            for texts in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                seen, known = set(), {None: None}
                for text in dict.fromkeys(t for t in texts if t is not None):
                    out, breaks = [""], []
                    for p in read_page(text, model)[0]:
                        found, maybe, _ = pieces(p)
                        seen.update(one_script(_WORD.findall("".join(found).lower())))
                        found = [" ".join(x.split()) for x in found]
                        out[-1] += ("\n\n" if len(out) > 1 or out[0] else "") + found[0]
                        out += found[1:]
                        breaks += one_script(maybe)
                    known[text] = {"pieces": out, "breaks": breaks}
                made.append([known[t] for t in texts])
                words.append([w for w in seen if len(w) > 2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind), pa.array(words, pa.list_(pa.string()))], ["__key", "made", "words"])

    return run


#: Words that may be misread, which are never shorter.
_LONG = r"[\p{L}\p{N}\^|~¦†•§¢£¥'’-]{3,}+"
#: Words and what stands between them, as the JVM divides a text.
_PIECES = r"[\p{L}\p{N}\^|~¦†•§¢£¥'’-]+|[^\p{L}\p{N}\^|~¦†•§¢£¥'’-]+"


def corrected(articles: DataFrame, gold: DataFrame, fields: tuple[str, ...] = ("verbatim_text",)) -> DataFrame:
    """(article_id, field, repaired_text): each field as repair() has it, but compounds cut at their own hyphen keep it, and misread words are written as the word that they most likely were.

    Both are told by the counts of all words (see own_hyphens and misread_words), over all of the fields, a row's fields together counting once;
    capitals stay. Null texts stay null; repeated rows stay. Each text is read once.
    """
    model = trained(gold)
    kept = articles.select(F.struct("article_id", F.xxhash64(*fields).alias("h")).alias("__key"), *fields)
    schema = f"__key {kept.schema['__key'].dataType.simpleString()}, made array<struct<pieces:array<string>,breaks:array<string>>>, words array<string>"
    scan = written(kept.mapInArrow(_divide(model), schema).select("__key.article_id", "__key.h", "made", "words"), "divided")
    counts = word_counts(scan)
    wrong = written(misread_words(counts, confusions_of(counts, model.confusions)).where("true_word is not null"), "misread")
    one = scan.select("article_id", F.posexplode("made").alias("at", "x")).select("article_id", "at", "x.pieces", "x.breaks")
    divided = one.withColumn("key", F.xxhash64("article_id", "pieces", "breaks"))
    maybe = divided.where(F.size("breaks") > 0).select("key", F.explode(F.array_distinct("breaks")).alias("word"))
    own = maybe.join(own_hyphens(maybe, counts), "word").groupBy("key").agg(F.collect_set("word").alias("own"))
    hyphen = F.transform("breaks", lambda w: F.when(F.array_contains("own", w), "-").otherwise(""))
    text = F.when(F.col("own").isNull(), F.array_join("pieces", "")).otherwise(F.array_join(F.flatten(F.transform(F.arrays_zip("pieces", hyphen.alias("after")), lambda x: F.array(x["pieces"], F.coalesce(x["after"], F.lit(""))))), ""))
    field = F.element_at(F.array(*map(F.lit, fields)), F.col("at") + 1)
    # Texts are the larger side by far: hashing the other spares sorting them.
    made = divided.join(own.hint("shuffle_hash"), "key", "left").select("article_id", field.alias("field"), text.alias("repaired_text"))
    fixed = written(made.withColumn("key", F.xxhash64("article_id", "repaired_text")), "repaired")
    words = fixed.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("repaired_text"), F.lit(_LONG), F.lit(0)))).alias("word"))
    found = words.join(wrong, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "true_word"))).alias("true"))
    both = fixed.join(found.hint("shuffle_hash"), "key", "left")

    def right(p: Column) -> Column:
        true = F.element_at(F.col("true"), F.lower(p))
        first = F.left(p, F.lit(1))
        cased = F.when((F.upper(p) == p) & (F.length(p) > 1), F.upper(true)).when(F.upper(first) == first, F.concat(F.upper(F.left(true, F.lit(1))), F.substr(true, F.lit(2)))).otherwise(true)
        return F.coalesce(cased, p)

    text = F.array_join(F.transform(F.regexp_extract_all("repaired_text", F.lit(_PIECES), F.lit(0)), right), "")
    return both.select("article_id", "field", F.when(F.col("true").isNull(), F.col("repaired_text")).otherwise(text).alias("repaired_text"))

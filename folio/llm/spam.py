"""Finding pages made of repeated keywords, lists of links or product tags.

A text is divided into sentences and runs. A run is what no sentence end interrupts for longer than a sentence lasts, or has links or tags
every few words. Its terms are its words, and one term that stands for any link, one for any tag and one for any number beside words. What decides is how they recur: the gaps
between recurrences within a window of lags, and the positional autocorrelation at each lag. A newspaper's own lists (results, prices, names)
hardly repeat a term; stuffed keywords, links and tags do so at every few places. Runs of many different plain nouns without function words
count as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import sliced

#: Frequent function words of Bulgarian, English, German and French.
FUNCTION_WORDS = frozenset(
    """
    а без беше в във за и из или към която което който които край ли между на над не но от по под преди през при с със се след
    срещу това тази този че до докато
    a after and are as at before between by for from had has he her his in into is it not of on or she that the then they this to
    was were while who with within
    als am auf aus bei bis das dem den der des die durch ein eine einem einen einer für im in ist mit nach nicht noch oder sich und
    unter vom von vor war wurde zu zum zur zwischen
    au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ou par pas pour que qui sa se selon ses son
    sous sur tandis un une
    """.split()
)
#: Longest sentence in words, lags of the autocorrelation, and the least share of spam in a page that is spam.
SENTENCE, LAGS, MOST_PART = 45, 16, 0.5
#: Up to so many words without a function word or a name may be a keyword phrase closed with a full stop.
SHORT = 6
#: Of a run: terms that recur; those that equal the one a lag before them; recurrences within the lags; function words in a list of nouns.
RECURRENT, REGULAR, NEAR, NO_FUNCTION = 0.5, 0.3, 0.6, 0.03
#: Terms that a run needs for its recurrences to tell anything, and links and tags that do.
LEAST_TERMS, LEAST_MARKS = 8, 3
#: What stands for a link.
LINK = "\ue000"

_INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
_DOT = r"(?:\.|\s\.\s|\[\.\]|\(dot\)|\s?\[dot\]\s?)"
_URL = re.compile(rf"(?:h(?:tt|xx)ps?\s?:\s?//|w\s?w\s?w\s?{_DOT})\s?[^\s<>()\[\]]+(?:{_DOT}[^\s<>()\[\];,]+)*|\b[\w-]{{2,}}(?:\[\.\]|\(dot\))\w{{2,}}", re.I)
_END = re.compile(r"(?<!\b\w)[.!?…][\"'”“»’)\]]*(?=\s+[\"'„“«(–—]?\s?[^\W\d_a-zа-я]|\s*\n|\s*$)")
_WORD = re.compile(r"[^\W\d_]{2,}")
_TAG = re.compile(r"#(?=\w)")
_TERM = re.compile(rf"[{LINK}#]|\d+|[^\W\d_]{{2,}}")
#: Ends of lines of a newspaper's own lists: a result, a price.
_RESULT, _PRICE = re.compile(r"\s\d{1,3}\s?[:–-]\s?\d{1,3}$"), re.compile(r"\s[—–-]\s\d+(?:[.,]\d+)?$")


def _own_line(line: str) -> bool:
    """A result, a price, or a title, leaders and a page."""
    line = line.rstrip()
    if not line or not line[-1].isdigit():
        return False
    end = line[-24:]
    return line[-60:].rstrip("0123456789 ").replace(" ", "").endswith("...") or bool(_RESULT.search(end) or _PRICE.search(end))


def _recurrence(terms: list[str]) -> tuple[float, float, int, float, float]:
    """Of a run: the share of terms that recur, the greatest autocorrelation, its lag, the variation of the gaps, and the share of gaps within the lags."""
    n = len(terms)
    _, code, count = np.unique(np.array(terms), return_inverse=True, return_counts=True)
    often = count[code] > 1
    best, lag = 0.0, 0
    for k in range(1, min(LAGS, n - 1) + 1):
        same = float((code[k:] == code[:-k]).mean())
        if same > best:
            best, lag = same, k
    order = np.argsort(code, kind="stable")
    gaps = np.diff(order)[np.diff(code[order]) == 0]
    if not len(gaps):
        return 0.0, best, lag, 0.0, 0.0
    return float(often.mean()), best, lag, float(gaps.std() / gaps.mean()), float((gaps <= LAGS).mean())


def measure(text: str) -> tuple[float, float, float, float, float, float, int, float, float, bool]:
    """Shares of a text's characters: links, tags, runs that count as spam, sentences; and of its runs: recurrence, autocorrelation, lag, variation of gaps, gaps within the lags; is it spam?"""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    whole = sum(map(len, text.split()))
    if not whole:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, False
    sizes: list[int] = []

    def link(m: re.Match) -> str:
        sizes.append(len("".join(m[0].split())))
        return f" {LINK} "

    if "://" in text or "www" in text or "w w" in text or "hxxp" in text or "[.]" in text or "(dot)" in text:
        text = _URL.sub(link, text.replace(LINK, " "))
    tags = sum(map(len, re.findall(r"#\w+", text))) if "#" in text else 0
    links = sum(sizes)
    length = iter(sizes)

    def size(part: str) -> int:
        """Characters of a part, links as long as they were; parts come in order."""
        return sum(map(len, part.split())) + sum(next(length) - 1 for _ in range(part.count(LINK)))

    sentences = 0
    runs: list[tuple[str, int]] = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        part = text[at:end]
        at = end
        if not part.strip():
            continue
        marks = part.count(LINK) + (len(_TAG.findall(part)) if "#" in part else 0)
        count = part.count(" ") + part.count("\n")
        if marks >= LEAST_MARKS and marks * 4 >= len(part.split()):
            runs.append((part, size(part)))
        elif count > SENTENCE:
            # The last line of a run may be a sentence of its own.
            head, _, tail = part.rstrip().rpartition("\n")
            if head and _END.search(tail) and 4 < tail.count(" ") <= SENTENCE:
                runs.append((head, size(head)))
                sentences += size(tail)
            else:
                runs.append((part, size(part)))
        elif end == len(text) and not _END.search(part) and part.strip().count("\n") + part.count(",") + part.count("|") + part.count(" - ") + 2 * marks > 3:
            runs.append((part, size(part)))
        else:
            words = _WORD.findall(part.lower())
            if len(words) > 5 and len(set(words)) * 3 < len(words) or len(words) <= SHORT and FUNCTION_WORDS.isdisjoint(words) and part.strip()[1:].islower():
                runs.append((part, size(part)))
            else:
                sentences += size(part)
    stuffed = again = regular = spread = near = 0.0
    lag = 0
    if runs:
        lines = [x for part, _ in runs for x in part.split("\n")]
        own = sum(sum(map(len, x.split())) for x in lines if _own_line(x))
        listed = "\n".join(x for x in lines if not _own_line(x) and (LINK in x or any(map(str.isalpha, x))))
        part = sum(n for _, n in runs) - own
        terms = ["0" if t[0].isdigit() else t for t in _TERM.findall(listed.lower()) if t not in FUNCTION_WORDS]
        marks = sum(t in (LINK, "#") for t in terms)
        if part > 0 and (len(terms) >= LEAST_TERMS or marks >= LEAST_MARKS):
            again, regular, lag, spread, near = _recurrence(terms)
            words = _WORD.findall(listed.lower())
            if again >= RECURRENT and (regular >= REGULAR or near >= NEAR):
                stuffed = float(part)
            elif len(words) >= 25:
                function = sum(w in FUNCTION_WORDS for w in words) / len(words)
                digits = sum(map(str.isdigit, listed)) / part
                capitals = len(re.findall(r"\b[^\W\d_a-zа-яßàâäæçèéêëîïôöœùûü]", listed)) / len(words)
                if function < NO_FUNCTION and digits < 0.02 and capitals < 0.2:
                    stuffed = float(part)
    return min(1.0, links / whole), min(1.0, tags / whole), stuffed / whole, sentences / whole, again, regular, lag, spread, near, stuffed > MOST_PART * whole


_FIELDS = ("link_share", "tag_share", "stuffed_share", "sentence_share", "recurrent_share", "autocorrelation", "best_lag", "gap_variation", "near_gaps", "spam")
_TYPES = (*[pa.float64()] * 6, pa.int32(), *[pa.float64()] * 2, pa.bool_())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = [measure(t or "") for t in batch.column(1).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]], ["__key", *_FIELDS])


def measure_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, link_share, tag_share, stuffed_share, sentence_share, recurrent_share, autocorrelation, best_lag, gap_variation, near_gaps, spam).

    One row for each row, null keys and repeated rows included; null, empty and blank texts have shares of 0 and are no spam; other
    columns are not read; no rows give none. One scan without a shuffle; time is in proportion to the length of the texts.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"__key {kind}, link_share double, tag_share double, stuffed_share double, sentence_share double, recurrent_share double, autocorrelation double, best_lag int, gap_variation double, near_gaps double, spam boolean"
    done = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(_measure, schema)
    return done.select(F.col("__key").alias(key), *_FIELDS)

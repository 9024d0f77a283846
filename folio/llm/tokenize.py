"""Encoding with a public byte-level BPE vocabulary, in time linear in the text.

Method: bytes are read as Latin-1 so that pyahocorasick can match the whole vocabulary at once. Going left to right the longest
token is tried first; it is kept if it may stand after the token before it, else the next shorter one is tried, and where none
fits the last token is taken back. Whether two tokens may stand side by side is decided by undoing merges from the later
one, and memoised. The result is exactly that of applying the merges in order of rank.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.batches import sliced

#: Fixed value: how the vocabulary's own tokenizer divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files lie, unless a path is given.
TOKENIZERS = os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers")
#: Pieces up to this many characters are remembered, at most so many at once; this bounds memory and changes no result.
CACHED_LENGTH, CACHED_PIECES = 40, 300_000


class ByteBPE:
    """A vocabulary of ranks in a .tiktoken file. Ranks are ids, and ids are in the order of the merges."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ids.items()}
        self.length = {i: len(t) for i, t in self.token.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for t, i in self.ids.items():
            self.shorter[i] = next((p for n in range(len(t) - 1, 0, -1) if (p := self.ids.get(t[:n])) is not None), -1)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.together: dict[tuple[int, int], bool] = {}
        for i in sorted(self.token):
            self._derive(i)
        self.together.clear()
        self.pieces = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def _derive(self, i: int) -> None:
        """The two tokens of which i is the merge: its only division into earlier ones that no earlier merge crosses."""
        text, left = self.token[i], self.shorter[i]
        while left >= 0:
            right = self.ids.get(text[self.length[left] :])
            if right is not None and left < i and right < i and self._fits(left, right):
                self.halves[i], self.merged[left, right] = (left, right), i
                return
            left = self.shorter[left]
        self.halves[i] = (i, i)

    def _fits(self, a: int, b: int) -> bool:
        """May b follow a? Not if undoing their merges, latest first, shows a merge across the border that comes earlier."""
        merged, halves = self.merged, self.halves
        limit = 1 << 62
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            later_left = a > b
            for left in (later_left, not later_left):
                if left:
                    limit, inner = a, halves[a][1]
                    if inner != a:
                        a = inner
                        break
                else:
                    limit, inner = b + 1, halves[b][0]
                    if inner != b:
                        b = inner
                        break
            else:
                return True

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        raw = text.encode("utf-8").decode("latin-1")
        if (whole := self.ids.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        longest = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (m, i) in self.automaton.iter(raw):
            start = end - m + 1
            if m > size[start]:
                size[start], longest[start] = m, i
        length, shorter, together = self.length, self.shorter, self.together
        usable = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, i = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while i >= 0:
                end = at + length[i]
                if usable[end]:
                    if last < 0:
                        break
                    ok = together.get((last, i))
                    if ok is None:
                        if len(together) > 2_000_000:
                            together.clear()
                        ok = together[last, i] = self._fits(last, i)
                    if ok:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, i = end, longest[end]
            else:
                usable[at] = 0
                i = out.pop()
                at -= length[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one. Strings of special tokens are ordinary text."""
        if not text:
            return []
        return list(itertools.chain.from_iterable(map(self._known, self.pieces(text))))

    def _known(self, piece: str) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.piece(piece)
            if len(piece) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path)


def path_of(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        for batch in sliced(batches):
            rows = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["__key", "__ids"])

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        known, pieces = bpe._known, bpe.pieces
        for batch in batches:
            rows = [sum(map(len, map(known, pieces(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64())], ["__key", "__n"])

    return run


def _typed(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; blank ones and ones that spell a special token are encoded like any other. Rows
    with the same key or text each give a row; a null key is kept; no rows give none. Other columns are not read. One scan,
    no shuffle; very long texts take time in proportion to their length.
    """
    kept = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    done = kept.mapInArrow(_ids(path_of(name, folder)), f"__key {_typed(df, key)}, __ids array<int>")
    return done.select(F.col("__key").alias(key), F.col("__ids").alias("ids"))


def token_counts(df: DataFrame, columns: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, into: str = "n_tokens") -> DataFrame:
    """The columns, and how many tokens each row's text has; 0 for null and empty texts. The ids themselves aren't sent back."""
    kept = df.select(F.struct(*[F.col(c) for c in columns]).alias("__key"), F.col(text).alias("__text"))
    kind = kept.schema["__key"].dataType.simpleString()
    done = kept.mapInArrow(_counts(path_of(name, folder)), f"__key {kind}, __n bigint")
    return done.select(*[F.col(f"__key.`{c}`").alias(c) for c in columns], F.col("__n").alias(into))

"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Tree concatenation. A text longer than a leaf is halved again and again, the
leaves are encoded as they stand, and neighbours are joined as a tree: a window
around the join is encoded anew and grows on each side until it ends where that
side's encoding stays whatever text stands beyond it. Such places are the ends
of words and numbers before white space or punctuation: the splitting pattern
always splits there, and what it does next depends on the text from there on
only. Outside the window the tokens of the halves stay.

A stretch without such a place can be as long as the text (a run of letters,
signs or blanks). Then the text is cut by one run of the pattern instead:

* Between two tokens of the splitting pattern parts simply stand side by side.
  Cuts are only made after a character that is not white space, as the pattern
  looks ahead inside white space; white space in front of a stretch goes out as
  the pattern split it, each match a stretch of its own.
* A stretch that the pattern does not split is halved in the same way; here the
  window grows until its first token is the left side's token at that place and
  its last token the right side's. An encoding is right exactly if every pair of
  adjacent tokens is one that encoding the two together would leave alone; pairs
  outside the window stand in one of the halves, so the result equals the
  encoding of the whole.

The tokenizer never sees more than a window at once, whatever the text. Texts up
to ``LONG_BYTES`` are encoded where they lie; the parts of longer ones are
encoded in parallel on all executors and put together again, with the same ids.

Null and empty texts have no tokens: their ids are the empty list.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import ensure_workers_import

#: Where the public vocabularies lie; any function takes another path.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_BYTES = 1 << 20
PART_CHARS = 1 << 18
PIECE_CHARS = 1 << 14
#: Characters of a leaf: texts up to this length are encoded as a whole.
LEAF_CHARS = 512
FIRST_WINDOW = 16
#: Fixed value: a place where the splitting pattern splits whatever stands around it.
SPLIT_PLACE = r"(?<=[\p{L}\p{N}])(?=[\s\p{P}])"

_LOADED: dict[str, ByteBpe] = {}


class ByteBpe:
    """A byte-level BPE from a file of ranks, with exact joining of encoded halves."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(SPLIT_PATTERN)
        self.place = regex.compile(SPLIT_PLACE)

    def leaf(self, text: str) -> list[int]:
        """Ids of a text of bounded length; strings of special tokens are ordinary text."""
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str, leaf: int = LEAF_CHARS, most: int = PIECE_CHARS) -> list[int]:
        """Ids of a text: halves encoded and joined as a tree."""
        n = len(text)
        if n <= leaf:
            return self.leaf(text)
        k = 1 << (-(-n // leaf) - 1).bit_length()
        ends = [n * i // k for i in range(k + 1)]
        row = [self.leaf(text[a:b]) for a, b in zip(ends, ends[1:])]
        while len(row) > 1:
            joined = []
            for i in range(0, len(row), 2):
                ids = self.join_texts(text, ends[i], ends[i + 1], ends[i + 2], row[i], row[i + 1], most)
                if ids is None:  # an unsplit stretch longer than any window
                    return self.assemble([(s, self.encode_part(s, p)) for s, p in self.parts(text, most, most)])
                joined.append(ids)
            row, ends = joined, ends[::2]
        return row[0]

    def join_texts(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int], most: int = PIECE_CHARS) -> list[int] | None:
        """Ids of text[start:end] from those of its halves; None if no window of ``most`` characters a side holds a lasting place."""
        first, last, width = None, None, FIRST_WINDOW
        while first is None or last is None:
            if first is None:
                begin = max(start, cut - width)
                places = [m.start() for m in self.place.finditer(text, begin, cut)]
                first = next((x for x in reversed(places) if begin < x < cut), start if begin == start else None)
            if last is None:
                stop = min(end, cut + width)
                last = next((m.start() for m in self.place.finditer(text, cut, stop) if cut < m.start() < stop), end if stop == end else None)
            if width > most:
                break
            width *= 2
        if first is None or last is None:
            return None
        i, j = self._tokens_of(text[first:cut], reversed(left)), self._tokens_of(text[cut:last], right)
        if i is None or j is None:
            return None
        return left[: len(left) - i] + self.leaf(text[first:last]) + right[j:]

    def _tokens_of(self, text: str, ids: Iterable[int]) -> int | None:
        """How many of the ids, in order, make up as many bytes as the text has; None if a token crosses its end."""
        size, n = len(text.encode()), 0
        for x in ids:
            if size <= 0:
                break
            size -= len(self.spelling[x])
            n += 1
        return n if size == 0 else None

    def piece(self, raw: bytes) -> list[int]:
        """Ids of bytes that the pattern would not split."""
        return self.encoding._encode_single_piece(raw) if raw else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded halves of one unsplit stretch."""
        if not left or not right:
            return left + right
        width = FIRST_WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.piece(b"".join([self.spelling[x] for x in (*left[i:], *right[:j])]))
            if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                return left[:i] + middle + right[j:]
            width *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Halves joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def parts(self, text: str, part_chars: int = PART_CHARS, piece_chars: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
        """Cut a text: (-1, part) stands alone, (n, part) belongs to the n-th unsplit stretch.

        The pattern runs over the text once, so no cut depends on a guess.
        """
        start, closed, stretch = 0, 0, 0
        blanks: list[tuple[int, int]] = []  # matches after the last one that ends in non-space, at ``closed``
        for found in self.pattern.finditer(text):
            begin, end = found.span()
            if end - begin > piece_chars:
                if closed > start:
                    yield -1, text[start:closed]
                for first, last in (*blanks, (begin, end)):
                    for at in range(first, last, piece_chars):
                        yield stretch, text[at : min(at + piece_chars, last)]
                    stretch += 1
                start = closed = end
                blanks.clear()
            elif text[end - 1].isspace():
                blanks.append((begin, end))
            else:
                closed = end
                blanks.clear()
                if end - start >= part_chars:
                    yield -1, text[start:end]
                    start = end
        if start < len(text):
            yield -1, text[start:]

    def encode_part(self, stretch: int, part: str) -> list[int]:
        """Ids of a part. A part that stands alone holds no stretch above a piece, but may be long: it goes up the tree too."""
        return self.encode_alone(part) if stretch < 0 else self.piece(part.encode())

    def encode_alone(self, part: str) -> list[int]:
        """Ids of a part between two splits of the pattern, encoded in runs of whole matches."""
        out: list[int] = []
        start = last = 0
        for found in self.pattern.finditer(part):
            if found.end() - start > PIECE_CHARS and last > start:
                out += self.leaf(part[start:last])
                start = last
            if not part[found.end() - 1].isspace():
                last = found.end()
        return out + self.leaf(part[start:])

    def assemble(self, parts: list[tuple[int, list[int]]]) -> list[int]:
        """Ids of a text from its encoded parts in order."""
        out: list[int] = []
        at = 0
        while at < len(parts):
            stretch, ids = parts[at]
            end = at + 1
            if stretch >= 0:
                while end < len(parts) and parts[end][0] == stretch:
                    end += 1
                ids = self.join_all([x for _, x in parts[at:end]])
            out += ids
            at = end
        return out


def load(path: str) -> ByteBpe:
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter((t for x in ids for t in x), np.int32, count=int(offsets[-1]))))


def encode_corpus(df: DataFrame, keys: list[str], text: Column | str, path: str | None = None, count_only: bool = False, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The token ids (or with ``count_only`` their number) of every text.

    Gives keys and ``ids`` ARRAY<INT> (``n_tokens`` LONG). Every row gives one
    row, repeated rows too; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ensure_workers_import(spark)
    path = path or f"{VOCABULARIES}/{BYTE_BPE}"
    column = F.col(text) if isinstance(text, str) else text
    slim = df.select(*keys, F.coalesce(column, F.lit("")).alias("_text"))
    types = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    value = "n_tokens long" if count_only else "ids array<int>"
    out_schema = f"{types}, {value}"

    def result(ids: list[list[int]]) -> pa.Array:
        return pa.array([len(x) for x in ids], pa.int64()) if count_only else _lists(ids)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], result(ids)], names=[*keys, value.split()[0]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at, t in enumerate(batch.column("_text").to_pylist()):
                row = batch.slice(at, 1)
                for number, (stretch, part) in enumerate(bpe.parts(t)):
                    extra = [pa.array([number], pa.int32()), pa.array([stretch], pa.int32()), pa.array([part])]
                    yield pa.RecordBatch.from_arrays([row.column("_row"), *[row.column(k) for k in keys], *extra], names=["_row", *keys, "_number", "_stretch", "_part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode_part(s, p) for s, p in zip(batch.column("_stretch").to_pylist(), batch.column("_part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("_row", *keys, "_number", "_stretch")], _lists(ids)], names=["_row", *keys, "_number", "_stretch", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        table = table.sort_by("_number")
        parts = list(zip(table.column("_stretch").to_pylist(), table.column("ids").to_pylist(), strict=True))
        first = table.slice(0, 1)
        return pa.Table.from_arrays([*[first.column(k) for k in keys], result([load(path).assemble(parts)])], names=[*keys, value.split()[0]])

    short = slim.where(F.octet_length("_text") <= long_bytes).mapInArrow(here, out_schema)
    long = slim.where(F.octet_length("_text") > long_bytes).withColumn("_row", F.monotonically_increasing_id())
    parts = long.mapInArrow(cut, f"_row long, {types}, _number int, _stretch int, _part string").repartition("_row", "_number")
    encoded = parts.mapInArrow(encode, f"_row long, {types}, _number int, _stretch int, ids array<int>")
    return short.unionByName(encoded.groupBy("_row").applyInArrow(assemble, out_schema))

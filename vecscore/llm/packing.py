"""Packing documents into sequences by shortest-pack-first over the length histogram.

Tokens are counted and cut in one pass over the texts: whole sequences of `size` tokens, and a
rest. Only the histogram of piece lengths (at most `size` numbers) comes to the driver. There,
lengths are placed longest first, each copy on the open pattern that holds least so far (the one
with the most room), if it fits there; if not, it opens a pattern. Copies are not placed one by
one: every pattern counts how many sequences have it, and a step moves as many as it can.

The patterns' places go back as a table of rank intervals by length, and each piece finds its
place by its rank among the pieces of its length. A task of the first pass numbers its own pieces
by length as it writes them; adding the counts of the tasks before gives the rank, so that pieces
are neither sorted nor shuffled for it, however frequent a length is.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from vecscore.llm.common import join_measured, stage, text_lists, trim

SIZE = 2048
END = 1
#: Bounds of what one Python worker remembers: pieces of text, and the characters of each.
MOST_PIECES, LONGEST_PIECE = 1 << 19, 64


@lru_cache(1)
def _tokenizer(path: str | None):
    import public_tokenizers

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


_BLANK = re.compile(r"[^ \t\n\r]+").findall


def _some(pattern: str) -> str:
    """The characters up to U+017F that match a pattern, for use between brackets: a plain set is matched faster than its classes."""
    return "".join(re.escape(c) for c in map(chr, range(0x180)) if re.match(pattern, c))


# The tokenizer's own pieces, for the texts that `_OTHER` does not find anything in.
_PIECES = re.compile(rf"[{_some(r'[^\W\d_²³¹¼½¾]')}]+|[{_some(r'[\d²³¹¼½¾]')}]|'s|'t|'re|'ve|'m|'ll|'d|[{_some(r'[^\w\s]|_')}]+").findall
_OTHER = re.compile("[^\\0-\u017f]|[\u0130\x1c-\x1f\x85\xa0]|<\\|").search
# What `_OTHER` finds in texts of Latin-1, where single searches are much faster.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")
_WORD = re.compile(rf"[{_some(r'[^\W\d_²³¹¼½¾İ]')}]{{1,{LONGEST_PIECE}}}").fullmatch


def _other(text: str) -> bool:
    """Whether `_OTHER` finds anything."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _OTHER(text) is not None
    return any(map(text.__contains__, _ODD))


class _Known(dict):
    """Packed ids by piece of text.

    Texts of plain Latin letters are lower-cased and cut as the tokenizer would; any other text is
    cut at blanks alone, which no token spans. When half of MOST_PIECES are here, they become
    `old`, and what was old is forgotten; a piece that is met again comes back from there.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = tokenizer
        # For words of letters: the same model after splitting at blanks alone; a word's last token says so. ASCII stands for itself in it.
        self.ascii, self.lean = Tokenizer(tokenizer.model), Tokenizer(tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def cut(self, text: str) -> list[str]:
        return _BLANK(text) if _other(text) else _PIECES(text.lower())

    def fill(self, pieces: set[str]) -> dict[str, bytes]:
        """Make sure that these pieces, which are not here, are known; returns those too long to be remembered."""
        if len(self) > MOST_PIECES // 2:
            self.old = dict(self)
            self.clear()
        known = [t for t in pieces if t in self.old]
        self.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = pieces.difference(known)
        # Upper case is only met in texts cut at blanks alone, whose pieces the tokenizer itself lower-cases.
        words = [t for t in new if _WORD(t) and t.islower()]
        for model, some in ((self.ascii, [t for t in words if t.isascii()]), (self.lean, [t for t in words if not t.isascii()])):
            if some:
                ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                packed, stop = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                self.update(zip(some, [packed[a:b] for a, b in zip([0, *stop], stop, strict=False)], strict=True))
        rest, long = list(new.difference(words)), {}
        for t, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            (self if len(t) <= LONGEST_PIECE else long)[t] = np.array(e.ids, "<u4").tobytes()
        return long


@lru_cache(1)
def _known(path: str | None) -> _Known:
    return _Known(_tokenizer(path))


def token_bytes(texts: list[str | None], path: str | None = None, end: int = END) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, with the end id."""
    known, closing = _known(path), np.array([end], "<u4").tobytes()
    cut = [known.cut(t or "") for t in texts]
    flat = list(chain.from_iterable(cut))
    packed = list(map(known.get, flat))
    if missing := [i for i, ids in enumerate(packed) if ids is None]:
        long = known.fill({flat[i] for i in missing})
        for i in missing:
            packed[i] = long[flat[i]] if flat[i] in long else known[flat[i]]
    upto = [0, *accumulate(map(len, cut))]
    return [b"".join(packed[lo:hi]) + closing for lo, hi in pairwise(upto)]


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, nth): every document cut at multiples of `size`.

    nth counts a task's pieces of one length from 0. It is only of use once the rows are written,
    as a task may run again elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for keys, texts in text_lists(batches, 2_000_000):
            out: list[list] = [[] for _ in range(5)]
            nth = []
            for key, packed in zip(keys, token_bytes(texts, path), strict=True):
                n = len(packed) // 4
                for at in range(0, n, size):
                    part = packed[4 * at : 4 * (at + size)]
                    for column, v in zip(out, (key, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(v)
                    nth.append(seen[len(part) // 4])
                    seen[len(part) // 4] += 1
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out], pa.array([task] * len(nth), pa.int32()), pa.array(nth, pa.int64())], names=[x.split()[0] for x in _PIECE.split(", ")])
        trim()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECE)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and their counts, by shortest-pack-first.

    The result is that of placing one piece after the other, longest first, each on the open
    pattern with the most room (ties: the greatest pattern) or, if it is too long for that one, on
    a new one.
    """
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, ...]]] = defaultdict(list)  # sorted patterns
    counts: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if pattern not in counts:
            if not by_room[room]:
                insort(rooms, room)
            insort(by_room[room], pattern)
        counts[pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length > size or length < 1:
            raise ValueError("lengths are from 1 to the sequence's size")
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern = by_room[room][-1]
            used = min(left, counts[pattern])
            counts[pattern] -= used
            if not counts[pattern]:
                del counts[pattern]
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop()
            put((*pattern, length), used, room - length)
            left -= used
        # None has room: new ones, each of which takes copies until it has no room either.
        many = size // length
        if left >= many:
            put((length,) * many, left // many, size - many * length)
        if left % many:
            put((length,) * (left % many), 1, size - left % many * length)
    return list(counts.items())


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, their sequences, offsets. Rank r is in sequence s + (r - first rank)."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out[length].append((taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Pieces of all documents with sequence_id and offset.

    Null text counts as empty: the end id alone. Null ids and repeated rows are documents like any
    others; an empty table gives an empty one; further columns are not looked at. Which of several
    pieces of one length goes into which of the sequences that hold this length depends on how
    the input is dealt over tasks; the patterns and their counts do not.
    """
    cut = stage(pieces(docs, id_col, text_col, size, path))
    counts = stage(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    table = places(pack_histogram(histogram, size))
    # A row per task and length, so the window of a length is as long as there are tasks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = join_measured(cut, offsets, ["task", "length"], F.lit(0), F.col("nth"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("first")).cast("bigint").alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # patterns: a few per length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                first, start, at = by_length[int(length)]
                i = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own], offset[own] = start[i] + ranks[own] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

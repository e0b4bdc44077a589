"""Byte-level BPE by a lazily determinised finite-state transducer.

The last token of the encoding of each prefix of a word decides the rest of that encoding:
token t ends at position i exactly if t is the suffix there and the pair (last token before t, t)
is what BPE itself makes of the two tokens' bytes. A state of the transducer therefore holds the
input's tail as far as a longer token may still begin in it, and for each such beginning the
tokens since the last point on which all of them agree. Those agreed on are emitted, so output
lags behind input by less than the longest token. States and arcs are made when first needed and
forgotten when there are too many.

Null text counts as empty and yields no ids; ids never depend on other rows.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from vecscore.llm.common import text_map

#: Bounds of what one Python worker remembers.
MAX_STATES, MAX_WORDS, MAX_PAIRS = 1 << 18, 1 << 19, 1 << 20


class _State:
    __slots__ = ("arcs", "live", "root", "tail")

    def __init__(self, root: int, tail: bytes, live: tuple):
        # live: (bytes since the beginning, tokens from the root up to it), earliest beginning first
        self.root, self.tail, self.live, self.arcs = root, tail, live, {}

    @property
    def rest(self) -> tuple[int, ...]:
        """What is still to be emitted if the input ends here."""
        return self.live[-1][1]


class Transducer:
    """Encodes the bytes of one pre-token at a time by the merge order given as ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        #: For each beginning of a token: its id if BPE makes it of its own bytes, else -1; whether a longer token begins so.
        self.known = {b[:k]: (-1, True) for b in ranks for k in range(1, len(b))}
        self.halves: dict[int, tuple[int, int]] = {}
        for b, i in ranks.items():
            parts = self.merge(b, 2) if len(b) > 1 else [b]
            if len(parts) == 2:
                self.halves[i] = ranks[parts[0]], ranks[parts[1]]
            self.known[b] = (i if len(parts) <= 2 else -1, b in self.known)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.start = _State(-1, b"", ((0, ()),))
        self.states: dict[tuple, _State] = {}

    def merge(self, data: bytes, stop: int = 1) -> list[bytes]:
        """BPE by definition: the adjacent pair of lowest rank first, leftmost of equals."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > stop:
            low, at = None, 0
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b apart after token a.

        Undoes the merges next to the boundary, last one first; a merge across the boundary that
        comes before the one undone would have been made instead.
        """
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            x, y, limit, found = a, b, 1 << 62, True
            while True:
                across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if across is not None and across < limit:
                    found = False
                    break
                left, right = self.halves.get(x), self.halves.get(y)
                if left and (not right or x > y):
                    limit, x = x, left[1]
                elif right:  # of equal ranks the leftmost goes first, so the boundary's does
                    limit, y = y + 1, right[0]
                else:
                    break
            self.pairs[a, b] = found
        return found

    def step(self, state: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        tail, known, root = state.tail + bytes((byte,)), self.known.get, state.root
        size, ended, live = len(tail) - 1, None, []
        for n, path in state.live:
            if (found := known(tail[size - n :])) is None:
                continue
            i, longer = found
            if ended is None and i >= 0:
                before = path[-1] if path else root
                if before < 0 or self.follows(before, i):
                    ended = (*path, i)
            if longer:
                live.append((n + 1, path))
        if ended is None:
            raise ValueError("the vocabulary lacks a single byte")
        agreed = len(ended)
        for _, path in live:
            k = 0
            while k < agreed and k < len(path) and path[k] == ended[k]:
                k += 1
            agreed = k
        if agreed:
            live = [(n, path[agreed:]) for n, path in live]
            root = ended[agreed - 1]
        live.append((0, ended[agreed:]))
        tail = tail[size + 1 - live[0][0] :]
        key = (root, tail, tuple(live))
        if (to := self.states.get(key)) is None:
            if len(self.states) >= MAX_STATES:
                self.forget()
            to = self.states[key] = _State(*key)
        state.arcs[byte] = made = ended[:agreed], to
        return made

    def forget(self) -> None:
        for s in self.states.values():
            s.arcs = {}
        self.start.arcs = {}
        self.states.clear()

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for byte in data:
            emitted, state = state.arcs.get(byte) or self.step(state, byte)
            if emitted:
                out += emitted
        out += state.rest
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes in any pieces, whole characters out.

    The machine follows lead and continuation bytes from the last lead byte of a piece and holds
    back an unfinished character; malformed bytes become U+FFFD.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if need > back and b <= 0xF4 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.unfinished(data)
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def splitter(pattern: str):
    """findall of the pattern with Unicode's own white space.

    Texts of letters below U+0250 take an equivalent in the standard library's faster engine, if
    the pattern names its character classes by property and has no others.
    """
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    wide = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
    slow = regex.compile(wide).findall
    few, number = rf"\t-\r \x85\xa0", "²³¹¼½¾"
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\w{few}]|_)").replace(r"\p{L}", rf"[^\W\d_{number}]").replace(r"\p{N}", rf"[\d{number}]").replace(r"\s", f"[{few}]").replace(r"\S", f"[^{few}]")
    if re.search(r"\\[pP]|\(\?[a-zA-Z]", narrow):
        return slow
    fast, other = re.compile(narrow).findall, re.compile("[^\0-\u024f]").search
    return lambda text: slow(text) if other(text) else fast(text)


class Codec:
    """Text to ids and back; every pre-token that the pattern matches is encoded separately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fst = Transducer(ranks)
        self.split = splitter(pattern)
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.vocabulary[i] = b
        self.words: dict[str, bytes] = _Words(self.fst)

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_stream(self, ids, piece: int = 1 << 14):
        """Yield the text of ids, piece by piece."""
        stream, vocabulary = Utf8Stream(), self.vocabulary
        for i in range(0, len(ids), piece):
            yield stream.feed(b"".join([vocabulary[x] for x in ids[i : i + piece]]))
        yield stream.close()

    def decode(self, ids) -> str:
        return "".join(self.decode_stream(ids))


class _Words(dict):
    """Packed ids by pre-token, filled when first asked for."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.encode = fst.encode

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.encode(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            self[word] = packed
        return packed


@lru_cache(1)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The worker's codec; by default of the public byte-level vocabulary."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Ids of every whole text: (id, n_tokens, [ids], ids_sha256, decoded_sha256).

    Null ids and texts are kept (null text: empty); repeated rows give repeated rows; an empty
    table gives an empty one; other columns are not looked at.
    """

    def run(keys: list, texts: list) -> dict:
        c = codec(path, pattern)
        out = {"doc_id": keys, "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        gc.disable()  # the states are many small objects, which collections would visit again and again
        try:
            for text in texts:
                packed = c.encode_packed(text or "")
                ids = np.frombuffer(packed, "<u4")
                digest = hashlib.sha256()
                for piece in c.decode_stream(ids.tolist()):
                    digest.update(piece.encode())
                out["n_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(ids.astype(np.int32))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(digest.hexdigest())
        finally:
            gc.enable()
        return out

    schema = "doc_id bigint, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return text_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, ["doc_id", "text"], schema)

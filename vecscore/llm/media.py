"""Media columns: payloads as 8-bit greyscale PNG in binary columns, and perceptual hashes.

Writer and reader are numpy and zlib alone. The writer chooses each row's filter by the least sum
of absolute differences. The reader verifies the signature, every chunk's checksum, the image's
size and zlib's own checksum, and undoes all five row filters: many rows at a time, Average and Paeth, in which a sample depends on the one before it, by columns over the rows
of a whole batch of images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from vecscore.llm.common import text_map

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
#: Rows from one that needs no other row to the next.
STRETCH = 32


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def apply_filter(rows: np.ndarray, kind: int) -> np.ndarray:
    """The bytes that row filter `kind` stores for rows of samples."""
    if kind == NONE:
        return rows
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    if kind == SUB:
        return rows - left
    if kind == UP:
        return rows - up
    if kind == AVERAGE:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    return rows - _paeth(left, up, corner)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def best_filters(samples: np.ndarray) -> np.ndarray:
    """Lines with a filter type before each row: the one whose stored bytes, as signed numbers, have the least absolute sum (ties: the lowest).

    Every STRETCH-th row has a filter that needs no other row, so that readers can work on many
    parts of a long image at once.
    """
    stored = np.stack([apply_filter(samples, kind) for kind in range(5)])
    cost = np.abs(stored.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    cost[UP:, ::STRETCH] = np.iinfo(np.int64).max
    kinds = cost.argmin(0)
    return np.hstack([kinds[:, None].astype(np.uint8), stored[kinds, np.arange(len(samples))]])


def encode_png(samples: np.ndarray, row_filter: int | None = None, level: int = 2) -> bytes:
    """An 8-bit greyscale PNG of a two-dimensional array of bytes; every row by its best filter, or all by the given one."""
    height, width = samples.shape
    if row_filter is None:
        lines = best_filters(samples)
    else:
        lines = np.hstack([np.full((height, 1), row_filter, np.uint8), apply_filter(samples, row_filter)])
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    """Kinds and data of all chunks; raises ValueError if a checksum or length is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    out, at = [], 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(data) < n or len(png) < at + 12 + n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        out.append((kind, data))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1] != (b"IEND", b""):
        raise ValueError("a chunk is missing")
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of the filtered lines of one image (filter type first in each)."""
    return unfilter_all([lines])[0]


def unfilter_all(images: list[np.ndarray]) -> list[np.ndarray]:
    """Samples of several images of equal width, given as filtered lines.

    A row of filter None or Sub needs no other row, so it begins a stretch, as does an image's first
    row. The n-th rows of all stretches go together: Up adds the rows above; Average and Paeth, in
    which a sample depends on the one before it, go by columns over all rows of their kind.
    """
    if not images:
        return []
    bounds = np.r_[0, np.cumsum([len(x) for x in images])]
    kinds = np.concatenate([x[:, 0] for x in images])
    rows = np.concatenate([x[:, 1:] for x in images])
    if kinds.max(initial=0) > PAETH:
        raise ValueError(f"unknown row filter {kinds.max()}")
    sub = np.flatnonzero(kinds == SUB)
    rows[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    top = np.zeros(len(kinds), bool)
    top[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(top | (kinds <= SUB))
    lengths = np.diff(np.r_[starts, len(kinds)])
    starts, lengths = starts[order := np.argsort(-lengths, kind="stable")], -lengths[order]
    for n in range(-int(lengths[0]) if len(lengths) else 0):
        at = starts[: np.searchsorted(lengths, -n)] + n
        own = kinds[at]
        up = at[(own == UP) & ~top[at]]
        rows[up] += rows[up - 1]
        for kind in (AVERAGE, PAETH):
            some = at[own == kind]
            if len(some):
                above = np.where(top[some, None], 0, rows[some - 1]).astype(np.uint8)
                rows[some] = _undo_rows(rows[some], above, kind)
    return [rows[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _undo_rows(stored: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Samples of rows of one filter, each with the row above it: column by column, for all rows at once."""
    values, ups = stored.T.astype(np.int16), above.T.astype(np.int16)
    out = np.empty_like(values)
    left = corner = np.zeros(values.shape[1], np.int16)
    for x in range(len(values)):
        b = ups[x]
        if kind == AVERAGE:
            guess = (left + b) >> 1
        else:
            pa, pb, pc = np.abs(b - corner), np.abs(left - corner), np.abs(left + b - 2 * corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, corner))
        left, corner = (values[x] + guess) & 255, b
        out[x] = left
    return out.T.astype(np.uint8)


def filtered_lines(png: bytes) -> np.ndarray:
    """The filtered lines of an 8-bit greyscale PNG; raises ValueError if anything is damaged."""
    parts = chunks(png)
    width, height, *form = struct.unpack(">IIBBBBB", parts[0][1])
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("only 8-bit greyscale without interlacing is read")
    try:
        raw = zlib.decompress(b"".join(data for kind, data in parts if kind == b"IDAT"))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise ValueError("the image has another size")
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)


def decode_png(png: bytes) -> np.ndarray:
    """The samples of a PNG; raises ValueError if anything is damaged."""
    return unfilter(filtered_lines(png))


def decode_pngs(pngs: list[bytes]) -> list[np.ndarray]:
    """decode_png() of many images, those of one width together."""
    lines = [filtered_lines(x) for x in pngs]
    out: list = [None] * len(lines)
    for width in {x.shape[1] for x in lines}:
        same = [i for i, x in enumerate(lines) if x.shape[1] == width]
        for i, samples in zip(same, unfilter_all([lines[i] for i in same]), strict=True):
            out[i] = samples
    return out


@lru_cache(1)
def _cosines(n: int = 32, keep: int = 8) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)).astype(np.float64)


def _shrink(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means over n even parts of an axis, with fractions of samples; short axes repeat samples."""
    size = image.shape[axis]
    total = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis=axis)], axis=axis)
    edge = np.arange(n + 1) * size / n
    low = np.minimum(edge.astype(np.int64), size - 1)
    part = (edge - low).reshape([-1 if i == axis else 1 for i in range(image.ndim)])
    at = np.take(total, low, axis) + part * np.take(image, low, axis)
    return np.diff(at, axis=axis) * (n / size)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 thumbnail exceed their median."""
    small = _shrink(_shrink(image.astype(np.float64), 32, 0), 32, 1)
    c = _cosines()
    low = np.round(c @ small @ c.T, 6).ravel()
    low[0] = 0.0  # mere brightness
    return np.packbits(low > np.median(low)).tobytes()


def to_samples(text: str | None) -> tuple[np.ndarray, int]:
    """UTF-8 bytes with zeros up to a positive multiple of 64, as rows of 64 samples; and the bytes before that."""
    data = (text or "").encode()
    rows = max(1, -(-len(data) // WIDTH))
    return np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH), len(data)


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """A PNG of every whole text, and what reading it back gives.

    Null text counts as empty (64 zero bytes); null ids and repeated rows are kept; an empty table
    gives an empty one. Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (hex), feature_bits (binary) and, if asked for, media (binary).
    """

    def run(keys: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "feature_bits", "media")}
        made = [to_samples(text) for text in texts]
        stored = [encode_png(samples) for samples, _ in made]
        for (_, n), media, image in zip(made, stored, decode_pngs(stored), strict=True):
            payload, bits = image.tobytes(), cosine_hash(image)
            for k, v in (("n_bytes", n), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", bits.hex()), ("feature_bits", bits)):
                out[k].append(v)
            if with_media:
                out["media"].append(media)
        return out | {"doc_id": keys}

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, feature_bits binary"
    return text_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, ["doc_id", "text"], schema + ", media binary" * with_media)

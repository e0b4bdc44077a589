"""Language of texts, and of spans in mixed ones.

Per-word scores are log-odds of hashed letter trigrams (word edges included), learned from a
bounded sample. The script of a word, from ranges of code points, narrows the languages it may
have. A Viterbi path over a text's words, with a penalty for each switch, labels spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import bounded_sample, crc_mod, keep_rows, release, text_map
from vecscore.llm.words import Words, by_text
from vecscore.sources.store import settle

# The first code point of each script's ranges.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([x for x, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])

BUCKETS = 1 << 16


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log-odds by trigram bucket and language
    allowed: np.ndarray  # by script and language
    switch: float = 10.0


def trigrams(w: Words) -> np.ndarray:
    """Buckets of the trigram around each letter; what is no letter counts as an edge."""
    c = np.where(w.mask, w.cp, 0)
    with np.errstate(over="ignore"):
        h = c * np.uint32(0x85EBCA6B)
        h[1:] += c[:-1] * np.uint32(0xC2B2AE35)
        h[:-1] += c[1:] * np.uint32(0x27D4EB2F)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16))[w.mask].astype(np.int64)


def scripts(w: Words) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FROM, w.cp[w.start], side="right") - 1]


def train(texts: list[str], langs: list[str], switch: float = 10.0, rare: float = 1e-6) -> Model | None:
    """A model from labelled texts; None if there are none.

    A language may be written in a script if at least 1 in 200 of its training words are.
    """
    names = sorted(set(langs))
    if not names:
        return None
    counts, seen = np.zeros((len(names), BUCKETS)), np.zeros((len(names), len(NAMES)))
    by_lang: dict[str, list[str]] = {}
    for text, lang in zip(texts, langs, strict=True):
        by_lang.setdefault(lang, []).append(text or "")
    for k, name in enumerate(names):
        group = by_lang[name]
        for at in range(0, len(group), 50):
            w = Words(group[at : at + 50])
            counts[k] += np.bincount(trigrams(w), minlength=BUCKETS)
            seen[k] += np.bincount(scripts(w), minlength=len(NAMES))
    odds = np.log(counts / np.maximum(counts.sum(1, keepdims=True), 1) + rare)
    return Model(names, (odds - odds.mean(0)).T.astype(np.float32).copy(), (seen > 0.005 * seen.sum(1, keepdims=True)).T, switch)


def fit(docs: DataFrame, rows: int = 6000, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on at most `rows` labelled rows (and SAMPLE_BYTES of text), chosen by key hash among those `learn` admits."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sample = bounded_sample(labelled.filter(learn) if learn is not None else labelled, id_col, rows, [text_col, lang_col], text_col).collect()
    model = train([r[0] for r in sample], [r[1] for r in sample])
    del sample
    release()
    settle(docs.sparkSession)
    return model


def word_scores(w: Words, m: Model) -> np.ndarray:
    """Each word's score by language; languages of other scripts are out of the question."""
    size = w.stop - w.start
    gathered = m.table[trigrams(w)]
    s = np.add.reduceat(gathered, np.r_[0, np.cumsum(size)[:-1]], axis=0) if len(w) else np.zeros((0, len(m.langs)), np.float32)
    s = np.clip(s.astype(np.float64), -12, 12)
    may = m.allowed[scripts(w)] if len(w) else np.zeros(s.shape, bool)
    unknown = ~may.any(1)
    s[~may & ~unknown[:, None]] = -24.0
    s[unknown] = 0.0
    return s


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The labels of highest total score less `switch` for each change; ties stay, then go to the lowest."""
    best, back = s[0].tolist(), []
    for row in s[1:].tolist():
        top = max(best)
        at, low = best.index(top), top - switch
        back.append([i if v >= low else at for i, v in enumerate(best)])
        best = [(v if v >= low else low) + x for v, x in zip(best, row, strict=True)]
    k = best.index(max(best))
    out = [k]
    for row in reversed(back):
        k = row[k]
        out.append(k)
    return np.array(out[::-1])


def label(w: Words, s: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of all words.

    If no stretch of a text favours another language over its best one by more than half the
    penalty, no switch can pay and the whole text has that language; only other texts need the
    path search. The test looks at largest gains over prefix sums, for all texts at once.
    """
    total = by_text(s, w.first, np.add)
    best = total.argmax(1)
    out = best[w.doc]
    if not len(w):
        return out
    base = s[np.arange(len(w)), out]
    apart = 1e6 * (1 + w.doc)
    mixed = np.zeros(len(best), bool)
    for k in range(s.shape[1]):
        d = s[:, k] - base
        after = np.cumsum(d)
        before = after - d
        lowest = np.minimum.accumulate(before - apart) + apart
        mixed |= by_text(after - lowest, w.first, np.maximum) > switch / 2
    for i in np.flatnonzero(mixed):
        lo, hi = w.first[i], w.first[i + 1]
        out[lo:hi] = viterbi(s[lo:hi], switch)
    return out


def identify(texts: list[str | None], m: Model, with_spans: bool = False) -> dict:
    """lang, score and spans of each text.

    lang is the language of most letters (ties: the first by name) or `und` for a text without a
    letter; marks that combine with letters are none themselves. score is that language's share of letters times its probability against the others on
    the words it has; 0 for `und`.
    """
    w = Words(texts)
    s = word_scores(w, m)
    labels = label(w, s, m.switch)
    size = (w.stop - w.start).astype(np.float64)
    n, width = len(texts), len(m.langs)
    letters = np.bincount(w.doc * width + labels, size, n * width).reshape(n, width) if len(w) else np.zeros((n, width))
    top = letters.argmax(1)
    total = w.letters
    share = letters[np.arange(n), top] / np.maximum(letters.sum(1), 1)
    own = by_text(np.where((labels == top[w.doc])[:, None], s, 0.0), w.first, np.add)
    odds = np.exp(np.clip((own - own[np.arange(n), top][:, None]) / 2, -60, 60))
    score = share / odds.sum(1)
    out = {"lang_pred": [m.langs[k] if t else "und" for k, t in zip(top, total, strict=True)], "score": [float(x) if t else 0.0 for x, t in zip(score, total, strict=True)]}
    if with_spans:
        out["spans"] = []
        for i in range(n):
            lo, hi = w.first[i], w.first[i + 1]
            cuts = np.r_[lo, lo + 1 + np.flatnonzero(np.diff(labels[lo:hi])), hi] if hi > lo else [lo]
            out["spans"].append([{"start": int(w.start[a] - w.bounds[i]), "stop": int(w.stop[b - 1] - w.bounds[i]), "lang": m.langs[labels[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return out


def identify_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every whole text.

    Null and letterless texts are `und` with score 0, as is everything if no labelled row was
    there to learn from. Null ids and repeated rows are kept, further columns not looked at; spans
    are offsets of code points in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys: list, texts: list) -> dict:
        m = shared.value
        if m is None:
            return {"doc_id": keys, "lang_pred": ["und"] * len(keys), "score": [0.0] * len(keys), "spans": [[] for _ in keys]}
        return {"doc_id": keys} | identify(texts, m, with_spans)

    schema = "doc_id bigint, lang_pred string, score double" + ", spans array<struct<start: bigint, stop: bigint, lang: string>>" * with_spans
    return text_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, ["doc_id", "text"], schema, chars=1_000_000)


def held_out_query(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32(doc_id) mod 5 is not 0; predict all."""
    model = fit(docs, learn=crc_mod("doc_id", 5) != 0)
    found = identify_documents(docs, model)
    return found.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


#: A document is rejected if no language has this share of its letters with any confidence.
LEAST_SCORE = 0.2


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language: not `und`, and a score of at least `least`. Without a model all rows."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list) -> list:
        found = identify(texts, shared.value)
        return [lang != "und" and score >= least for lang, score in zip(found["lang_pred"], found["score"], strict=True)]

    return keep_rows(docs, text_col, keep)

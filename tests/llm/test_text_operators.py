import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecscore.llm import bpe, html, langid, lines, media, packing, toxicity

DOC = "doc_id bigint, text string"
LONG = "the cat sat on the mat again. " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "The quick brown fox, it's 12 o'clock."), (1, "The quick brown fox, it's 12 o'clock."), (2, None), (3, ""), (None, "no id"), (4, LONG), (5, "  \n\t "), (6, "é漢字🙂 Привет ß́"), (None, None)]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "'x' AS score", "'y' AS n", "'z' AS c", "'w' AS host", "1 AS __salt", "'q' AS n_tokens", "'s' AS source", "'l' AS lines")


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst THE'.,0²_ \n\té漢🙂\x1c "), st.characters(codec="utf-8")), max_size=60))
def test_bpe_equals_tiktoken(reference, text):
    c = bpe.codec()
    assert c.encode(text) == reference.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text


def test_bpe_forgets_states_and_stays_right(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    c = bpe.Codec(bpe.codec.__wrapped__().fst and __import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["the", "ing", " of", "a", "q", "zz", "ß", "  "]) for _ in range(r.randint(1, 30)))
        assert c.encode(text) == reference.encode_ordinary(text)


def test_utf8_stream_in_any_pieces():
    data = "aé漢🙂z".encode() * 5
    r = random.Random(1)
    for _ in range(50):
        s, out, at = bpe.Utf8Stream(), "", 0
        while at < len(data):
            n = r.randint(1, 5)
            out += s.feed(data[at : at + n])
            at += n
        assert out + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"\xf0\x9f") + s.close() == "�"


def test_bpe_documents(odd, reference, spark):
    got = bpe.encode_documents(odd).collect()
    assert len(got) == 9
    want = {(r["doc_id"], r["text"]): reference.encode_ordinary(r["text"] or "") for r in odd.collect()}
    packed = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    text = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    key = lambda *x: tuple("-" if y is None else str(y) for y in x)
    assert sorted(key(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted([key(i, len(v), packed(v), text(t)) for (i, t), v in want.items()] + [key(1, len(want[1, "The quick brown fox, it's 12 o'clock."]), packed(want[1, "The quick brown fox, it's 12 o'clock."]), text("The quick brown fox, it's 12 o'clock."))])
    assert bpe.encode_documents(odd.limit(0)).count() == 0


# --- media


@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip_of_every_filter(kind):
    x = np.random.default_rng(kind).integers(0, 256, (9, 64), dtype=np.uint8)
    assert (media.decode_png(media.encode_png(x, kind)) == x).all()


def naive_unfilter(lines):
    """Sample by sample, as the format describes it."""
    height, width = len(lines), lines.shape[1] - 1
    out = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            a, b = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0)
            c = out[y - 1, x - 1] if x and y else 0
            p = int(a) + int(b) - int(c)
            paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
            out[y, x] = (int(lines[y, x + 1]) + (0, a, b, (a + b) // 2, paeth)[lines[y, 0]]) % 256
    return out


def test_unfiltering_of_mixed_rows_equals_the_definition():
    r = np.random.default_rng(8)
    lines = [np.hstack([r.integers(0, 5, (n, 1)), r.integers(0, 256, (n, 64))]).astype(np.uint8) for n in (1, 7, 40, 3, 0)]
    for got, x in zip(media.unfilter_all(lines), lines, strict=True):
        assert (got == naive_unfilter(x)).all()
    with pytest.raises(ValueError):
        media.unfilter(np.full((1, 65), 5, np.uint8))


def test_all_filters_are_used_and_undone(spark):
    """Over the whole table, through the functions of the query."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    samples = [media.to_samples(t)[0] for t in texts]
    pngs = [media.encode_png(x) for x in samples]
    assert {k for x in pngs for k in media.filtered_lines(x)[:, 0].tolist()} == {0, 1, 2, 3, 4}
    assert all((a == b).all() for a, b in zip(media.decode_pngs(pngs), samples, strict=True))


def test_cosine_hash_equals_a_naive_transform():
    r = np.random.default_rng(9)
    for height in (1, 5, 32, 77):
        x = r.integers(0, 256, (height, 64)).astype(np.uint8)
        part = lambda size, i: [(j, min(j + 1, (i + 1) * size / 32) - max(j, i * size / 32)) for j in range(size) if min(j + 1, (i + 1) * size / 32) > max(j, i * size / 32)]
        small = [[sum(float(x[j, k]) * u * v for j, u in part(height, a) for k, v in part(64, b)) * 32 * 32 / height / 64 for b in range(32)] for a in range(32)]
        cos = [[np.cos(np.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
        low = [round(sum(cos[p][a] * cos[q][b] * small[a][b] for a in range(32) for b in range(32)), 6) if p or q else 0.0 for p in range(8) for q in range(8)]
        middle = sorted(low)
        middle = (middle[31] + middle[32]) / 2
        assert np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8)).tolist() == [int(v > middle) for v in low]


def test_png_damage_is_noticed():
    png = media.encode_png(np.zeros((2, 64), np.uint8))
    for at in range(len(png)):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-1])


def test_similar_images_have_similar_hashes():
    r = np.random.default_rng(0)
    x = np.cumsum(np.cumsum(r.normal(size=(128, 64)), 0), 1)
    x = ((x - x.min()) / (x.max() - x.min()) * 255).astype(np.uint8)
    y = np.clip(x.astype(int) + r.integers(-3, 4, x.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")
    assert apart(media.cosine_hash(x), media.cosine_hash(y)) <= 6 < apart(media.cosine_hash(x), media.cosine_hash(x[::-1, ::-1]))


def test_media_documents(odd):
    rows = media.store_documents(odd).collect()
    assert len(rows) == 9
    texts = [(r["text"] or "").encode() for r in odd.collect()]
    want = sorted((len(t), hashlib.sha256(t.ljust(max(1, -(-len(t) // 64)) * 64, b"\0")).hexdigest(), zlib.crc32(t.ljust(max(1, -(-len(t) // 64)) * 64, b"\0")[-64:])) for t in texts)
    assert sorted((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] and r["feature"] == r["feature_bits"].hex() for r in rows)


# --- language


WORDS = {"en": "the of and to in that was with house water", "de": "der die und nicht mit ein haus wasser über straße", "fr": "le la les et dans une pour maison eau être", "ru": "и в не на что дом вода человек это как"}


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    texts = [(lang, " ".join(r.choice(w.split()) for _ in range(40))) for lang, w in WORDS.items() for _ in range(40)]
    return langid.train([t for _, t in texts], [lang for lang, _ in texts])


def test_spans_of_mixed_text(model):
    text = "the water of that house was in the house und nicht mit der straße über die straße это дом и вода"
    found = langid.identify([text], model, with_spans=True)
    assert [s["lang"] for s in found["spans"][0]] == ["en", "de", "ru"]
    assert text[found["spans"][0][2]["start"] :] == "это дом и вода"


def test_scripts_narrow_languages(model):
    assert langid.identify(["abc это", "дом это zz", "123", None, "", "漢字"], model)["lang_pred"][1:5] == ["ru", "und", "und", "und"]
    assert langid.identify(["漢字"], model)["lang_pred"][0] in WORDS


def test_whole_text_shortcut_equals_viterbi():
    r = np.random.default_rng(0)
    for _ in range(200):
        s = r.normal(size=(r.integers(1, 40), 3)) * 3

        class Fake:
            first, doc = np.array([0, len(s)]), np.zeros(len(s), int)

            def __len__(self):
                return len(self.doc)

        value = lambda p: s[np.arange(len(s)), p].sum() - 4 * (np.diff(p) != 0).sum()  # noqa: E731,B023
        assert value(langid.label(Fake(), s, 4.0)) == pytest.approx(value(langid.viterbi(s, 4.0)))


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(3)
    for _ in range(60):
        s, switch = r.integers(-6, 7, (r.integers(1, 7), 3)).astype(float), float(r.integers(0, 9))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        assert value(langid.viterbi(s, switch).tolist()) == max(value(p) for p in itertools.product(range(3), repeat=len(s)))


def test_marks_alone_are_no_letters(model):
    got = langid.identify(["\u0301\u0308", "1 \u0301", "e\u0301te\u0301 maison", "İİİ дом это вода человек"], model, with_spans=True)
    assert got["lang_pred"][:2] == ["und", "und"] and got["score"][:2] == [0.0, 0.0] and got["lang_pred"][2] == "fr"
    assert got["spans"][3][-1]["stop"] == len("İİİ дом это вода человек")


def test_language_documents(odd, model, spark):
    got = {r["doc_id"]: r for r in langid.identify_documents(odd, model).collect()}
    assert got[4]["lang_pred"] == "en" and got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[2]["score"] == 0
    assert langid.identify_documents(odd, None).count() == 9
    assert langid.identify_documents(odd.limit(0), model).count() == 0
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4}
    assert kept.filter("doc_id in (2, 3, 5)").count() == 0


def test_held_out_accuracy(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(20)), lang) for i, lang in enumerate(r.choice(list(WORDS)) for _ in range(400))]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "the house", None)], "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x for x in langid.held_out_query(df).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 395
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)


# --- toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(WORDS["en"].split()) for _ in range(30)]
        bad = r.random() < 0.25
        if bad:
            w[r.randrange(30)] = r.choice(["vileone", "viletwo", "vilethree", "gruk"])
        out.append((i, " ".join(w), "en", int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows(900, 3)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(5000, None, None), (5001, "", "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.held_out_query(docs, labels).collect()}
    assert len(got) == 902
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 200 and sum(got[r[0]]["predicted"] == r[3] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"]


def test_scores_equal_a_naive_convolution():
    rows = toxic_rows(300, 6)
    m = toxicity.train([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], steps=200)
    key = {int(k): i for i, k in enumerate(m.keys) if i}
    for text in [rows[0][1], rows[1][1], "gruk", "the gruk", "", "the  12 of\nviletwo unseenword", None]:
        words = re.findall(r"[^\W\d_]+", text or "")
        taps = []
        for word in words:
            w = toxicity.Words([word])
            known = [key.get(int(h[0]), 0) for h in w.hashes(*toxicity.PARTS)]
            taps.append([sum(float(m.taps[i][c]) for i in known) for c in range(m.taps.shape[1])])
        z = float(m.out[-1])
        for k, width in enumerate(toxicity.WIDTHS):
            for q in range(toxicity.FILTERS):
                best = 0.0
                for i in range(len(words)):
                    best = max(best, float(m.bias[k * toxicity.FILTERS + q]) + sum(taps[i + j][toxicity.taps_of(width).start + j * toxicity.FILTERS + q] for j in range(width) if i + j < len(words)))
                z += best * float(m.out[k * toxicity.FILTERS + q])
        assert toxicity.logits([text], m)[0][0] == pytest.approx(z, abs=1e-3)


def test_responses_in_both_layouts_agree():
    r = np.random.default_rng(5)
    for sizes in ([4, 1, 0, 2, 7], [1], [0], [2, 1, 1]):
        first = np.r_[0, np.cumsum(sizes)]
        x, f = r.normal(size=(first[-1], 16)).astype(np.float32), r.normal(size=(16, 48)).astype(np.float32)
        bias = r.normal(size=24).astype(np.float32)
        a = toxicity.responses(x @ f, np.repeat(np.arange(len(sizes)), sizes), bias)
        assert np.allclose(a.T, toxicity.responses_by_filter(x, f, first, bias), atol=1e-4)


def test_toxicity_of_odd_rows_with_a_model(spark, odd):
    rows = toxic_rows(300, 6)
    m = toxicity.train([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], steps=200)
    got = toxicity.score_documents(odd, m).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[1]) == 1 and by[2] == by[3] == by[5]
    assert toxicity.score_documents(odd.limit(0), m).count() == 0 and toxicity.keep_clean(odd, m).columns == odd.columns


def test_documents_that_repeat_an_id_are_fitted_once(spark):
    rows = toxic_rows(120, 2)
    docs = spark.createDataFrame([r[:3] for r in rows] * 3 + [(r[0], None, None) for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] * 2, "doc_id bigint, toxic int")
    a = toxicity.fit(docs, labels, rows=100)
    b = toxicity.fit(docs.dropDuplicates().repartition(5), labels, rows=100)
    assert (a.taps == b.taps).all() and (a.cuts == b.cuts).all()


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(odd.withColumn("lang", odd["text"]), labels) is None
    assert {r["score"] for r in toxicity.score_documents(odd, None).collect()} == {0.0}
    assert toxicity.keep_clean(odd, None).count() == 9


# --- line dedup


def test_line_dedup(spark):
    rows = [(i, f"Menu\nown {i}\n  Footer \nmore {i}\n", "a") for i in range(20)] + [(100, "Menu\nonly here", "b"), (101, None, "b"), (102, "", "b"), (103, "Menu", "a"), (104, "x\nx\nx\nx\nx", "c")] + [(200 + i, "N\nv", None) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'k' AS n_lines", "1 AS __host", "2 AS `lines`")
    got = {r["doc_id"]: r for r in lines.dedup_lines(df.drop("__host")).collect()}
    assert got[3]["text"] == "own 3\nmore 3\n" and got[3]["n_lines"] == 5 and got[3]["n_dropped"] == 2
    assert got[100]["text"] == "Menu\nonly here" and got[101]["text"] is None and got[102]["text"] == ""
    assert got[103]["text"] == "" and got[104]["text"] == "x\nx\nx\nx\nx"
    assert got[200]["text"] == "" and got[200]["lines"] == 2
    assert lines.dedup_lines(df.drop("__host").limit(0)).count() == 0


def test_line_dedup_both_joins_agree(spark, monkeypatch):
    from vecscore.llm import common

    rows = [(i, f"Menu\nown {i}\nFooter", f"h{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    a = sorted(map(str, lines.dedup_lines(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(str, lines.dedup_lines(df).collect())) == a


def path_of(page, tag, nth=0):
    return [path for _, t, path, _ in html.Page(page).containers if t == tag][nth]


def alone(page):
    return html.main_text(page, [])


STORY = " ".join(f"This is sentence {i} of the article, long enough to count." for i in range(20))


def test_html_path_that_holds_nothing():
    path = path_of("<body><div class=main><p>x</p></div></body>", "div")
    page = "<body><div class=main>{}</div><div class=story><p>{}</p></div></body>"
    assert html.main_text(page.format("", STORY), [path]) == STORY
    assert html.main_text(page.format("<a href='/x'>more stories</a>", STORY), [path]) == STORY
    assert html.main_text(page.format("<p>The host's path.</p>", STORY), [path]) == "The host's path."
    # Another path that the host's pages vote for takes over where the winner holds little.
    other = path_of(page, "div", 1)
    assert html.main_text(page.format("<p>A teaser.</p>", STORY), [path, other]) == STORY
    assert html.main_text(page.format(f"<p>{STORY}</p>", "A second."), [path, other]) == STORY


@pytest.mark.parametrize("page", [
    "<div><p>before</p><svg/><p>{}</p></div>", "<div><p>before</p><svg><path d='1'/><p>{}</p></div>", "<div><p>before</p><svg><text>no</text></svg><p>{}</p></div>",
    "<body><div class='overflow-hidden'><article><p>before<p>{}</article></div><p>x</body>", "<body><div class='content has-sidebar'><article><p>before</p><p>{}</p></article></div></body>",
    "<body><div class='sidebar-layout'><article><p>before</p><p>{}</p></article><div class=sidebar>side</div></div></body>", "<body><form id=page><div class=menu>Home</div><div><p>before<p>{}</div></form></body>",
    "<div><p title='a > b' class=\"x>y\">before</p><p title=it's>{}</p></div>", "<div><p>before<!-- <p>no --></p><? no ?><p>{}<script>if (a<b) c = '</p>';</script></div>", "<div><p>before <span class=ad>buy</span></p><p>{}</div>",
])
def test_articles_are_not_lost(page):
    assert alone(page.replace("{}", STORY)) == f"before\n{STORY}"


def test_what_lies_around_is_dropped():
    around = "<header>h</header><nav>n</nav><div class='cookie-notice'>c</div><div id=sidebar-left>s</div><div class='page-header'>h</div><div role=complementary>r</div><form>f</form><div class='ad ad-top'>a</div><div style='display: none'>d</div>"
    after = f"<section class=comments><article class=comment><p>{STORY}</p></article></section><aside>a</aside><footer>f</footer>"
    page = f"<body>{around}<article><header><h1>Title</h1></header><p>One <script>x</script>two<button>b</button>.</p><p>{STORY}</p></article>{after}</body>"
    assert alone(page) == f"Title\nOne two.\n{STORY}"
    assert alone(f"<body>{around}<div class=post><p>{STORY}</p></div>{after}</body>") == STORY


@pytest.mark.parametrize("page", [
    "<a " + '"' * 50_000, "<a " * 50_000, "<a =\"" * 30_000 + ">", "<a =\"> '" * 20_000, "<div>" * 50_000 + "deep", "<div>" * 50_000 + "</b>" * 50_000, "<b><table><div>" + "<i>" * 20_000 + "</b>" * 50_000, "<p>" * 50_000, "<!--" * 50_000,
    "<li>" * 50_000, "<script>" * 50_000, "<svg>" * 3_000, "<div class=ad>" * 20_000, "&amp" * 50_000, "</" * 50_000, "<" * 200_000, "<td>" * 30_000, "<p a=" + "x " * 100_000 + ">", "word " * 500_000,
], ids=range(19))
def test_scanner_is_linear(page):
    before = time.process_time()
    html.main_text(f"{page}<p>after</p>", [1, 2])
    assert time.process_time() - before < 3


def test_deep_pages_vote_with_few_short_paths(spark):
    df = spark.createDataFrame([(1, "http://h/", "<div class=a>" * 8000 + STORY), (2, "http://h/", None)], "page_id int, url string, html string")
    assert html.host_votes(df.selectExpr("*", "'h' AS host")).count() < 100
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == {1: STORY, 2: ""}


def naive_extract(pages):
    """Consensus paths once more, by trees and paths in full: for whole pages of div, article, section and p alone."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.top = {"tag": "", "path": (), "kids": [], "own": 0}
            self.stack, self.blocks = [self.top], []
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            if tag != "p":
                node = {"tag": tag, "path": (*self.stack[-1]["path"], tag + "".join("." + x for x in sorted(dict(attrs).get("class", "").split()))), "kids": [], "own": 0}
                self.stack[-1]["kids"].append(node)
                self.stack.append(node)

        def handle_endtag(self, tag):
            if tag != "p":
                self.stack.pop()

        def handle_data(self, data):
            self.stack[-1]["own"] += len(data)
            self.blocks.append((data, self.stack[-1]["path"]))

    def weigh(node, out):
        total = node["own"] + sum((0.5 if k["tag"] == "article" else 0.9) * weigh(k, out) for k in node["kids"])
        if node["path"] and total:
            out[node["path"]] = max(out.get(node["path"], 0), total * (1.5 if node["tag"] == "article" else 1))
        return total

    votes, wins, trees = collections.defaultdict(float), collections.Counter(), []
    for host, page in pages:
        tree, out = Tree(page), {}
        weigh(tree.top, out)
        for path, x in out.items():
            votes[host, path] += (x / max(out.values())) ** 4
            wins[host, path] += x == max(out.values())
        trees.append((host, tree))
    texts = []
    for host, tree in trees:
        ranked = sorted((path for h, path in votes if h == host), key=lambda path: -votes[host, path])
        most = max(wins[host, path] for path in ranked[:8])
        kept = [path for i, path in enumerate(ranked[:8]) if i == 0 or wins[host, path] >= 0.3 * most]
        held = [[t for t, p in tree.blocks if p[: len(path)] == path] for path in kept]
        held = [h for h in held if h]
        if held and sum(map(len, held[0])) < 0.25 * max(sum(map(len, h)) for h in held):
            held.sort(key=lambda h: -sum(map(len, h)))
        if not held:
            out = {}
            weigh(tree.top, out)
            best = max(out, key=out.get)
            held = [[t for t, p in tree.blocks if p[: len(best)] == best]]
        texts.append("\n".join(held[0]))
    return texts


def test_votes_equal_a_naive_count(spark):
    r = random.Random(12)
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(n))
    rows = []
    for i in range(60):
        h, kind = r.randint(0, 2), r.random()
        story = "".join(f"<p>{words(r.randint(5, 40))}</p>" for _ in range(r.randint(1, 6)))
        body = f"<article>{story}</article>" if kind < 0.3 else f"<div class='b a'><section>{story}</section></div>" if kind < 0.7 else f"<div class=c>{words(3)}<div>{story}</div></div>"
        rows.append((i, f"http://h{h}/{i}", f"<body><div class=x><p>{words(r.randint(1, 30))}</p></div>{body}<div class=z>{words(4)}</div></body>"))
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = naive_extract([(url.split("/")[2], page) for _, url, page in rows])
    assert [got[i] for i in range(60)] == want


# --- packing


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    counts = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 64 and count > 0
        for x in pattern:
            counts[x] = counts.get(x, 0) + count
    assert counts == histogram
    for length, (first, _, _) in packing.places(patterns).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and first[-1] < histogram[length]


def one_at_a_time(histogram, size):
    """Shortest-pack-first as it is told: every piece by itself, longest first."""
    packs = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        i = max(range(len(packs)), key=lambda i: (size - sum(packs[i]), packs[i]), default=None)
        if i is not None and sum(packs[i]) + length <= size:
            packs[i] = (*packs[i], length)
        else:
            packs.append((length,))
    return collections.Counter(packs)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
def test_patterns_equal_placing_one_at_a_time(histogram):
    assert dict(packing.pack_histogram(histogram, 30)) == one_at_a_time(histogram, 30)


def test_the_pack_with_most_room_comes_first():
    assert sorted(packing.pack_histogram({6: 1, 5: 1, 3: 1}, 10)) == [((5, 3), 1), ((6,), 1)]
    assert packing.pack_histogram({3: 7}, 10) == [((3, 3, 3), 2), ((3,), 1)]
    with pytest.raises(ValueError):
        packing.pack_histogram({11: 1}, 10)


def test_long_pieces_are_not_remembered():
    known = packing._known(None)
    text = "漢" * 5000 + " " + "b" * 200 + " short"
    want = packing._tokenizer(None).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(packing.token_bytes([text])[0], "<u4").tolist() == want
    assert max(map(len, known)) <= packing.LONGEST_PIECE


def test_packing_shuffles_no_pieces(odd, monkeypatch):
    from vecscore.llm import common

    plan = packing.pack(odd)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    rows = sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(odd).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    other = packing.pack(odd.repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in other) == rows
    assert len({(r["sequence_id"], r["offset"]) for r in other}) == len(other)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aThe ing.,!'s<|>0é\n\t\x1cΣ́"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_tokens_equal_the_library(texts):
    texts = [*texts, "a<|endoftext|>b, <|endoftext|>. x<"]
    want = [e.ids + [1] for e in packing._tokenizer(None).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts)] == want


def test_packed_documents(odd, spark):
    got = packing.pack(odd).collect()
    want = {}
    for r in odd.collect():
        ids = np.frombuffer(packing.token_bytes([r["text"]])[0], "<u4")
        want.setdefault(r["doc_id"], []).append(ids)
    assert sorted(str((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])) for r in got) == sorted(str((i, at, len(x[at : at + 2048]), zlib.crc32(x[at : at + 2048].tobytes()), len(x))) for i, all_ in want.items() for x in all_ for at in range(0, len(x), 2048))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(odd.limit(0)).count() == 0


# --- HTML


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div id=wrap class='w 12'><div class=sidebar>side</div><div class='post p{0}'><h2>A &lt;b&gt; {0}</h2><p>One&nbsp;&amp; <i>two</i>\n three<br>four<p>Five {0} is a rather long paragraph of the article itself.<form>f</form><script>var a='<p>';</script><ul><li>i1<li>i2</ul><div class=comments><p>reader says</div></div></div><footer>foot</footer></body></html>"


def test_main_text(spark):
    rows = [(i, f"http://Host.example:80/{i}?q", PAGE.replace("{0}", str(i))) for i in range(6)] + [(10, "http://host.example/x", "<p>lone"), (11, None, None), (12, "nonsense", ""), (13, "http://other.example/", "plain &lt; text"), (13, "http://other.example/", "plain &lt; text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'t' AS text", "1 AS host", "2 AS votes")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[2]["text"] == "A <b> 2\nOne & two three four\nFive 2 is a rather long paragraph of the article itself.\ni1\ni2"
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[2]["host_path"].endswith("div.p#.post")
    assert got[10]["text"] == "lone" and got[11]["text"] == "" and got[12]["text"] == "" and got[13]["text"] == "plain < text"
    assert html.extract(df).count() == 11 and html.extract(df.limit(0)).count() == 0


def test_consensus_outvotes_one_page(spark):
    """A page whose advert is longer than its article still gets the host's path."""
    ad = "<html><body><div class=story><p>{}</p></div><div class=zone><p>{}</p></div></body></html>"
    rows = [(i, "http://h.example/", ad.format("story text " * 40, "buy")) for i in range(5)] + [(9, "http://h.example/9", ad.format("short story", "buy now " * 90))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short story"

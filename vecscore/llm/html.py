"""Main text of web pages by consensus paths of each host.

1. Every page is parsed once; each container (an element holding text blocks) that is not of an
   excluded kind is scored by the text it holds outside links, and named by its generalised path:
   tags and classes from the root, digits as #. Paths are known by 64-bit hashes of the step and
   the path above it, so a page of any depth gives names of constant size.
2. A page votes for its best path, and a little for close ones. Spark sums the votes by host and
   path; the path with the most wins, and a few others that many pages of the host vote for are
   kept behind it.
3. Every page is parsed again: blocks within its host's winning path are its main text. Where that
   path is absent, or holds little of what another one of the host's paths holds, the other is
   taken (a host may have several templates); a page without any falls back to its own best.

Votes are pre-aggregated before the shuffle. The paths come back by a broadcast if they measure
few bytes, else under a salt, so that a host with a third of all pages is spread over many tasks.
Parsing is linear in a page's length, however it is nested or broken off.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecscore.llm.common import join_measured, text_lists

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center dd details div figure main section table tbody td tr".split())
#: Elements that end an open paragraph, and those that end an open one of their own kind.
CLOSES_P = BLOCKS - frozenset("caption dd dt legend option optgroup summary tbody td tfoot th thead tr".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Elements that never hold an article's text. A form may be wrapped around a whole page, see FRAMES.
DROPPED = frozenset("aside button datalist dialog footer head input menu nav object select search canvas audio video map".split()) | RAW
#: Words that mark what surrounds an article: a whole class, id or role, or the first or last part of one.
COMMENTS = frozenset("comment comments commentlist disqus replies respond reader-comments".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar side aside related recommended nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager footer foot masthead topbar header cookie "
    "cookies consent gdpr notice notices alert modal popup overlay share sharing social newsletter subscribe signup login search form widget hidden legal copyright complementary contentinfo".split()
)
#: First parts of names that tell of a state or of what is absent, and so do not mark.
MODIFIERS = frozenset("has with without no not is overflow overflow-x overflow-y".split())
#: A marked element that holds so much of a page's text is taken for a frame around the article.
FRAME = 0.8
PART = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[=>]")
BLANK = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
SPACE = re.compile(r"\s+")
HEADINGS = frozenset(("header", "hgroup"))
#: Elements that flow within a paragraph: what is dropped of them does not end it.
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
#: Elements that end the search for an open inline element, and for an open item.
WALLS, LISTS = ("table", "article", "body"), ("ul", "ol", "dl", "table", "select")
#: Text of containers of these kinds counts nearly in full for the one around them.
PLAIN = frozenset("section div td tr tbody table blockquote figure center dd details".split())


class _Node:
    __slots__ = ("dropped", "key", "region", "tag")

    def __init__(self, tag: str, dropped: bool, key: int, region: int):
        self.tag, self.dropped, self.key, self.region = tag, dropped, key, region


def marked(names: str) -> str | None:
    """The first mark among names of classes, ids and roles."""
    for name in names.lower().split():
        if name in MARKS:
            return name
        parts = PART.findall(name)
        if len(parts) > 1 and parts[0] in MODIFIERS:
            continue
        for part in parts[:1] + parts[-1:]:
            if part in MARKS:
                return part
    return None


def tag_end(page: str, at: int, last: int) -> int:
    """Where the tag ends whose attributes begin at `at`; `last` is the place of the page's last >.

    A > within a quoted value ends no tag. A quote that is not closed before `last` is no quote,
    and there is none of its kind after it, so all searches together stay linear.
    """
    end = page.find(">", at, last + 1)
    part = page[at:end]
    double, single = part.count('"'), part.count("'")
    if not (double and single or double & 1 or single & 1):
        return end
    while True:
        m = STOP.search(page, at)
        if m[0] == ">":
            return m.start()
        at = BLANK.match(page, m.end()).end()
        if (quote := page[at]) in "\"'" and (close := page.find(quote, at + 1, last)) >= 0:
            at = close + 1


class Page:
    """Blocks of text and containers of a page.

    blocks: (text, characters within links, innermost container, region); containers: (parent,
    tag, hash of the path, region), the root first. Character references are decoded once, white
    space within a block becomes one space, empty blocks vanish. A region is what lies within a
    form or marked element; the page as a whole decides which of them are dropped.
    """

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, int]] = []
        self.containers: list[tuple[int, str, int, int]] = [(-1, "", 0, 0)]
        self.steps = [""]
        self.regions: list[tuple[int, bool]] = [(-1, False)]  # parent, whether a comments' region
        self.gone = [False]
        self._parse(page)
        self._resolve()

    def _parse(self, page: str) -> None:
        stack, homes, where = [_Node("", False, 0, 0)], [0], defaultdict(list)
        boxes: list[int] = []  # where in the stack containers are
        text: list[str] = []
        linked = links = at = 0
        end, last = len(page), page.rfind(">")

        def flush() -> None:
            nonlocal linked
            if text:
                words = SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if words:
                    self.blocks.append((words, min(linked, len(words)), homes[-1], stack[-1].region))
                text.clear()
            linked = 0

        def innermost(tags: tuple) -> int:
            return max([where[x][-1] for x in tags if where[x]], default=0)

        def close(n: int) -> None:
            nonlocal links
            if any(x.tag in BLOCKS for x in stack[n:]) or stack[-1].region != stack[n - 1].region:
                flush()
            while len(stack) > n:
                node = stack.pop()
                where[node.tag].pop()
                if node.tag in CONTAINERS:
                    boxes.pop()
                if node.key >= 0:
                    homes.pop()
                links -= node.tag == "a"

        while at < end:
            start = page.find("<", at)
            # A < that begins nothing, or whose tag never ends, is text.
            while 0 <= start and not (start < last and (page[start + 1] in "!?/" or NAME.match(page, start + 1))):
                start = page.find("<", start + 1) if start < last else -1
            upto = start if start >= 0 else end
            if upto > at and not stack[-1].dropped:
                text.append(page[at:upto])
                if links:
                    linked += upto - at
            if start < 0:
                break
            if page[start + 1] in "!?" or (page[start + 1] == "/" and not NAME.match(page, start + 2)):
                if page.startswith("<!--", start):
                    stop = page.find("-->", start + 4)
                    at = stop + 3 if stop >= 0 else end
                else:
                    at = page.index(">", start) + 1
                continue
            closing = page[start + 1] == "/"
            name = NAME.match(page, start + 1 + closing)
            tag = name[0].lower()
            stop = tag_end(page, name.end(), last)
            at = stop + 1
            if closing:
                own = where[tag]
                if own and (tag in BLOCKS or own[-1] > innermost(WALLS)):
                    close(own[-1])
                elif not own and tag in BLOCKS:
                    flush()
                continue
            if tag in CLOSES_P and where["p"] and where["p"][-1] > (boxes[-1] if boxes else 0):
                close(where["p"][-1])
            for kind in CLOSES.get(tag, ()):
                if where[kind] and where[kind][-1] > innermost(LISTS):
                    close(where[kind][-1])
            if tag in BLOCKS:
                flush()
            if tag == "br" and not stack[-1].dropped:
                text.append(" ")
            itself = page[stop - 1] == "/"
            if tag in VOID or (itself and (tag in ("svg", "math") or (tag not in BLOCKS and tag not in RAW))):
                continue
            if tag in RAW:
                ends = RAW_END[tag].search(page, at)
                if ends is None and tag in ("svg", "math"):
                    continue
                at = page.find(">", ends.end()) + 1 if ends else end
                at = at or end
                continue
            above = stack[-1]
            names, dropped, region = "", above.dropped or tag in DROPPED, above.region
            if not dropped:
                mark = "form" if tag == "form" else None
                if stop > name.end():
                    found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(page, name.end(), stop)}
                    names = found.get("class", "")
                    dropped = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "") or found.get("aria-hidden") == "true"
                    if tag not in ("html", "body", "main"):
                        m = marked(f"{names} {found.get('id', '')} {found.get('role', '')}")
                        mark = m if m and (tag != "article" or m in COMMENTS) else mark
                dropped = dropped or (tag in HEADINGS and not where["article"] and not where["main"]) or (mark is not None and tag in INLINE)
                if mark and not dropped:
                    flush()
                    self.regions.append((region, mark in COMMENTS))
                    region = len(self.regions) - 1
            node = _Node(tag, dropped, -1, region)
            if tag in CONTAINERS:
                boxes.append(len(stack))
                if not dropped:
                    step = tag + "".join("." + re.sub(r"\d+", "#", x) for x in sorted(names.split()))
                    path = int.from_bytes(blake2b(b"%d>%s" % (self.containers[homes[-1]][2], step.encode("utf-8", "replace")), digest_size=8).digest(), "big", signed=True)
                    node.key = len(self.containers)
                    self.containers.append((homes[-1], tag, path, region))
                    self.steps.append(step)
                    homes.append(node.key)
            where[tag].append(len(stack))
            stack.append(node)
            links += tag == "a"
        flush()

    def _resolve(self) -> None:
        """Which regions are dropped: all but frames around the article.

        A region is a frame if it holds an article (or the main element, on a page without articles)
        and none lies outside of all regions, or if it holds nearly all of the page's text. Readers'
        comments never are one.
        """
        n = len(self.regions)
        held, articles = [0] * n, [0] * n
        for words, _, _, region in self.blocks:
            held[region] += len(words)
        kind = "article" if any(tag == "article" for _, tag, _, _ in self.containers) else "main"
        for _, tag, _, region in self.containers:
            articles[region] += tag == kind
        outside = articles[0] > 0
        for i in range(n - 1, 0, -1):
            held[self.regions[i][0]] += held[i]
            articles[self.regions[i][0]] += articles[i]
        self.gone = [False] * n
        for i in range(1, n):
            above, comments = self.regions[i]
            frame = (articles[i] > 0 and not outside) or held[i] >= FRAME * max(1, held[0])
            self.gone[i] = self.gone[above] or comments or not frame

    def scores(self) -> dict[int, tuple[float, int]]:
        """(score, container) by path: the text that a container holds itself, less what its links hold, and a part of its children's scores.

        Only 0.9 of a plain container's score goes up to the one around it, and half of an article's or
        main's, so the innermost container that holds most of an article beats the page's body.
        """
        total = [0.0] * len(self.containers)
        for words, linked, key, region in self.blocks:
            if not self.gone[region]:
                total[key] += max(0, len(words) - 3 * linked)
        for i in range(len(total) - 1, 0, -1):
            above, tag, _, _ = self.containers[i]
            total[above] += (0.9 if tag in PLAIN else 0.5) * total[i]
        votes: dict[int, tuple[float, int]] = {}
        for i in range(1, len(total)):
            _, tag, path, region = self.containers[i]
            weight = total[i] * (1.5 if tag in ("article", "main") else 1.0)
            if weight > 0 and not self.gone[region] and weight > votes.get(path, (0.0, 0))[0]:
                votes[path] = (weight, i)
        return votes

    def label(self, key: int) -> str:
        """The last steps of a container's path, for people to read."""
        steps = []
        while key > 0 and len(steps) < 3:
            steps.append(self.steps[key][:60])
            key = self.containers[key][0]
        return ">".join(reversed(steps))

    def inside(self, path: int | None) -> list[bool]:
        """For each container whether it is, or lies in, one of the given path (None: all are)."""
        out = [path is None] * len(self.containers)
        for i, (above, _, own, _) in enumerate(self.containers):
            out[i] = out[i] or (i > 0 and (own == path or out[above]))
        return out

    def text(self, inside: list[bool]) -> str:
        return "\n".join(words for words, _, key, region in self.blocks if inside[key] and not self.gone[region])

    def held(self, inside: list[bool]) -> int:
        """Characters outside links."""
        return sum(max(0, len(words) - 3 * linked) for words, linked, key, region in self.blocks if inside[key] and not self.gone[region])


#: A host's winning path gives way to another of its paths where it holds less than this share of what that one holds.
LITTLE = 0.25
#: Paths kept for a host behind the winner: the best one of this share, at least, of the pages that the host's most frequent best one has; and so many at most.
ALSO, MOST_PATHS = 0.3, 8


def main_text(html: str, paths: list[int]) -> str:
    """Blocks under the containers of a host's paths (the winner first), joined by newlines.

    Those under the page's own best container instead, if none of the paths holds text but links.
    """
    page = Page(html)
    known = {path for _, _, path, _ in page.containers}
    found = [(x, page.held(x)) for x in (page.inside(path) for path in paths if path in known)]
    if found and found[0][1] < LITTLE * max(n for _, n in found):
        found.sort(key=lambda x: -x[1])
    votes = page.scores()
    if not found or not found[0][1]:
        best = max(votes, key=lambda x: (votes[x][0], x)) if votes else None
        own = page.inside(best)
        if not found or page.held(own):
            return page.text(own)
    return page.text(found[0][0])


def host_of(url):
    """Host of a URL column, lower case, without port; null if there is none."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, label, votes, wins): a page gives its best path one vote, and others the fourth power of their share of its score; wins counts the pages whose best it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hosts, htmls in text_lists(batches, 4_000_000):
            sums: dict[tuple, list] = {}
            for host, html in zip(hosts, htmls, strict=True):
                page = Page(html or "")
                votes = page.scores()
                best = max((x for x, _ in votes.values()), default=0)
                for path, (x, key) in votes.items():
                    if vote := round((x / best) ** 4 * 1e6):
                        s = sums.setdefault((host, path), [0, "", 0])
                        s[0] += vote
                        s[2] += x == best
                        s[1] = max(s[1], page.label(key))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array([v[1] for v in sums.values()], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[2] for v in sums.values()], pa.int64())], names=["host", "path", "label", "votes", "wins"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path bigint, label string, votes bigint, wins bigint")
    return votes.groupBy("host", "path").agg(F.max("label").alias("label"), F.sum("votes").alias("votes"), F.sum("wins").alias("wins"))


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, paths, host_path): hashes of the path with the most votes and of those behind it, and the winner's label.

    Ties go to the smaller hash.
    """
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    first = votes.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MOST_PATHS)
    lists = first.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "path", "label", "wins"))).alias("all"))
    most = F.array_max(F.transform("all", lambda x: x["wins"]))
    kept = F.filter("all", lambda x: (x["r"] == 1) | (x["wins"] >= ALSO * most))
    return lists.select("host", F.transform(kept, lambda x: x["path"]).alias("paths"), F.col("all")[0]["label"].alias("host_path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host_path) for every page.

    Null or empty html gives the empty text; pages without a host vote together; repeated rows give
    repeated rows; an empty table an empty one; further columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"))
    paths = host_paths(host_votes(rows))
    joined = join_measured(rows, paths, ["host"], F.octet_length("host") + F.octet_length("host_path") + 8 * MOST_PATHS, F.col("html")).select("page_id", "url", "paths", "host_path", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, paths, labels, htmls in text_lists(batches, 4_000_000):
            texts = [main_text(html, own or []) for html, own in zip(htmls, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(labels, pa.string())], names=["page_id", "url", "text", "n_chars", "host_path"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, host_path string")

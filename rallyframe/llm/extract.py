"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is read into block nodes. Each gets features: its kind, attribute tokens of its own and of
what surrounds it, depth, place and number of siblings, text and link densities of its
subtree. Boosted trees give the log odds of a node being part of the article. Decoding then
picks the labels with the greatest total among those without contradiction: what lies under
a node labelled as boilerplate is boilerplate, and article nodes may hold boilerplate
but not the other way round.

The trees are fitted to a bounded sample: SAMPLE different pages of at most SAMPLE_CHARS characters that mark their article,
the first by a hash of their content, so it is the same on every run. What is known of their nodes does not come from
the names that are features: the article is what lies in the element that HTML has for it; what lies outside, or in
elements that HTML has for other things, is not part of it. In a table where no page marks its article all of a page is, but for those elements. A node in the article with a name of
boilerplate, or with a text that other pages of the sample repeat, is left out of the fit. Names are learnt from boxes put into copies of the pages, whose content is
taken from other pages; a last copy hides all names, so that the trees also learn from density, depth and siblings.

Nulls: a null html is empty and gives an empty text. Rows are independent; repeated
rows repeat their results; extra columns are not read. Malformed, truncated and very long
pages are read to their end in time that grows with their length; unclosed elements end where their parent ends, and a
tag that is never closed is text.

Plan: one pass where pages are read, no shuffle; the model in the closure has a fixed size.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted import BoostedTrees
from .shared import columns, map_batches, texts_of, whole_text

SAMPLE, SAMPLE_CHARS = 600, 200_000
EXTRACTED = columns(page_id="long", url="str", text="str", n_chars="long")

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea title svg iframe object select".split())
BLOCKS = (
    "html body article main section div header footer nav aside form h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address fieldset details summary dialog menu center hgroup search"
).split()
ENDS_P = frozenset(BLOCKS) - {"html", "body"} | {"hr"}
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table div section article main aside nav body".split())
# Attribute tokens that name boilerplate or content.
BOILER = frozenset(
    "ad ads adv advert advertisement adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget aside "
    "footer foot header masthead topbar comment comments reply replies disqus discussion cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe "
    "signup login form search share sharing social related recommended popular tags pagination pager copyright legal disclaimer".split()
)
CONTENT = frozenset("article content main post entry story body text page-content article-body post-content entry-content".split())
BOILER_TAGS = frozenset("nav aside footer header form dialog menu fieldset search".split())
CONTENT_TAGS = frozenset("article main".split())

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in HIDDEN}
ATTRS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KINDS = ("body", "article", "main", "section", "div", "header", "footer", "nav", "aside", "form", "p", "li", "ul", "td", "table", "blockquote", "pre", "heading", "other")
KIND_OF = {t: KINDS.index("heading" if t in HEADINGS else t if t in KINDS else "other") for t in {*BLOCKS, *KINDS}}
#: Columns that say by name what a node is; hidden in the second copy of the sample.
NAMED = 10 + len(KINDS)
#: An attribute of boxes that a copy of a page was given; no page can have it.
BOX = "\1"


def tokens(source: str) -> Iterator[tuple[str | None, str | None, bool, str]]:
    """(text, tag, is it an end tag, attributes): pieces of text, and tags without those of elements whose inside is hidden.

    Each place is read a bounded number of times: a quote that is never closed is no quote, and makes tags
    end at the next ``>`` up to the last quote of the page.
    """
    at, last, plain_until = 0, source.rfind(">"), -1
    while at < len(source):
        begin = source.find("<", at)
        if begin < 0 or begin > last:
            yield source[at:], None, False, ""
            return
        if begin > at:
            yield source[at:begin], None, False, ""
        name = NAME.match(source, begin)
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            at = end + 3 if end >= 0 else len(source)
        elif not name:
            other = source[begin + 1 : begin + 2] in ("!", "?", "/")
            at = source.find(">", begin) + 1 if other else begin + 1
            if not other:
                yield "<", None, False, ""
        else:
            found = REST.match(source, name.end()) if begin > plain_until else None
            if not found and begin > plain_until:
                plain_until = max(source.rfind('"'), source.rfind("'"))
            at = found.end() if found else source.find(">", name.end()) + 1
            tag = name[2].lower()
            if tag in HIDDEN and not name[1]:
                closing = CLOSING[tag].search(source, at)
                at = closing.end() if closing else len(source)
            else:
                yield None, tag, bool(name[1]), source[name.end() : at - 1]


class OpenElements:
    """The open elements, each with the block node around its inside, and how many of each tag are open, in all and since the last scope."""

    def __init__(self):
        self.items: list[tuple[str, int]] = [("", 0)]
        self.count: Counter = Counter()
        self.scopes: list[Counter] = [Counter()]

    def push(self, tag: str, node: int) -> None:
        self.items.append((tag, node))
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())

    def pop(self) -> str:
        tag = self.items.pop()[0]
        if tag in SCOPES:
            self.scopes.pop()
        self.count[tag] -= 1
        self.scopes[-1][tag] -= 1
        return tag

    def close(self, *tags: str) -> bool:
        """Ends elements up to the last of tags; whether a block was among them."""
        block = False
        while True:
            tag = self.pop()
            block |= tag in KIND_OF
            if tag in tags:
                return block

    def close_before(self, tag: str) -> None:
        """Ends what an element of this tag ends: a paragraph, or one of its own kind, in the same scope."""
        ends = ("p", *SAME_ENDS.get(tag, ())) if tag in ENDS_P else SAME_ENDS.get(tag, ())
        if any(self.scopes[-1][t] > 0 for t in ends):
            self.close(*ends)

    @property
    def node(self) -> int:
        return self.items[-1][1]


class Page:
    """Block nodes of a page and its text pieces as (node, block, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.boiler, self.content = ["body"], [-1], [0], [False], [False]
        self.children, self.index, self.box = [0], [0], [False]
        self.direct, self.linked, self.tags = [0], [0], [1]
        self.pieces: list[tuple[int, int, str]] = []
        stack, block = OpenElements(), 0
        for text, tag, is_end, attrs in tokens(source):
            if tag is None:
                node, n = stack.node, len(text)
                self.pieces.append((node, block, text))
                self.direct[node] += n
                if stack.count["a"]:
                    self.linked[node] += n
                continue
            if is_end:
                if stack.count[tag]:
                    block += stack.close(tag)
                continue
            self.tags[stack.node] += 1
            if tag in VOID:
                if tag == "br":
                    self.pieces.append((stack.node, block, " "))
                elif tag == "hr":
                    block += 1
                continue
            if tag in ENDS_P or tag in SAME_ENDS:
                stack.close_before(tag)
            names = self._tokens(attrs)
            boiler, content = bool(names & BOILER), bool(names & CONTENT)
            if tag in ("html", "body", "head"):
                stack.push(tag, stack.node)
                continue
            if tag in KIND_OF or boiler or content:
                around = stack.node
                if tag in KIND_OF:
                    block += 1
                self.tag.append(tag)
                self.parent.append(around)
                self.depth.append(self.depth[around] + 1)
                self.boiler.append(boiler)
                self.content.append(content)
                self.box.append(BOX in attrs)
                self.index.append(self.children[around])
                self.children[around] += 1
                for x in (self.children, self.direct, self.linked):
                    x.append(0)
                self.tags.append(1)
                stack.push(tag, len(self.tag) - 1)
            else:
                stack.push(tag, stack.node)
            if attrs.endswith("/") and tag not in KIND_OF:
                stack.pop()

    @staticmethod
    def _tokens(attrs: str) -> set[str]:
        if not attrs or "=" not in attrs:
            return set()
        out: set[str] = set()
        for value in ATTRS.findall(attrs):
            value = value.strip("\"'").lower()
            out.update(value.split())
            out.update(WORDS.findall(value))
        return out

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        direct, linked, tags = (np.array(x, dtype=np.float64) for x in (self.direct, self.linked, self.tags))
        text, link, count = direct.copy(), linked.copy(), tags.copy()
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            text[p] += text[i]
            link[p] += link[i]
            count[p] += count[i]
        kind = np.array([KIND_OF.get(t, KINDS.index("other")) for t in self.tag])
        boiler_tag = np.array([t in BOILER_TAGS for t in self.tag])
        content_tag = np.array([t in CONTENT_TAGS for t in self.tag])
        boiler, content = np.array(self.boiler), np.array(self.content)
        inside = np.zeros((n, 4))
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = np.maximum(inside[p], (boiler[p], content[p], boiler_tag[p], content_tag[p]))
        safe = np.maximum(parent, 0)
        named = np.zeros((n, NAMED))
        named[:, 0], named[:, 1], named[:, 2], named[:, 3] = boiler, content, boiler_tag, content_tag
        named[:, 4:8] = inside
        named[:, 8], named[:, 9] = kind == KINDS.index("body"), boiler[safe]
        named[np.arange(n), 10 + kind] = 1
        children, index = np.array(self.children), np.array(self.index)
        rest = np.stack(
            [
                np.array(self.depth), children, index, children[safe] - index, np.log1p(text), np.log1p(direct), link / np.maximum(text, 1), text / np.maximum(count, 1),
                text / max(text[0], 1), direct / np.maximum(text, 1), np.log1p(text[safe]), link[safe] / np.maximum(text[safe], 1), kind == KINDS.index("p"), kind == KINDS.index("heading"),
                kind == KINDS.index("li"), kind == KINDS.index("ul"), kind[safe] == KINDS.index("ul"),
            ],
            axis=1,
        )
        return np.concatenate([named, rest], axis=1)

    def blocks(self) -> list[str]:
        """The text right inside each node."""
        own: list[list[str]] = [[] for _ in self.tag]
        for node, _, piece in self.pieces:
            own[node].append(piece)
        return [" ".join("".join(x).split()) for x in own]

    def known(self, repeated: frozenset[str] = frozenset()) -> np.ndarray:
        """1 for nodes of the article, 0 for others, -1 where nothing is known.

        The article is what lies in an article or main element (or, without one, in a node with a name of content);
        boxes and elements for other things are not part of it; of nodes with a name of boilerplate or a text that other
        pages repeat it is not known.
        """
        n = len(self.tag)
        marked = [t in CONTENT_TAGS for t in self.tag]
        if not any(marked):
            marked = self.content if any(self.content) else [True] * n
        text = self.blocks() if repeated else None
        out, off, doubtful = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        for i in range(1, n):
            p = self.parent[i]
            inside = marked[i] or out[p] != 0
            other = self.tag[i] in BOILER_TAGS and not (self.tag[i] == "header" and inside)
            off[i] = off[p] or self.box[i] or other
            doubtful[i] = doubtful[p] or (inside and (self.boiler[i] or (text is not None and text[i] in repeated)))
            out[i] = 0 if off[i] else -1 if doubtful[i] else int(inside)
        return out

    def decoded(self, odds: np.ndarray) -> np.ndarray:
        """Labels with the greatest total of log odds in which nothing under boilerplate is content.

        Three states go down the tree: outside an article (its inside is open), content, and
        boilerplate, which binds all below it. Only content counts a node's log odds.
        """
        n = len(odds)
        gain = odds
        open_, good = np.zeros(n), gain.copy()  # best totals of the subtree if the node is outside, or content
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            open_[p] += max(0.0, open_[i], good[i])
            good[p] += max(0.0, good[i])
        state = np.zeros(n, dtype=np.int64)  # 0 boilerplate, 1 outside, 2 content
        state[0] = 2 if good[0] > max(0.0, open_[0]) else 1
        for i in range(1, n):
            s = state[self.parent[i]]
            if s == 2:
                state[i] = 2 if good[i] > 0 else 0
            elif s == 1:
                state[i] = 2 if good[i] > max(0.0, open_[i]) else 1 if open_[i] > 0 else 0
        return state == 2

    def text(self, keep: np.ndarray) -> str:
        out, block, parts = [], None, []
        for node, b, piece in self.pieces:
            if keep[node]:
                if b != block and parts:
                    out.append("".join(parts))
                    parts = []
                block = b
                parts.append(piece)
        out.append("".join(parts))
        return " ".join(filter(None, (" ".join(html_lib.unescape(x).split()) for x in out)))


def under_another_name(source: str, k: int) -> tuple[str, int]:
    """source with its article in another element that says so, and where that begins (0 without an article)."""
    tag, attrs = (("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("section", ' class="post-body"'))[k % 5]
    begin = re.search(r"(?i)<(?:article|main)\b[^>]*>", source)
    if not begin:
        return source, 0
    rest = re.sub(r"(?i)</(?:article|main)\s*>", f"</{tag}>", source[begin.end() :], count=1)
    return f"{source[: begin.start()]}<{tag}{attrs}>{rest}", begin.start()


def words_of(source: str) -> list[str]:
    return re.sub(r"<[^>]*>", " ", source).split()


def disturbed(source: str, other: str, k: int) -> str:
    """source with its article under another name and two pieces of other in it as boilerplate."""
    names, inner, outer = sorted(BOILER), ("div", "section", "aside", "form", "ul", "nav"), ("header", "div", "section", "header", "aside", "ul")
    source, start = under_another_name(source, k)
    words = words_of(other)
    pieces = [" ".join(words[i : i + 5 + 7 * (k % 6)]) for i in (k % 11, 20 + k % 17)]
    boxes = []
    for i, (t, x) in enumerate(((inner[k % 6], pieces[0]), (outer[k % 6], pieces[1]))):
        name = "" if t in BOILER_TAGS and k % 2 else f' class="{names[(7 * k + i) % len(names)]}"'
        line = ("li", "h2", "p", "label")[0 if t == "ul" else 1 + k // 6 % 3]
        boxes.append(f"<{t}{name} {BOX}><{line}>{x}</{line}></{t}>")
    ends = [m.end() for m in re.finditer(r"(?i)</p>", source) if m.start() > start] or [len(source)]
    at = ends[k % len(ends)]
    return source[:start] + boxes[1] + source[start:at] + boxes[0] + source[at:]


#: Parts of articles beside headings and paragraphs; {0} to {3} are four pieces of text.
PARTS = (
    "<ul><li>{0}</li><li>{1}</li><li>{2}</li></ul>", "<div><p>{0}</p><p>{1}</p></div>", "<table><tr><th>{0}</th><td>{1}</td></tr><tr><th>{2}</th><td>{3}</td></tr></table>", "<blockquote>{0}</blockquote>",
    "<section><h2>{0}</h2><p>{1}</p></section>", "<pre>{0}</pre>", "<figure><img src=x><figcaption>{0}</figcaption></figure>", "<div>{0}</div>", "<ol><li>{0}</li><li>{1}</li></ol>", "<div><ul><li>{0}</li><li>{1}</li></ul><blockquote><p>{2}</p></blockquote></div>",
    "<dl><dt>{0}</dt><dd>{1}</dd><dt>{2}</dt><dd>{3}</dd></dl>", "<section><div><p>{0}</p><pre>{1}</pre></div><p>{2}</p></section>", "<table><thead><tr><td>{0}</td></tr></thead><tbody><tr><td>{1}</td></tr></tbody></table>", "<blockquote><p>{0}</p><p>{1}</p></blockquote>",
)


def enriched(source: str, other: str, k: int) -> str:
    """source with its article under another name and PARTS made of other's words in it as content, some before a heading, some with a name that says nothing."""
    source, start = under_another_name(source, k)
    words, kind = words_of(other) or ["word"], ("", ' class="c-17 wide"', ' id="x9"')[k // 7 % 3]
    end = re.search(r"(?i)</(?:article|main|section|body)\b", source[start:])
    inside = source[start : start + end.start()] if end else source[start:]
    places = sorted({start + (m.end() if m[0][1] == "/" else m.start()) for m in re.finditer(r"(?i)<h[1-6]\b|</p\s*>", inside)})
    out, at = [], 0
    for n, place in enumerate(places[k % 3 :: 3] or places[:1]):
        size, first = (3, 8, 25, 60)[(n + k) % 4], 13 * n + k
        pieces = [" ".join((words * (2 + 4 * size // len(words)))[(first + i * size) % len(words) :][:size]) for i in range(4)]
        out += [source[at:place], re.sub(r"^<(\w+)", rf"<\1{kind}", PARTS[(k + 5 * n) % len(PARTS)].format(*pieces))]
        at = place
    return "".join([*out, source[at:]])


def trained(sources: list[str]) -> BoostedTrees:
    """Trees fitted to pages that mark their article, or to pages of which none does."""
    read = [Page(x) for x in sources]
    texts = Counter(t for page in read for t in {x for x in page.blocks() if x})
    repeated = frozenset(t for t, n in texts.items() if n > 1)
    xs, ys = [], []
    for k, (source, page) in enumerate(zip(sources, read, strict=True)):
        changed, fuller = Page(disturbed(source, sources[k - 1], k)), Page(enriched(source, sources[k - 1], k))
        for own, hide in ((page, False), (changed, False), (fuller, False), (page, True)):
            x, y = own.features(), own.known(repeated)
            if hide:
                x[:, :NAMED] = 0
            xs.append(x[y >= 0])
            ys.append(y[y >= 0])
    if not sources:  # nothing is known to be boilerplate
        xs, ys = [np.zeros((1, Page("").features().shape[1]))], [np.array([1])]
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(np.float64))


def fitted(pages: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Trees fitted to a bounded sample of the different pages that mark their article by an element, a class, an id or a role; of all different pages where none does."""
    named = rf"(?i)<({'|'.join(sorted(CONTENT_TAGS))})\b|\b(class|id|role)\s*=\s*[^>]*\b({'|'.join(sorted(CONTENT))})\b"
    short = pages.select(F.col("html")).filter((F.length("html") <= SAMPLE_CHARS) & (F.col("html") != "")).withColumn("h", F.xxhash64("html"))
    marked = short.filter(F.col("html").rlike(named))
    n = marked.agg(F.approx_count_distinct("h")).first()[0]
    if not n:
        marked, n = short, short.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, 2 * sample / max(1, n))  # so that about twice the sample is looked at, however many pages there are
    drawn = marked.filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < share)
    few = drawn.groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(sample)
    return trained([row["html"] for row in few.collect()])


def extracted(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """EXTRACTED: the main text of each page (page_id, url, html)."""
    trees = trees or fitted(pages)

    def each(batch: pa.RecordBatch) -> dict:
        texts = []
        sources = texts_of(batch, "html")
        for k in range(0, len(sources), 200):
            read = [Page(x) for x in sources[k : k + 200]]
            odds = trees.log_odds(np.concatenate([p.features() for p in read]))
            ends = np.cumsum([len(p.tag) for p in read])
            texts += [p.text(p.decoded(odds[e - len(p.tag) : e])) for p, e in zip(read, ends.tolist(), strict=True)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), EXTRACTED, each)

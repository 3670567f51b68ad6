"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags, each with the tags, classes
and ids of its ancestors and some features of its text. The chain learns which blocks are main text from labelled
pages and marks them on each page by Viterbi's algorithm.

The labelled pages are layouts built here by rule, in which each container says whether it is main text: articles in
varied containers among menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
Names aren't all that counts: features of the layout (text and links of a box beside the others, where the title is, like
boxes side by side, neighbouring blocks) speak where containers are unnamed or foreign. Text without any tag is no article.

Nulls, empty pages and pages without text give an empty text. Rows that come again, with or without page_id, each have
their result. Broken markup is read as far as it can be: a mark that can't be read is passed over. The work grows
with the length of a page, whatever it nests or leaves open: the features of a block are those of its innermost open
elements and of all that they have added, which each element keeps once. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .crf import Chain

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title textarea iframe head".split())
#: What may stand in a head; anything else ends a head that has no end tag.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BOXES = frozenset("article aside body div footer form header main nav section td".split())
ENDS_BEFORE = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ARTICLE = frozenset(("in:article", "in:main"))
#: Words of a class, id or role; inner capitals begin a new one.
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Letters by which longer names count as well, so that forms of one word are alike.
STEM = 5
#: A start or end tag: its sign, its name and the rest, in which quoted values may hold its end.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
SHORT_COMMENT = re.compile("<!--(?:-?>)")
#: Elements whose content is no markup, and where it ends.
RAW = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])") for tag in ("script", "style")}


class Node:
    """An open element: its tag, the names of its class, id and role, and what it and its ancestors add to a block's features.

    home: the innermost box that it is or lies in; outer: the box around that.

    `features` is one frozenset for all elements that add nothing new, so that deep nesting shares it.
    """

    __slots__ = ("box", "features", "home", "label", "outer", "tag")

    def __init__(self, tag: str, names: list[str], label: int, parent: Node | None, known: Container[str] | None):
        self.tag = tag
        self.label = label if label >= 0 or parent is None else parent.label
        stems = [f"stem:{n[:STEM]}" for n in names if len(n) > STEM]
        fresh = {n for n in (f"in:{tag}", *[f"name:{n}" for n in names], *stems) if known is None or n in known}
        above = parent.features if parent else frozenset()
        self.features = above if fresh <= above else above | fresh
        self.box = tuple(dict.fromkeys((f"box:{tag}", *[f"box:{n}" for n in names]))) if tag in BOXES else parent.box if parent else ("box:",)
        above = parent.home if parent else None
        self.home, self.outer = (self, above) if tag in BOXES else (above, parent.outer if parent else None)


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def label(self) -> int:
        return max(0, self.node.label) if self.node else 0


class Leaves:
    """Collects leaf blocks. `stack` holds the open elements and `open` how many of each tag.

    labels: the attribute that says whether an element is main text, for pages to learn from. known: features that count;
    others are left out, so that what elements add is bounded.
    """

    def __init__(self, labels: str | None = None, known: Container[str] | None = None):
        self.labels, self.known = labels, known
        self.stack: list[Node] = []
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.stack[-1] if self.stack else None, text, self.linked))
            self.parts, self.linked = [], 0

    def end_head(self) -> None:
        """Leave an open head, unless a silent element inside it is open."""
        if self.silent == 1 and self.open["head"]:
            self.end("head")

    def start(self, tag: str, inside: str) -> None:
        """A start tag; inside: what stands between its name and its end."""
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK:
            self.flush()
            if self.stack and self.stack[-1].tag == "p":
                self.pop()
            while self.stack and self.stack[-1].tag in ENDS_BEFORE.get(tag, ()):
                self.pop()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or (closed := inside.endswith("/")) and tag not in BLOCK:
            return
        self.silent += tag in SILENT
        self.open[tag] += 1
        got: dict[str, str] = {}
        if "=" in inside:
            for m in ATTRIBUTE.finditer(inside):
                got.setdefault(m[1].lower(), unescape(m[2].strip("\"'")))
        names = [n.lower() for k in ("class", "id", "role") for n in NAMES.findall(got.get(k, ""))]
        label = int(got[self.labels]) if self.labels in got else -1
        self.stack.append(Node(tag, names, label, self.stack[-1] if self.stack else None, self.known))
        if closed:
            self.end(tag)

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        self.silent -= tag in SILENT

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()

    def data(self, raw: str) -> None:
        text = unescape(raw)
        if self.silent == 1 and not text.isspace():
            self.end_head()
        if self.silent <= 0:
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def feed(self, html: str) -> None:
        """Read a page from front to back; no place is looked at more than a few times.

        A comment without an end loses its mark alone. Once a tag has no end outside its quotes, quotes don't count any
        more, and a tag without any end is text.
        """
        at, behind = 0, len(html)
        tag_at, last_end, last_comment = TAG.match, html.rfind(">"), html.rfind("-->")
        while at < behind:
            mark = html.find("<", at)
            if mark < 0 or mark > last_end:
                self.data(html[at:])
                break
            if mark > at:
                self.data(html[at:mark])
            sign = html[mark + 1]
            if html.startswith("<!--", mark):
                short = SHORT_COMMENT.match(html, mark)
                at = short.end() if short else html.index("-->", mark + 4) + 3 if last_comment >= mark + 4 else mark + 4
            elif sign in "!?" or (sign == "/" and not html[mark + 2 : mark + 3].isalpha()):
                end = html.find("]]>", mark) + 2 if html.startswith("<![CDATA[", mark) else -1
                at = max(end, html.index(">", mark)) + 1
            elif not (sign == "/" or sign.isascii() and sign.isalpha()):
                self.data("<")
                at = mark + 1
            else:
                m = tag_at(html, mark)
                if not m:
                    tag_at = PLAIN_TAG.match
                    m = tag_at(html, mark)
                tag, at = m[2].lower(), m.end()
                if m[1]:
                    self.end(tag)
                else:
                    self.start(tag, m[3])
                    if tag in RAW and self.open[tag]:
                        close = RAW[tag].search(html, at)
                        at = close.start() if close else behind
        self.flush()


def leaf_blocks(html: str | None, labels: str | None = None, known: Container[str] | None = None) -> list[Block]:
    leaves = Leaves(labels, known)
    leaves.feed(html or "")
    return leaves.blocks


def block_features(blocks: list[Block]) -> list[tuple[frozenset[str], tuple[str, ...]]]:
    """For each block the features of its open elements (shared) and its own, none of which is among the former."""
    out = []
    layout = layout_features(blocks)
    for b, around in zip(blocks, layout, strict=True):
        words = b.text.count(" ") + 1
        own = (
            f"tag:{b.node.tag if b.node else ''}", *(b.node.box if b.node else ("box:",)), f"words:{min(7, words.bit_length())}", f"links:{link_class(b)}",
            f"end:{b.text[-1] if b.text[-1] in '.!?:…' else ''}", f"sign:{int('©' in b.text)}", f"commas:{min(3, b.text.count(','))}", *around,
        )
        out.append((b.node.features if b.node else frozenset(), own))
    return out


def link_class(b: Block) -> int:
    """0 where a block has no link text, 1 where that is less than half of it, else 2."""
    share = b.linked / max(1, len(b.text))
    return 0 if share == 0 else 1 if share < 0.5 else 2


def layout_features(blocks: list[Block]) -> list[list[str]]:
    """What says something about a block whatever its containers are called: how much text and how many links its box holds
    beside the others, whether the page's first title is in it, like boxes beside it, the blocks before and behind, and
    whether other blocks of the page alone, or its title, are in an article.

    A box is counted by the blocks that lie in it directly. What a page doesn't have adds no feature.
    """
    homes = [b.node.home if b.node else None for b in blocks]
    letters: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    seen: dict[int, Node | None] = {}
    titled = None
    for b, home in zip(blocks, homes, strict=True):
        letters[id(home)] += len(b.text)
        linked[id(home)] += b.linked
        seen[id(home)] = home
        if titled is None and b.node and b.node.tag == "h1":
            titled = id(home)
    most = max(letters.values(), default=0)
    inside = [bool(b.node) and not b.node.features.isdisjoint(ARTICLE) for b in blocks]
    beyond = ["beyond"] * any(inside) + ["beyond title"] * any(i and b.node.tag == "h1" for i, b in zip(inside, blocks, strict=True))
    in_body = " in body" if titled is not None and (not seen[titled] or seen[titled].tag == "body") else ""
    kinds = {k: (id(h.outer), h.box) for k, h in seen.items() if h}
    alike = Counter(kinds.values())
    of_box: dict[int, list[str]] = {}
    for k, n in letters.items():
        features = of_box[k] = []
        if n < most:
            features.append(f"mass:{min(4, (most // n).bit_length())}")
        if linked[k]:
            features.append(f"linked:{1 if 3 * linked[k] < n else 2}")
        if titled is not None:
            features.append(f"titled{in_body}" if titled == k else f"untitled{in_body}")
        if k in kinds and alike[kinds[k]] > 1:
            features += (f"alike:{min(3, alike[kinds[k]].bit_length())}", f"alike {seen[k].tag}")
    shape = [f"{min(4, (b.text.count(' ') + 1).bit_length() // 2)}{link_class(b)}" for b in blocks]
    out = []
    for k, home in enumerate(homes):
        features = list(of_box[id(home)])
        if not inside[k]:
            features += beyond
        if k:
            features.append(f"before:{shape[k - 1]}{'' if homes[k - 1] is home else ' other'}")
        if k + 1 < len(blocks):
            features.append(f"behind:{shape[k + 1]}{'' if homes[k + 1] is home else ' other'}")
        out.append(features)
    return out


#: Containers of labelled layouts, (tag, attribute).
MAIN = (("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="post-body"'), ("div", 'class="entry-content"'), ("section", 'class="article-body"'), ("div", 'class="story-text"'), ("article", 'class="post"'), ("div", 'role="main"'))
LINKS = (("nav", ""), ("ul", 'class="menu"'), ("div", 'class="breadcrumb"'), ("div", 'class="share"'), ("div", 'class="related"'), ("aside", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="tags"'), ("div", 'id="nav"'), ("div", 'class="pagination"'), ("div", 'class="social links"'), ("div", 'class="widget"'))
PROSE = (("aside", ""), ("aside", 'class="note"'), ("aside", ""), ("header", ""), ("footer", ""), ("div", 'class="ad"'), ("div", 'class="advert banner"'), ("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("aside", ""), ("div", 'class="newsletter"'), ("div", 'class="promo"'), ("div", 'class="footer"'), ("div", 'class="header"'), ("div", 'role="banner"'), ("div", 'class="sponsored"'), ("div", 'class="popup"'), ("div", 'id="footer"'), ("div", 'id="header"'), ("div", 'class="subscribe"'), ("div", 'class="sidebar widget"'), ("div", 'role="contentinfo"'), ("div", 'class="paywall"'), ("div", 'class="modal"'))
REMARKS = (("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("ul", 'class="comments"'), ("div", 'id="disqus_thread"'), ("div", 'class="responses"'), ("div", 'id="respond"'), ("div", 'class="replies"'), ("section", 'class="discussion"'))
#: Names that containers of any kind may have.
NEUTRAL = ("wrap", "inner", "container", "row", "col", "box", "block", "section", "page", "group", "left", "module")
SYLLABLES = "an be co da en fi go ha in ja ke lo mi no or pe qu ra st tu un ve wi".split()


def labelled_layouts(pages: int = 1200, seed: int = 9) -> list[str]:
    """Pages of varied layout; data-main says which containers are main text.

    Some containers of each kind have no name, or one that tells nothing, so that the chain also learns from the layout.
    """
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    sentence = lambda least, most: (" ".join(word() + ("," if rng.random() < 0.06 else "") for _ in range(int(rng.integers(least, most)))) + ".").capitalize()
    prose = lambda least, most: " ".join(sentence(3, 18) for _ in range(int(rng.integers(least, most))))
    box = lambda kind, inside, main: f'<{kind[0]} {kind[1]} data-main="{main}">{inside}</{kind[0]}>'
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{word()}</a></li>' for _ in range(int(rng.integers(3, 9)))) + "</ul>"

    def nameless() -> tuple[str, str]:
        kind = rng.random()
        return pick(("div", "div", "div", "section")), "" if kind < 0.5 else f'class="{pick(NEUTRAL)}"' if kind < 0.8 else f'id="{pick(NEUTRAL)}-{int(rng.integers(99))}"'

    def aside() -> str:
        kind = rng.random()
        if kind < 0.4:
            return box(pick(LINKS) if rng.random() < 0.7 else nameless(), links(), 0)
        if kind < 0.8:
            text = prose(1, 4)
            return box(pick(PROSE), pick((text, f"<p>{text}</p>", f"&copy; {text}", f"<h3>{word()}</h3><p>{text}</p>")), 0)
        if kind < 0.88:
            return box(nameless(), pick((f"&copy; {sentence(2, 9)}", f"<p>&copy; {sentence(2, 9)}</p>", f'<a href="#">{word()}</a> | <a href="#">{word()} {word()}</a>')), 0)
        return box(("form", ""), f"<p>{sentence(3, 9)}</p><label>{word()}</label><input><button>{word()}</button>", 0)

    def remarks() -> str:
        """Reader comments: like boxes, each with who wrote it. Without a name they are two at least."""
        named = rng.random() < 0.7
        by = pick(("<b>{}</b>", '<span class="author">{}</span>', "<h4>{}</h4>", '<cite><a href="#">{}</a></cite>', "<p><b>{}</b></p>", "<b>{}</b> <i>3 h</i>"))
        each = pick(("<div>{}<p>{}</p></div>", '<div class="item">{}<p>{}</p></div>', "<article>{}<p>{}</p></article>", "<div>{}<div>{}</div></div>"))
        several = "".join(each.format(by.format(word()), "</p><p>".join(prose(1, 5) for _ in range(pick((1, 1, 1, 2, 3))))) for _ in range(int(rng.integers(1 if named else 2, 6))))
        ask = f"<h3>{word()} {word()}</h3>" if rng.random() < 0.4 else ""
        return box(pick(REMARKS) if named else nameless(), ask + several, 0)

    def body(titled: bool) -> str:
        title = f"<h1>{sentence(2, 9)}</h1>" if titled else ""
        out = [f"<header>{title}</header>" if rng.random() < 0.1 else f"<div>{title}</div>" if rng.random() < 0.1 else title] if titled else []
        style = rng.random()
        if style < 0.1:
            return "".join([*out, *(f"<div>{prose(1, 7)}</div>" for _ in range(int(rng.integers(1, 7))))])
        if style < 0.2:
            part = pick(("<section>{}</section>", "<div>{}</div>"))
            return "".join([*out, *(part.format(f"<h2>{sentence(1, 5)}</h2>" + "".join(f"<p>{prose(1, 7)}</p>" for _ in range(int(rng.integers(1, 4))))) for _ in range(int(rng.integers(1, 4))))])
        if style < 0.3:
            return "".join([*out, pick(("<div>{}</div>", '<div class="inner">{}</div>')).format("".join(f"<p>{prose(1, 7)}</p>" for _ in range(int(rng.integers(1, 7)))))])
        if style < 0.35:
            return "".join([*out, "<br><br>".join(prose(1, 7) for _ in range(int(rng.integers(1, 5))))])
        for _ in range(int(rng.integers(1, 7))):
            kind = rng.random()
            text = prose(1, 7)
            out.append(f"<p>{text}</p>" if kind < 0.6 else f"<h2>{sentence(1, 5)}</h2><p>{text}" if kind < 0.7 else f"<ul><li>{sentence(2, 9)}</li><li>{sentence(2, 9)}</li></ul>" if kind < 0.78 else f"<blockquote>{text}</blockquote>" if kind < 0.82 else f"<table>{''.join(f'<tr><td>{word()}</td><td>{word()}</td></tr>' for _ in range(int(rng.integers(1, 4))))}</table>" if kind < 0.84 else f"<p><b>{text}<br><p>{prose(1, 4)}</p>" if kind < 0.9 else aside())
        return "".join(out)

    made = []
    for _ in range(pages):
        named, titled = rng.random() < 0.6, rng.random() < 0.8
        more = lambda: box(nameless(), f"<p>{prose(1, 3)}</p>" if rng.random() < 0.5 else prose(1, 3), 0) if titled and rng.random() < 0.15 else aside()  # noqa: B023, E731
        before = "".join(more() for _ in range(int(rng.integers(1, 4))))
        after = "".join(more() for _ in range(int(rng.integers(1, 4))))
        said = remarks() if rng.random() < 0.5 else ""
        text = body(titled) + (said if rng.random() < 0.4 else "")
        around = nameless() if rng.random() < 0.2 else None
        said = "" if said in text else said
        if rng.random() < 0.1:
            before = after = ""
        kind = rng.random()
        if kind < 0.04:
            made.append(pick(('<span data-main="1">{}</span>', '<p data-main="1">{}</p>')).format(prose(1, 5)) + (f'<p data-main="1">{prose(1, 5)}</p>' if rng.random() < 0.6 else ""))
            continue
        if kind < 0.12:
            whole = f'{before}<h1 data-main="1">{sentence(2, 9)}</h1>{pick(("", after))}{box(pick(MAIN) if named else nameless(), body(False), 1)}{said}{after}'
        elif kind < 0.9:
            whole = f"{before}{box(pick(MAIN) if named else nameless(), text, 1)}{said}{after}"
        elif kind < 0.95:
            whole = f'{before}<table><tr><td data-main="0">{links()}</td><td data-main="1">{text}</td></tr></table>{said}{after}'
        else:
            made.append(f'<body data-main="1">{pick(("", before))}{text if rng.random() < 0.7 else prose(1, 5)}{pick(("", after))}')
            continue
        made.append(f"<html><head><title>{word()}</title></head><body>{f'<{around[0]} {around[1]}>{whole}</{around[0]}>' if around else whole}</body></html>")
    return made


class Extractor:
    def __init__(self, weights: dict[str, float], chain: Chain):
        self.weights, self.chain = weights, chain

    def scores(self, blocks: list[Block]) -> np.ndarray:
        """Emission scores; what open elements add is summed once for all blocks that share it."""
        get = self.weights.get
        shared: dict[int, float] = {}
        out = []
        for above, own in block_features(blocks):
            if id(above) not in shared:
                shared[id(above)] = get("", 0.0) + sum([get(n, 0.0) for n in above])
            out.append(shared[id(above)] + sum([get(n, 0.0) for n in own]))
        return np.array(out)

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html, known=self.weights)
        return " ".join(b.text for b, main in zip(blocks, self.chain.viterbi(self.scores(blocks)), strict=True) if main) if blocks else ""


@cache
def fit() -> Extractor:
    """An extractor learned from the labelled layouts."""
    number: dict[str, int] = {"": 0}
    items: dict[tuple[str, ...], int] = {}
    sequences, states = [], []
    for html in labelled_layouts():
        if blocks := leaf_blocks(html, "data-main"):
            sequences.append(np.array([items.setdefault(tuple(sorted([*above, *own])), len(items)) for above, own in block_features(blocks)]))
            states.append(np.array([b.label for b in blocks], np.float64))
    features = [(0, *(number.setdefault(n, len(number)) for n in names)) for names in items]
    chain = Chain(len(number)).fit(features, sequences, states, rounds=400, decay=1e-6)
    return Extractor({n: float(chain.w[k]) for n, k in number.items()}, chain)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(fit())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def begin():
        extractor = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            texts = [extractor.main_text(h) for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

        return work

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return in_batches(slim, schema, begin, 200)

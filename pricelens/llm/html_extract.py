"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

Every block element (and every inline element with a class, id or role) of a page is a row
of features: its tag and the tokens of its attributes (own, and of its ancestors), subtree
density (text, links, tags, paragraphs, controls below it), depth, and how it stands among
its siblings and in the page.  Boosted trees give each node the odds that it holds main
text.  Decoding picks, by one pass up and one down, the most likely labels under the rule
that a node may hold main text only if its parent does, so ancestors and descendants never
contradict each other.  The text that lies directly in nodes so labelled is the result:
character references decoded, white space inside a block one space, blocks in page order
joined by line ends.

The trees are trained on ``train_pages`` generated layouts (menus, headers, notices,
adverts, sidebars, forms, comments and footers around an article, named and unnamed,
sloppily closed now and then) that are filled with words of at most ``sample_pages`` pages of
the table itself (the smallest by a hash of their text): a bounded fit; extraction reads
every whole page.

Defined cases: null and empty pages, and pages without main text, give the empty text; a
page without any markup is one block of text; scripts, styles, templates, comments and the
head never give text; pages of any length are read whole; repeated rows give equal results.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty, text_sample
from pricelens.llm.dom import RAW, Node, parse
from pricelens.llm.gbt import Boosted, boost

#: never main text, wherever they stand; of all other elements the trees judge
NEVER = (RAW - {"xmp", "plaintext"}) | {"head", "template", "datalist"}
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source audio video track math svg object canvas map noscript".split())
CONTROLS = frozenset("input button select textarea option label fieldset form".split())

TAGS = [
    "article main", "section", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "table tbody tr td th thead tfoot",
    "blockquote pre figure figcaption", "nav", "header hgroup", "footer", "aside", " ".join(sorted(CONTROLS)), "div", "body html", "a",
]
TAG_GROUP = {t: k for k, group in enumerate(TAGS) for t in group.split()}

#: tokens of class, id, role and label attributes by what they tell
TOKENS = [
    "article content main post entry body story text news blog",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header head masthead top logo topbar brand hero",
    "footer foot bottom copyright legal colophon credits",
    "sidebar side aside rail widget related recommended trending popular more tags",
    "cookie cookies notice consent alert gdpr privacy popup modal overlay banner message warning toast",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion dfp adsense",
    "comment comments reply replies respond response responses disqus discussion feedback reviews",
    "share social follow twitter facebook like subscribe newsletter signup",
    "form search login register input button",
    "hidden none invisible",
]
TOKEN_GROUP = {t: k for k, group in enumerate(TOKENS) for t in group.split()}
#: tags that say the same as a token
TAG_TOKENS = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9}
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WIDTH = len(TAGS) + 1 + 2 * len(TOKENS) + 25


def _token_groups(node: Node) -> set[int]:
    found = set()
    if node.attributes:
        for m in ATTRIBUTE.finditer(node.attributes):
            value = m[1] or m[2] or m[3] or m[0]
            found |= {TOKEN_GROUP[w] for w in map(str.lower, WORD.findall(value)) if w in TOKEN_GROUP}
    if node.tag in TAG_TOKENS:
        found.add(TAG_TOKENS[node.tag])
    return found


class Page:
    """The nodes of a page that are judged, with their features."""

    def __init__(self, html: str):
        nodes = parse(html)
        self.root = nodes[0]
        self.number: dict[int, int] = {}  # id of a node -> its row
        self.rows: list[Node] = []
        self.up: list[int] = []
        self._below(self.root, -1)
        self._count()

    def _below(self, root: Node, parent: int) -> None:
        stack = [(root, parent)]
        while stack:
            node, above = stack.pop()
            if node.tag in NEVER:
                continue
            judged = node.tag not in INLINE or (node.attributes and ATTRIBUTE.search(node.attributes) is not None)
            if judged:
                self.number[id(node)] = above_here = len(self.rows)
                self.rows.append(node)
                self.up.append(above)
            else:
                above_here = above
            stack += [(c, above_here) for c in reversed(node.content) if isinstance(c, Node)]

    def _count(self) -> None:
        """Own counts of every row, then sums over subtrees (children follow parents)."""
        n = len(self.rows)
        own = np.zeros((n, 8))  # text, link text, marks, words, elements, paragraphs, links, controls
        self.before = np.zeros(n)
        seen = 0.0
        stack: list = [(self.root, 0, False)]
        while stack:
            node, row, linked = stack.pop()
            if isinstance(node, str):
                text = len(node) - node.count(" ") if node.strip() else 0
                if text:
                    own[row, 0] += text
                    own[row, 1] += text * linked
                    own[row, 2] += sum(map(node.count, ".,!?;:"))
                    own[row, 3] += node.count(" ") + 1
                    seen += text
                continue
            if node.tag in NEVER:
                continue
            if id(node) in self.number:
                row = self.number[id(node)]
                self.before[row] = seen
            own[row, 4] += 1
            own[row, 5] += node.tag == "p"
            own[row, 6] += node.tag == "a"
            own[row, 7] += node.tag in CONTROLS
            linked = linked or node.tag == "a"
            stack += [(c, row, linked) for c in reversed(node.content)]
        self.own = own
        self.sums = own.copy()
        for k in range(n - 1, 0, -1):
            self.sums[self.up[k]] += self.sums[k]

    def features(self) -> np.ndarray:
        n = len(self.rows)
        up = np.array(self.up)
        x = np.zeros((n, WIDTH))
        groups = np.zeros((n, len(TOKENS)), bool)
        for k, node in enumerate(self.rows):
            x[k, TAG_GROUP.get(node.tag, len(TAGS))] = 1
            groups[k, list(_token_groups(node))] = True
        above = np.zeros_like(groups)
        depth = np.zeros(n)
        for k in range(1, n):
            above[k] = above[up[k]] | groups[up[k]]
            depth[k] = depth[up[k]] + 1
        at = len(TAGS) + 1
        x[:, at : at + len(TOKENS)] = groups
        at += len(TOKENS)
        x[:, at : at + len(TOKENS)] = above
        at += len(TOKENS)
        parent = np.maximum(up, 0)
        s, own = self.sums, self.own
        total = max(s[0, 0], 1)
        text = s[:, 0]
        children = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
        place = np.zeros(n)
        tag = {}
        same = np.zeros(n)
        met: dict[int, int] = {}
        for k in range(1, n):
            place[k] = met[up[k]] = met.get(up[k], 0) + 1
            key = (up[k], self.rows[k].tag)
            tag[key] = tag.get(key, 0) + 1
        for k in range(1, n):
            same[k] = tag[(up[k], self.rows[k].tag)]
        named = groups[:, 0].any()
        columns = [
            np.log1p(text), np.log1p(own[:, 0]), s[:, 1] / np.maximum(text, 1), s[:, 2] / np.maximum(text, 1), text / np.maximum(s[:, 3], 1),
            np.log1p(s[:, 3]), s[:, 4] / np.maximum(text, 1), np.log1p(s[:, 5]), np.log1p(s[:, 6]), np.log1p(s[:, 7]), text / total,
            depth, children, children[parent], place, place / np.maximum(children[parent], 1), same / np.maximum(children[parent], 1),
            self.before / total, (self.before + text) / total, np.log1p(text[parent]), text / np.maximum(text[parent], 1),
            s[parent, 1] / np.maximum(text[parent], 1), np.log1p(own[parent, 0]), np.log1p(s[parent, 5]), np.full(n, float(named)),
        ]
        x[:, at:] = np.stack(columns, axis=1)
        return x

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Most likely labels such that a node holds main text only if its parent does."""
        yes = -np.logaddexp(0, -odds)
        no = -np.logaddexp(0, odds)
        for k in range(len(odds) - 1, 0, -1):
            yes[self.up[k]] += max(yes[k], no[k])
            no[self.up[k]] += no[k]
        label = np.zeros(len(odds), bool)
        for k in range(len(odds)):
            label[k] = (k == 0 or label[self.up[k]]) and yes[k] > no[k]
        return label

    def text(self, label: np.ndarray) -> str:
        blocks: list[str] = []
        held: list[str] = []

        def close() -> None:
            block = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if block:
                blocks.append(block)

        stack: list = [(self.root, 0)]
        while stack:
            item, row = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                if label[row]:
                    held.append(item)
            elif item.tag == "br":
                held.append(" ")
            elif item.tag not in NEVER:
                row = self.number.get(id(item), row)
                if item.tag not in INLINE:
                    close()
                    stack.append((None, row))
                stack += [(c, row) for c in reversed(item.content)]
        close()
        return "\n".join(blocks)


def extract(model: Boosted, pages: list[str]) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    held: list[Page] = []

    def emit() -> None:
        odds = model.log_odds(np.concatenate([page.features() for page in held]))
        at = 0
        for page in held:
            n = len(page.rows)
            # a page without elements to judge is a block of text
            out.append(page.text(page.decode(odds[at : at + n]) if n > 1 else np.ones(1, bool)))
            at += n
        held.clear()

    for html in pages:
        held.append(Page(html))
        if sum(len(page.rows) for page in held) > 5_000:
            emit()
    if held:
        emit()
    return out


class Layouts:
    """Generated pages whose main text is known: blocks of it carry ``data-gold``."""

    def __init__(self, words: list[str], seed: int = 11):
        self.words, self.r = words, random.Random(seed)

    def line(self, least: int, most: int) -> str:
        r = self.r
        n = r.randint(least, most)
        out = r.choices(self.words, k=n)
        for k in range(n):
            if r.random() < 0.08 and k + 1 < n:
                out[k] += r.choice([",", ".", ";", "."])
        return " ".join(out).capitalize() + (r.choice([".", ".", ".", "!", "?", ""]) if n > 2 else "")

    def name(self, group: int, chance: float = 0.75) -> str:
        """A class or id out of a token group, or one that tells nothing, or none."""
        r = self.r
        x = r.random()
        if x < chance:
            value = r.choice(TOKENS[group].split())
            value = r.choice([value, f"{value}-{r.choice('box wrap inner list block area'.split())}", f"site-{value}", f"{value}{r.randint(1, 9)}"])
        elif x < chance + 0.1:
            value = r.choice(["x", "c", "el", "row", "col", "block", "box", "wrap"]) + r.choice(["", "-1", "2"])
        else:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def links(self, least: int, most: int) -> str:
        r = self.r
        found = [f'<a href="/{r.choice(self.words)}">{self.line(1, 3)}</a>' for _ in range(r.randint(least, most))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}" + ("</li>" if r.random() < 0.9 else "") for a in found) + "</ul>"
        return r.choice([" | ", " ", ""]).join(found)

    def some(self, least: int, most: int) -> str:
        """A little text, as adverts, notices and footers have."""
        tag = self.r.choice(["p", "p", "span", "div", ""])
        text = self.line(least, most)
        return f"<{tag}>{text}</{tag}>" if tag else text

    def nav(self) -> str:
        r = self.r
        tag = r.choice(["nav", "nav", "div", "div", "ul"])
        inner = self.links(3, 12)
        return f"<{tag}{self.name(1, 0.4 if tag == 'nav' else 0.85)}>{inner}</{tag}>"

    def header(self) -> str:
        r = self.r
        tag = r.choice(["header", "header", "div"])
        inner = [f'<a href="/">{self.line(1, 3)}</a>', self.some(2, 8), self.nav(), self.form()]
        r.shuffle(inner)
        return f"<{tag}{self.name(2, 0.3 if tag == 'header' else 0.9)}>{''.join(inner[: r.randint(1, 4)])}</{tag}>"

    def form(self) -> str:
        r = self.r
        fields = "".join(r.choice(['<input type="text" name="q">', f"<label>{self.line(1, 3)}</label>", f"<select><option>{self.line(1, 1)}<option>{self.line(1, 2)}</select>", "<textarea>x</textarea>"]) for _ in range(r.randint(1, 4)))
        return f'<form action="/s"{self.name(9, 0.5)}>{r.choice(["", f"<p>{self.line(3, 14)}</p>"])}{fields}<button>{self.line(1, 2)}</button></form>'

    def notice(self) -> str:
        r = self.r
        inner = "".join(self.some(4, 30) for _ in range(r.randint(1, 2))) + r.choice(["", f"<button>{self.line(1, 2)}</button>"])
        tag = r.choice(["div", "div", "section", "aside", "p"])
        return f"<{tag}{self.name(5, 0.92)}>{inner if tag != 'p' else self.line(4, 30)}</{tag}>"

    def advert(self) -> str:
        r = self.r
        tag = r.choice(["div", "div", "div", "aside", "section", "p", "span"])
        inner = self.line(3, 25) if tag in ("p", "span") or r.random() < 0.6 else "".join(self.some(3, 20) for _ in range(r.randint(1, 3)))
        return f"<{tag}{self.name(6, 0.96)}>{inner}</{tag}>"

    def share(self) -> str:
        inner = self.r.choice([self.links(2, 5), self.some(1, 4), self.line(1, 2), f"<button>{self.line(1, 2)}</button>"])
        return f"<div{self.name(8, 0.95)}>{inner}</div>"

    def side(self) -> str:
        r = self.r
        tag = r.choice(["aside", "aside", "div", "section"])
        parts = [f"<h3>{self.line(1, 4)}</h3>{self.links(2, 8)}", f"<h4>{self.line(1, 4)}</h4><p>{self.line(4, 25)}</p>", self.advert(), self.form()]
        r.shuffle(parts)
        return f"<{tag}{self.name(4, 0.3 if tag == 'aside' else 0.92)}>{''.join(parts[: r.randint(1, 4)])}</{tag}>"

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<{(t := r.choice(['div', 'li', 'article']))}{self.name(7, 0.7)}><b>{self.line(1, 2)}</b><p>{self.line(3, 50)}</p>{r.choice(['', '<a href=/r>' + self.line(1, 1) + '</a>'])}</{t}>"
        tag = r.choice(["section", "div", "div", "ol"])
        return f"<{tag}{self.name(7, 0.97)}><h3>{self.line(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}{r.choice(['', self.form()])}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(["footer", "footer", "div"])
        inner = r.choice(["&copy; ", ""]) + self.line(2, 12) + r.choice(["", self.links(2, 10), " &middot; " + self.line(2, 8), self.some(5, 25)])
        return f"<{tag}{self.name(3, 0.3 if tag == 'footer' else 0.92)}>{inner}</{tag}>"

    def block(self) -> str:
        r = self.r
        x = r.random()
        text = self.line(1, 6) if r.random() < 0.2 else " ".join(self.line(3, 25) for _ in range(r.randint(1, 12)))
        if r.random() < 0.1:  # junk that an article may hold
            text = " ".join(w + r.choice(["%%%", "***", "$$$", "&amp;&amp;&amp;", " |", "!!"]) for w in text.split())
        if r.random() < 0.2:
            text += f' <a href="/{r.choice(self.words)}">{self.line(1, 4)}</a> {self.line(1, 6)}'
        if x < 0.68:
            return f"<p data-gold=1>{text}" + ("</p>" if r.random() < 0.93 else "")
        if x < 0.76:
            return f"<p data-gold=1><b>{self.line(2, 14)}<br>"
        if x < 0.84:
            return f"<h{(n := r.randint(2, 4))} data-gold=1>{self.line(1, 8)}</h{n}>"
        if x < 0.89:
            return "<ul>" + "".join(f"<li data-gold=1>{self.line(1, 20)}</li>" for _ in range(r.randint(1, 8))) + "</ul>"
        if x < 0.92:
            return f"<blockquote><p data-gold=1>{text}</p></blockquote>"
        if x < 0.94:
            return f"<pre data-gold=1>{text}</pre>"
        if x < 0.96:
            return "<table>" + "".join(f"<tr><td data-gold=1>{self.line(1, 6)}<td data-gold=1>{self.line(1, 6)}" for _ in range(r.randint(1, 5))) + "</table>"
        if x < 0.98:
            return f'<figure><img src="/i"><figcaption data-gold=1>{self.line(2, 15)}</figcaption></figure>'
        return f"<div data-gold=1>{text}</div>"

    def article(self) -> str:
        r = self.r
        title = f"<h1 data-gold=1>{self.line(1, 14)}</h1>" if r.random() < 0.85 else ""
        if title and r.random() < 0.2:
            title = f"<header>{title}</header>"
        body = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20]))]
        for extra, chance in ((self.advert, 0.2), (self.share, 0.15), (self.side, 0.06), (self.notice, 0.05), (self.form, 0.06)):
            if r.random() < chance:
                body.insert(r.randint(0, len(body)), extra())
        inner = "".join(body)
        if r.random() < 0.25:
            inner = f"<div{self.name(0, 0.6)}>{inner}</div>"
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        out = f"<{tag}{self.name(0, 0.25 if tag in ('article', 'main') else 0.8)}>{title}{inner}</{tag}>"
        return f"<main>{out}</main>" if r.random() < 0.15 and tag != "main" else out

    def page(self) -> str:
        r = self.r
        top = [f() for f, chance in ((self.header, 0.5), (self.nav, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.1)) if r.random() < chance]
        r.shuffle(top)
        middle = [self.article()]
        for f, chance in ((self.side, 0.35), (self.nav, 0.08), (self.advert, 0.15)):
            if r.random() < chance:
                middle.insert(r.choice([0, len(middle)]), f())
        low = [f() for f, chance in ((self.comments, 0.3), (self.side, 0.1), (self.share, 0.1), (self.advert, 0.12), (self.footer, 0.8), (self.notice, 0.1)) if r.random() < chance]
        inside = "".join(middle)
        if r.random() < 0.3:
            inside = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container', ' class=row'])}>{inside}</div>"
        body = "".join(top) + inside + "".join(low)
        if r.random() < 0.25:
            body = f"<div{r.choice(['', ' class=site', ' id=root', ' class=container'])}>{body}</div>"
        head = f"<head><title>{self.line(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def _gold(page: Page) -> np.ndarray:
    label = np.array(["data-gold" in node.attributes for node in page.rows])
    for k in range(len(label) - 1, 0, -1):
        label[page.up[k]] |= label[k]
    return label


MARKUP = re.compile(r"<(script|style)\b.*?</\1|<!--.*?-->|<[^>]*>", re.S | re.I)


def fit(sample: list[str], train_pages: int = 500) -> Boosted:
    """Trees from generated layouts that are filled with the sample pages' words."""
    words = [w for page in sample for w in references.unescape(MARKUP.sub(" ", page)).split() if len(w) < 25 and "<" not in w and "&" not in w]
    layouts = Layouts(words[:200_000] or ["the", "of", "and"])
    pages = [Page(layouts.page()) for _ in range(train_pages)]
    x = np.concatenate([page.features() for page in pages])
    y = np.concatenate([_gold(page) for page in pages]).astype(float)
    return boost(x, y, trees=50, depth=5)


def train(df: DataFrame, html_col: str = "html", sample_pages: int = 60, sample_chars: int = 20_000, train_pages: int = 500) -> Boosted:
    """Trees for the pages of ``df``; reads at most ``sample_chars`` of ``sample_pages``."""
    sample = text_sample(df.select(text_or_empty(df, html_col).alias("t")), "t", sample_pages, sample_chars)
    return fit(sample, train_pages)


def main_text(df: DataFrame, model: Boosted, html_col: str = "html") -> Column:
    """Column with the main text of each whole page."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(extract(shared.value, batch.to_pylist()), pa.string())

    return read(text_or_empty(df, html_col))


def extract_pages(df: DataFrame, model: Boosted, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: its id and ``main_text``."""
    return df.select(df[id_col], main_text(df, model, html_col).alias("main_text"))

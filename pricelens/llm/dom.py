"""A lenient HTML reader: a tree of elements and texts out of any string.

Unclosed, misnested and unknown tags are taken as browsers do in the common cases: void
elements have no content, paragraphs, list items, table parts and options end where the
next one starts, an end tag closes up to its element or is skipped, and what is open at the
end of the page ends there.  Raw text (scripts, styles) and comments hold no markup."""

from __future__ import annotations

import re
from collections import Counter

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul "
    "caption colgroup legend option optgroup select head title script style template noscript iframe textarea".split()
)
#: a start tag of the key ends an open element of the value, unless a border is in between
ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("table", "tr")),
    "th": ("td th", ("table", "tr")),
    "tbody": ("tr td th thead tbody tfoot caption colgroup", ("table",)),
    "tfoot": ("tr td th thead tbody tfoot", ("table",)),
    "option": ("option", ("select", "datalist", "optgroup")),
    "optgroup": ("option optgroup", ("select",)),
    "body": ("head", ("html",)),
}
ENDS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in ENDS.items()}
NO_P = BLOCK - {"html", "body", "head", "title", "script", "style", "template", "noscript", "iframe", "textarea", "option", "optgroup", "select", "legend", "caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_BORDER = frozenset("html body table td th caption button object template".split())
#: what a start tag may end: an open element of these tags within these borders
GROUPS = [(frozenset(("p",)), P_BORDER), *dict.fromkeys(ENDS.values())]
GROUP_OF = {tag: GROUPS.index(rule) for tag, rule in ENDS.items()}
MARKS = {t: ([g for g, (tags, _) in enumerate(GROUPS) if t in tags], [g for g, (_, borders) in enumerate(GROUPS) if t in borders]) for t in frozenset().union(*[a | b for a, b in GROUPS])}

#: a quote counts only where a value begins, behind "="; nothing is tried twice
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>", re.S)
MARKUP = re.compile(r"<[!?]")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
LOOSE_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|" + LOOSE.pattern, re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


class Node:
    """An element; ``content``: its texts (str, character references not decoded) and elements."""

    __slots__ = ("tag", "attributes", "parent", "content", "depth", "near")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.content: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        #: by group, the nearest open element that a start tag may end from here
        self.near = parent.near if parent else (None,) * len(GROUPS)
        if tag in MARKS:
            near = list(self.near)
            for g in MARKS[tag][1]:
                near[g] = None
            for g in MARKS[tag][0]:
                near[g] = self
            self.near = tuple(near)


def parse(html: str) -> list[Node]:
    """The page's elements in page order; the first is a root that holds all.  Work grows with
    the page's length, whatever is broken in it: where a tag finds no end outside quotes, quotes
    count no more from there on."""
    root = at = Node("", "", None)
    nodes, place, end = [root], 0, len(html)
    last, token = html.rfind(">"), TOKEN
    opened: Counter[str] = Counter()

    def closed_to(up: Node) -> Node:
        here = at
        while here is not up:
            opened[here.tag] -= 1
            here = here.parent
        return up

    while place < end:
        lt = html.find("<", place)
        if lt > last:  # no tag ends any more, only a comment may follow
            mark = MARKUP.search(html, lt)
            lt = mark.start() if mark else -1
        if lt < 0:
            at.content.append(html[place:])
            break
        if lt > place:
            at.content.append(html[place:lt])
        m = token.match(html, lt)
        if not m and token is TOKEN and (m := LOOSE.match(html, lt)):
            token = LOOSE_TOKEN
        if not m:  # a lone "<" is text
            at.content.append("<")
            place = lt + 1
            continue
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = closed_to(up.parent)
            continue
        if tag in NO_P:
            at = closed_to(_ended(at, 0))
        if tag in GROUP_OF:
            at = closed_to(_ended(at, GROUP_OF[tag]))
        node = Node(tag, m[3], at)
        at.content.append(node)
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, place) if tag != "plaintext" else None
            node.content.append(html[place : close.start() if close else end])
            place = close.start() if close else end
            if close:
                gt = html.find(">", place)
                place = gt + 1 if gt >= 0 else end
            continue
        if not m[3].endswith("/") or tag in BLOCK or tag not in ("svg", "path", "use", "circle", "rect", "g", "line"):
            at = node
            opened[tag] += 1
    return nodes


def _ended(at: Node, group: int) -> Node:
    """The place after ending the nearest open element of the group, and those right around it."""
    if at.near[group] is not None:
        at = at.near[group].parent
        while at.tag in GROUPS[group][0]:
            at = at.parent
    return at

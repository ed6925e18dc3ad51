"""A small DOM of a page: block elements and runs of text, in page order, with what the node features need."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape

import numpy as np

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math head title textarea select option button iframe object canvas audio video map".split())
RAW = frozenset("script style textarea title".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())  # what may stand in head
NESTED = frozenset("svg math template object".split())  # of the dropped elements, those that may hold their own kind
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY = {  # an open element of the key ends when one of the value begins
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "p": BLOCKS - {"html", "body", "tbody", "tfoot", "thead", "tr", "td", "th", "caption"},
}
_STOPS = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "p": frozenset(["td", "th", "table", "div", "li", "section", "article", "blockquote", "body", "form", "aside", "main", "header", "footer"])}

TAGS = ("article", "main", "section", "div", "p", "h", "ul", "li", "td", "blockquote", "pre", "nav", "header", "footer", "aside", "form", "figure", "#text")
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)} | {
    "ol": TAGS.index("ul"), "dl": TAGS.index("ul"), "menu": TAGS.index("nav"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "th": TAGS.index("td"),
    "figcaption": TAGS.index("figure"), "fieldset": TAGS.index("form"), "body": len(TAGS), "html": len(TAGS),
}
GROUPS = {
    "content": "content article post entry story body text main blog news page",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs crumbs pagination pager toc tabs links skip",
    "header": "header masthead topbar top logo branding title hero",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget rail secondary complementary",
    "advert": "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner teaser outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog message warning disclaimer",
    "comment": "comment comments reply replies discussion disqus respond response reader feedback",
    "share": "share social sharing follow twitter facebook tags tag meta byline author date related recommended more similar",
    "form": "form search newsletter subscribe signup login contact input",
    "hidden": "hidden none",
}
_GROUP_OF = {w: i for i, words in enumerate(GROUPS.values()) for w in words.split()}
_HIDDEN = list(GROUPS).index("hidden")


@lru_cache(maxsize=65_536)
def attribute_groups(attributes: str) -> tuple[int, int]:
    """Bits of the word groups that class, id, role and style name; the label of a training page (-1: none)."""
    bits, label = 0, -1
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                group = _GROUP_OF.get(word, _GROUP_OF.get(word.rstrip("s"), -1))
                if group >= 0:
                    bits |= 1 << group
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            bits |= 1 << _HIDDEN
        elif name == "data-y" and value in ("0", "1"):
            label = int(value)
    return bits, label


class _Closed:
    """Is an element that begins at a place closed later? One that cannot hold its own kind must be before the next begins."""

    def __init__(self, html: str):
        self.html, self.places = html, {}

    def __call__(self, name: str, position: int) -> bool:
        if name not in self.places:
            found = [(m.start(), m[1]) for m in re.finditer(rf"<(/?){name}(?=[\s/>])", self.html, re.I)]
            self.places[name] = [p for p, x in found if not x], [p for p, x in found if x]
        begins, ends = self.places[name]
        end = bisect_left(ends, position)
        if end == len(ends):
            return False
        begin = bisect_left(begins, position)
        return name in NESTED or begin == len(begins) or ends[end] < begins[begin]


class Page:
    """A dropped element (a button, say) that is not closed ends where a block begins or ends; ``head`` also at the first tag
    or text that cannot stand in it; any of them with the block around it.

    Nodes in page order; node 0 is the page. Of each: parent, end of its subtree, depth, tag, groups of its own and of
    all above, label, and for runs of text the text, its link characters and whether it is the first of its block."""

    __slots__ = ("parent", "end", "depth", "tag", "groups", "above", "label", "text", "linked")

    def __init__(self, html: str):
        self.parent, self.end, self.depth, self.tag = [-1], [0], [0], [len(TAGS)]
        self.groups, self.above, self.label, self.text, self.linked = [0], [0], [-1], [""], [0]
        names, nodes = ["#page"], [0]  # open block elements
        run: list[str] = []
        linked, link, dropped, inner, loose = 0, 0, [], [], False  # inner: blocks opened in what is dropped
        closed = _Closed(html)
        position, size = 0, len(html)

        def flush():
            nonlocal run, linked
            if run:
                text = _SPACE.sub(" ", unescape("".join(run))).strip()
                if text:
                    at = nodes[-1]
                    self._add(at, TAGS.index("#text"), 0, self.label[at])
                    self.text[-1], self.linked[-1] = text, min(linked, len(text))
                run, linked = [], 0

        def close(to: int):
            nonlocal link
            flush()
            for at in nodes[to:]:
                self.end[at] = len(self.parent)
            del names[to:], nodes[to:]
            link = 0

        while position < size:
            match = _TOKEN.search(html, position)
            begin = match.start() if match else size
            if dropped == ["head"] and html[position:begin].strip():
                dropped = []
            if begin > position and not dropped:
                piece = html[position:begin]
                if match is None and (cut := piece.rfind("<")) >= 0 and re.match(r"<[a-zA-Z/!]", piece[cut:]):
                    piece = piece[:cut]  # markup that the page's end cuts off
                if piece:
                    run.append(piece)
                    if link:
                        linked += len(piece)
            if match is None:
                break
            position = match.end()
            slash, name, attributes = match.groups()
            if name is None:
                continue
            name = name.lower()
            if dropped == ["head"] and not slash and name not in HEAD:
                dropped = []
            if name in DROPPED:
                if slash:
                    if name in dropped:
                        del dropped[len(dropped) - 1 - dropped[::-1].index(name) if name in NESTED else dropped.index(name) :]
                        if not dropped:
                            inner, loose = [], False
                elif not attributes.endswith("/"):
                    if name in RAW:
                        ends = re.compile(rf"</{name}\s*>", re.I).search(html, position)
                        position = ends.end() if ends else size
                    elif name != "option":
                        sure = name == "head" or closed(name, position)
                        if sure or not dropped:
                            dropped.append(name)
                            loose = not sure
                continue
            if dropped:
                block = name in BLOCKS
                if block and slash and name in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(name) :]
                elif block and not slash and not loose and name != "body":
                    inner.append(name)
                if name == "body" or block and (loose or slash and name in names and name not in inner):
                    dropped, inner, loose = [], [], False
                else:
                    continue
            if name == "a":
                link = 0 if slash else 1
            elif name == "br":
                run.append(" ")
            elif name in BLOCKS:
                if slash:
                    if name in names:
                        close(len(names) - 1 - names[::-1].index(name))
                    else:
                        flush()
                    continue
                flush()
                for open_ in range(len(names) - 1, 0, -1):
                    if name in _CLOSED_BY.get(names[open_], ()):
                        close(open_)
                        break
                    if any(names[open_] in _STOPS[k] for k, v in _CLOSED_BY.items() if name in v):
                        break
                if name in VOID:
                    continue
                bits, label = attribute_groups(attributes)
                at = nodes[-1]
                self._add(at, _TAG_OF.get(name, len(TAGS)), bits, self.label[at] if label < 0 else label)
                names.append(name)
                nodes.append(len(self.parent) - 1)
        close(0)

    def _add(self, parent: int, tag: int, bits: int, label: int) -> None:
        self.parent.append(parent)
        self.end.append(len(self.parent))
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.groups.append(bits)
        self.above.append(self.above[parent] | self.groups[parent])
        self.label.append(label)
        self.text.append("")
        self.linked.append(0)


FEATURES = (
    *(f"tag_{t}" for t in TAGS), "tag_other", *(f"own_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS), *(f"below_{g}" for g in GROUPS),
    "tag_above_article", "tag_above_negative", "tag_below_negative", "depth", "chars", "words", "stops", "link_share", "chars_per_node", "words_per_text", "stops_per_word", "texts", "page_share", "siblings",
    "sibling_place", "same_tag_siblings", "begin", "parent_link_share",
)
_NEGATIVE = [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form")]


def features(pages: list[Page]) -> np.ndarray:
    """One row a node of all pages, in order. Subtree sums come from running sums, as subtrees are contiguous."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    parent = np.maximum(flat("parent"), 0) + base
    end = np.where(flat("parent") < 0, np.repeat(sizes, sizes), flat("end")) + base
    tag, own, above, depth, linked = (flat(x) for x in ("tag", "groups", "above", "depth", "linked"))
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts])
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts])
    n = len(tag)
    here = np.arange(n)

    def below(x):
        total = np.concatenate([[0], np.cumsum(x)])
        return (total[end] - total[here]).astype(float)

    out = np.zeros((n, len(FEATURES)), np.float32)
    col = 0
    for t in range(len(TAGS) + 1):
        out[:, col] = tag == t
        col += 1
    bit = [(own >> g) & 1 for g in range(len(GROUPS))]
    for x in bit:
        out[:, col] = x
        col += 1
    for g in range(len(GROUPS)):
        out[:, col] = (above >> g) & 1
        col += 1
    for x in bit:
        out[:, col] = below(x) - x > 0
        col += 1
    negative = np.isin(tag, _NEGATIVE)

    def covered(some):
        """Does the subtree of one of these nodes hold this one?"""
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, here[some] + 1, 1)
        np.add.at(cover, end[some], -1)
        return np.cumsum(cover[:n]) > 0

    all_chars, all_words, all_stops, all_links = below(chars), below(words), below(stops), below(linked)
    count, runs = (end - here).astype(float), below(tag == TAGS.index("#text"))
    page_chars = np.repeat(all_chars[np.cumsum(sizes) - sizes], sizes)
    link_share = all_links / np.maximum(all_chars, 1)
    kids = np.bincount(parent, minlength=n)
    order = np.lexsort([here, parent])
    first = np.searchsorted(parent[order], parent[order], "left")
    place = np.empty(n)
    place[order] = np.arange(n) - first
    _, inverse, counts = np.unique(parent * 64 + tag, return_inverse=True, return_counts=True)
    same = counts[inverse]
    before = np.concatenate([[0], np.cumsum(chars)])
    begin = (before[here] - before[base]) / np.maximum(page_chars, 1)
    for x in (
        covered(tag <= TAGS.index("main")), covered(negative), below(negative) - negative > 0, depth, np.log1p(all_chars), np.log1p(all_words), np.log1p(all_stops), link_share, all_chars / count, all_words / np.maximum(runs, 1),
        all_stops / np.maximum(all_words, 1), np.log1p(runs), all_chars / np.maximum(page_chars, 1), np.minimum(kids[parent], 50), place / np.maximum(kids[parent], 1), np.minimum(same, 50), begin, link_share[parent],
    ):
        out[:, col] = x
        col += 1
    return out


def decode(page: Page, p: np.ndarray) -> list[int]:
    """Nodes of the runs of text that belong to the article. Every node is kept whole, dropped whole, or (as its own class
    says no) left to its children; the likeliest consistent choice wins, so no kept node lies under a dropped one."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    n = len(page.parent)
    end = np.array(page.end)
    end[0] = n
    sums = np.concatenate([[0.0], np.cumsum(yes)]), np.concatenate([[0.0], np.cumsum(no)])
    here = np.arange(n)
    keep, drop = (sums[0][end] - sums[0][here]).tolist(), (sums[1][end] - sums[1][here]).tolist()
    split = no.tolist()
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        leaf = page.end[i] == i + 1 and i > 0
        best[i] = max(keep[i], drop[i]) if leaf else max(keep[i], drop[i], split[i])
        if i:
            split[page.parent[i]] += best[i]
    out, i = [], 0
    while i < n:
        if best[i] == keep[i]:
            out += [j for j in range(i, int(end[i])) if page.text[j]]
            i = int(end[i])
        elif best[i] == drop[i]:
            i = int(end[i])
        else:
            i += 1
    return out

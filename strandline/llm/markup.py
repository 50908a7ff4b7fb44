"""Pages as trees, and union-free expressions over them: what operator 11 does with one page or two wrappers.

An expression is a list of items ``[key, flags, children]``; the key of an element is its tag with id, classes and
role, that of a text slot ``#``, and that of a group the keys of its items in brackets. Flags say whether an item may be
missing and whether it may repeat. A text slot has, instead of children, what is known of its texts:
``[pages, least hash, greatest hash, code points, of them in links]``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from html import unescape

OPTIONAL, REPEATED = 1, 2
SLOT = "#"
#: Elements below this depth are blocks of the element at it.
DEPTH = 150
#: The longest group of different items that is seen to repeat.
PERIOD = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes plaintext".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead title tr ul xmp".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose text is no part of an article.
ASIDE = frozenset("nav footer aside form script style noscript template button select textarea iframe svg math object audio video canvas head title menu dialog datalist noembed noframes".split())
#: Words of ids and classes that name such parts.
HINTS = frozenset(
    "nav navbar navigation menu menus menubar masthead footer footers sidebar sidebars ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos "
    "promotion banner banners cookie cookies consent gdpr notice notices popup popups modal newsletter subscribe subscription comment comments disqus reply replies respond share sharing "
    "social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar search login signup widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of ids and classes that name the main part where no element does.
MAIN = frozenset("content article articlebody post entry story main maincontent".split())
#: Which open elements a new one ends, and within which element they are looked for.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
INSIDE = frozenset("caption dd dt head html body li option optgroup legend summary tbody td tfoot th thead title tr select".split())  # blocks that end no paragraph

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|"
    r"<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|[^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_NAMING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: its key, whether it is a block, its children (nodes, ``(text, in_link)`` pairs and None for a break)."""

    __slots__ = ("block", "children", "key")

    def __init__(self, key: str, block: bool):
        self.key, self.block, self.children = key, block, []


def named(tag: str, attrs: str) -> str:
    """The key of an element: numbers of ids and long ones of classes don't count, and a hidden one is marked."""
    if not attrs or not _NAMING.search(attrs):
        return tag
    got: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    key = tag
    for name, sign in (("id", ":"), ("class", "."), ("role", "@"), ("itemprop", "~")):
        if name in got:
            key += "".join(sign + x for x in sorted(set(re.sub(r"\d+" if name == "id" else r"\d{3,}", "0", unescape(got[name])).split())))
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(got.get("style", ""))
    return key + "!" if hidden else key


_parts: dict[str, tuple[str, frozenset[str], frozenset[str], bool]] = {}


def parts(key: str) -> tuple[str, frozenset[str], frozenset[str], bool]:
    """Tag, words of ids and classes, roles, and whether it is hidden."""
    if key not in _parts:
        if len(_parts) > 100_000:
            _parts.clear()
        tag, *rest = re.split(r"(?=[:.@~!])", key)
        words = {w.lower() for x in rest if x[0] in ":.~" for w in _WORD.findall(x)}
        _parts[key] = tag, frozenset(words), frozenset(x[1:].lower() for x in rest if x[0] == "@"), key.endswith("!")
    return _parts[key]


def is_aside(key: str, inside: bool) -> bool:
    """Whether an element is no part of an article. In an article a header may hold its title."""
    tag, words, roles, hidden = parts(key)
    if tag in ASIDE or hidden:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "header" or "header" in words:
        return not inside
    return bool(roles & ROLES or words & HINTS)


def parse(page: str) -> Node:
    """The tree of a page, in one pass; ends that are missing are implied, those without a beginning are nothing."""
    root = Node("", True)
    stack: list[tuple[str, Node]] = [("", root)]
    count: Counter[str] = Counter()
    link = False

    def pop() -> None:
        tag, node = stack.pop()
        count[tag] -= 1
        if node is stack[-1][1]:
            node.children.append(None)

    def close(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        at = len(stack) - 1
        while at and stack[at][0] not in tags:
            if stack[at][0] in within:
                return
            at -= 1
        while at and len(stack) > at:
            pop()

    def text(raw: str) -> None:
        if raw:
            stack[-1][1].children.append((raw, link))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag == "a":
                link = False
            elif tag == "br":
                text(" ")
            elif count[tag] > 0:
                close((tag,))
                link = False
        elif m["tag"]:
            tag, attrs = m["tag"].lower(), m["attrs"] or ""
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK or tag == "hr":
                link = False
                if count["p"] > 0 and tag not in INSIDE:
                    close(("p",), ("td", "th", "button", "caption"))
                if tag in ENDS and any(count[t] > 0 for t in ENDS[tag][0]):
                    close(*ENDS[tag])
            if tag == "hr":
                stack[-1][1].children.append(None)
            elif tag == "a":
                link = True
            if tag in VOID:
                continue
            key = named(tag, attrs)
            if tag in BLOCK or is_aside(key, True):
                if len(stack) <= DEPTH:
                    node = Node(key, tag in BLOCK)
                    stack[-1][1].children.append(node)
                else:
                    node = stack[-1][1]
                    node.children.append(None)
                if tag in RAW:
                    end = _RAW_END[tag].search(page, at) if tag != "plaintext" else None
                    until = end.start() if end else size
                    node.children.append((page[at:until], False))
                    if node is stack[-1][1]:
                        node.children.append(None)
                    close_at = page.find(">", until)
                    at = close_at + 1 if end and close_at >= 0 else size
                else:
                    stack.append((tag, node))
                    count[tag] += 1
    return root


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def plain(raw: str) -> str:
    return " ".join(unescape(raw).split())


def together(a: list, b: list, pages: bool) -> list:
    """What is known of a slot's texts from two: of one page or of different ones."""
    return [a[0] + b[0] if pages else max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def merged(a: list, b: list, pages: bool) -> list:
    """The item that stands for two of the same key."""
    rest = together(a[2], b[2], pages) if a[0] == SLOT else aligned(a[2], b[2], pages)
    return [a[0], a[1] | b[1], rest]


def taken(group: list, items: list, at: int, pages: bool) -> tuple[list, int]:
    """The group after it has taken the items from ``at`` on that repeat it, and where these end."""
    while True:
        own, i, hit = [], at, False
        for x in group[2]:
            if i < len(items) and items[i][0] == x[0]:
                own.append(merged(x, items[i], pages))
                i, hit = i + 1, True
            elif x[1] & OPTIONAL:
                own.append(x)
            else:
                return group, at
        if not hit:
            return group, at
        group, at = [group[0], group[1], own], i


def optional(x: list) -> list:
    return [x[0], x[1] | OPTIONAL, x[2]]


def aligned(a: list, b: list, pages: bool = True) -> list:
    """The expression of all that either does: items of one key are merged, others become optional."""
    if not a or not b:
        return [optional(x) for x in a or b]
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [merged(x, y, pages) for x, y in zip(a, b, strict=True)]
    ahead_a, ahead_b = positions(a), positions(b)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[0] == y[0]:
            out.append(merged(x, y, pages))
            i, j = i + 1, j + 1
            continue
        if x[0][0] == "(":
            group, k = taken(x, b, j, pages)
            if k > j:
                out.append(group)
                i, j = i + 1, k
                continue
        if y[0][0] == "(":
            group, k = taken(y, a, i, pages)
            if k > i:
                out.append(group)
                i, j = k, j + 1
                continue
        in_a, in_b = after(ahead_a, y[0], i), after(ahead_b, x[0], j)
        if in_a is None and in_b is None:
            out += [optional(x), optional(y)]
            i, j = i + 1, j + 1
        elif in_b is None or in_a is not None and in_a - i <= in_b - j:
            out += map(optional, a[i:in_a])
            i = in_a
        else:
            out += map(optional, b[j:in_b])
            j = in_b
    out += map(optional, a[i:] + b[j:])
    return folded(out, pages)


def positions(items: list) -> dict[str, list[int]]:
    """Where each key stands, the last place first, so that places passed are dropped from the end."""
    out: dict[str, list[int]] = {}
    for k in range(len(items) - 1, -1, -1):
        out.setdefault(items[k][0], []).append(k)
    return out


def after(ahead: dict[str, list[int]], key: str, at: int) -> int | None:
    own = ahead.get(key)
    while own and own[-1] <= at:
        own.pop()
    return own[-1] if own else None


def alike(x: list, y: list) -> bool:
    """Whether neighbours of one key repeat each other: they hold some item of one key, or one holds nothing."""
    if x[0] != y[0]:
        return False
    return x[0] == SLOT or not x[2] or not y[2] or not {z[0] for z in x[2]}.isdisjoint(z[0] for z in y[2])


def folded(items: list, pages: bool = False) -> list:
    """Items with repeats made one: first an item after itself, then groups of two and more."""
    out: list = []
    for x in items:
        if out and alike(out[-1], x):
            last = out[-1]
            both = merged(last, x, pages)
            out[-1] = [both[0], (last[1] | x[1]) & ~OPTIONAL | last[1] & x[1] & OPTIONAL | REPEATED, both[2]]
        else:
            out.append(x)
    for k in range(2, PERIOD + 1):
        at = 0
        while at + 2 * k <= len(out):
            own = [x[0] for x in out[at : at + k]]
            if len(set(own)) > 1 and own == [x[0] for x in out[at + k : at + 2 * k]] and not any(x[0] == "(" for x in own):
                group = ["(" + " ".join(own) + ")", REPEATED, [[*x] for x in out[at : at + k]]]
                group, end = taken(group, out, at + k, pages)
                out[at:end] = [group]
            at += 1
    return out


def skeleton(node: Node) -> list:
    """The expression of a page: its element tree with repeats folded and texts as slots."""
    items: list = []
    texts: list[tuple[str, bool]] = []

    def flush() -> None:
        whole = plain("".join(t for t, _ in texts))
        if whole:
            own = hashed(whole)
            items.append([SLOT, 0, [1, own, own, len(whole), min(len(whole), sum(len(plain(t)) for t, inner in texts if inner))]])
        texts.clear()

    for x in node.children:
        if isinstance(x, tuple):
            texts.append(x)
        else:
            flush()
            if x is not None:
                items.append([x.key, 0, skeleton(x) if parts(x.key)[0] not in ("script", "style") else []])
    flush()
    return folded(items)


def slots(items: list) -> list[list]:
    """All text slots in order."""
    out: list[list] = []
    for x in items:
        if x[0] == SLOT:
            out.append(x)
        else:
            out += slots(x[2])
    return out


def pattern(items: list) -> str:
    """The expression as text, with ? and + and * as in regular expressions."""
    sign = {0: "", OPTIONAL: "?", REPEATED: "+", OPTIONAL | REPEATED: "*"}
    out = ""
    for key, flags, rest in items:
        if key == SLOT:
            out += SLOT + sign[flags]
        elif key[0] == "(":
            out += f"({pattern(rest)}){sign[flags]}"
        else:
            one = f"<{key}>{pattern(rest)}</{parts(key)[0]}>"
            out += f"({one}){sign[flags]}" if flags else one
    return out


#: From so many pages on, a text that all of them have is the template's.
LEAST_PAGES = 3


def choose(items: list) -> list:
    """The wrapper of a host: its expression with 1 at slots of main text and 0 at others, and for elements whether they are in the main part.

    The main part is the article element with most text (menus and the like not counted), else a main element or one so
    named, else the page. In an article element all counts but what is_aside says. Elsewhere, lists of
    links and texts that are the same on all pages, from ``LEAST_PAGES`` on, go too.
    """
    found: dict[str, list[tuple[int, bool, list]]] = {"article": [], "main": [], "named": []}

    def weigh(x: list, clean: bool, inside: bool) -> tuple[int, int]:
        if x[0] == SLOT:
            return (x[2][3], x[2][4]) if clean else (0, 0)
        if x[0][0] == "(":
            both = [weigh(y, clean, inside) for y in x[2]]
            return sum(b[0] for b in both), sum(b[1] for b in both)
        tag, words, roles, _ = parts(x[0])
        beside = is_aside(x[0], inside)
        kind = "article" if tag == "article" else "main" if tag == "main" or "main" in roles else "named" if words & MAIN and tag in ("div", "section", "td") else ""
        counts = clean and not beside
        both = [weigh(y, counts or bool(kind) and not beside, inside or tag == "article") for y in x[2]]
        own = sum(b[0] for b in both), sum(b[1] for b in both)
        if kind and not beside and own[0]:
            found[kind].append((own[0], clean, x))
        return own if counts else (0, 0)

    total = sum(weigh(x, True, False)[0] for x in items)
    region: list | None = None
    kind = ""
    for kind in ("article", "main", "named"):
        if own := [f for f in found[kind] if f[1]] or [f for f in found[kind] if not total]:
            region = max(own, key=lambda f: f[0])[2]
            break
    strict = region is not None and kind == "article"
    whole = region[2] if region is not None else items
    pages = max((s[2][0] for s in slots(items)), default=0)
    varied = any(s[2][1] != s[2][2] for s in slots(whole))

    def mark(x: list, on: bool, inside: bool, titles: bool) -> list:
        if x[0] == SLOT:
            n, low, high, _, _ = x[2]
            same = not strict and varied and low == high and n == pages >= LEAST_PAGES
            return [SLOT, x[1], int(on and not same and not titles)]
        if x[0][0] == "(":
            return [x[0], x[1], [mark(y, on, inside, titles) for y in x[2]], on]
        here = on or x is region
        tag, words, _, _ = parts(x[0])
        here = here and not (x is not region and is_aside(x[0], inside or strict and on))
        if here and not strict and x is not region and tag not in ("html", "body"):
            own = slots(x[2])
            if 2 * sum(s[2][4] for s in own) > sum(s[2][3] for s in own):
                here = False
        only = titles and tag not in HEADING or here and strict and on and (tag == "header" or "header" in words)
        return [x[0], x[1], [mark(y, here, inside or tag == "article", only) for y in x[2]], here and not only]

    return [mark(x, region is None, False, False) for x in items]


class Level:
    """The items of a wrapper's element, for placing a page's children: groups are opened, places are found by key."""

    __slots__ = ("flat", "groups", "where")

    def __init__(self, items: list):
        self.flat: list[tuple[int, int | bool, Level | None]] = []
        self.groups: list[int] = []  # where the group begins that a place is in
        self.where: dict[str, list[int]] = {}
        for x in items:
            start = len(self.flat)
            for y in x[2] if x[0][0] == "(" else [x]:
                self.where.setdefault(y[0], []).append(len(self.flat))
                self.groups.append(start)
                self.flat.append((y[1], y[2], None) if y[0] == SLOT else (y[1], y[3], Level(y[2])))

    def place(self, key: str, at: int) -> int | None:
        """The next place of that key from ``at`` on, in the group at hand or else its beginning, then after it, then before."""
        own = self.where.get(key)
        if not own:
            return None
        k = bisect_left(own, at)
        last = max(at - 1, 0)
        start = self.groups[last]
        if k < len(own) and self.groups[own[k]] == start:
            return own[k]
        again = bisect_left(own, start)
        if at and again < len(own) and own[again] < at and self.groups[own[again]] == start and last > start:
            return own[again]
        return own[k] if k < len(own) else own[-1]


NO_LEVEL = Level([])


def extract(page: Node, wrapper: Level) -> str:
    """The main text of a page by its host's wrapper: blocks in order, a line each."""
    lines: list[str] = []
    texts: list[str] = []

    def flush() -> None:
        if texts:
            line = plain("".join(texts))
            if line:
                lines.append(line)
            texts.clear()

    def walk(node: Node, level: Level, on: bool) -> None:
        at, slot = 0, None
        for x in node.children:
            if x is None:
                flush()
                slot = None
            elif isinstance(x, tuple):
                if slot is None and x[0].strip():
                    k = level.place(SLOT, at)
                    slot = on if k is None else bool(level.flat[k][1])
                    at = at if k is None else k + (not level.flat[k][0] & REPEATED)
                if slot is None or slot:
                    texts.append(x[0])  # white space before a text hurts no line
            else:
                slot = None
                if x.block:
                    flush()
                k = level.place(x.key, at)
                if k is None:
                    walk(x, NO_LEVEL, on and not is_aside(x.key, True))
                else:
                    flags, here, inner = level.flat[k]
                    walk(x, inner, here)
                    at = k + (not flags & REPEATED)
                if x.block:
                    flush()

    walk(page, wrapper, False)
    flush()
    return "\n".join(lines)

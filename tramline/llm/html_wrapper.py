"""HTML extraction with union-free regular expressions inferred from the pages of a host.

A page becomes a stream of symbols: tags with their classes, and text slots, which all look alike. Streams of one
host are aligned with the host's expression one after another: runs that repeat become repeated groups,
stretches that just one side has become optional groups, texts become slots. The expression that matches all
pages is the host's wrapper. Every page is then read by it, which gives each text its slot of the expression,
and what the distinct pages of the host show at a slot decides for all of them:

* A slot holds main text if nine tenths of its texts stand where main text may be, none if at most one tenth do;
  in between, each text's own place decides, as it does for a page that the wrapper can't be made to match.
* A string that four fifths of the host's pages have at the slot, and three pages at least, is the template's and
  not given out. Pages with one set of texts count once, so copies don't make a template; a page of which
  nothing would be left keeps its texts.

Main text may be in an article (in a page without one: in the main element; without that: in the body), outside
menus, headers, footers, asides, forms, scripts, styles and elements whose class, id or role names a menu,
notice, advert or comment section. An article's or main element's own parts of names don't count, only a whole
name does. If what is left is empty, articles or main elements that just such names hide are read as well.

Wrappers are inferred by partial folds: every partition folds its pages into one expression for each host,
equal ones are dropped, then salted groups and then hosts are folded; so a host with a third of all pages is
never gathered in one task. Wrappers are broadcast when their written size is small; else each is joined in
SALTS copies, so that a host's pages are spread over as many tasks.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a line end in page order; empty blocks are left out. Defined results: null or empty html gives an
empty text; a null url or one without a host belongs to the empty host; repeated rows get a row each; an
empty table gives an empty result. wrapper_matched is false where a repeated group took what an optional one
needs; such a page is aligned with the wrapper first, and read by its texts' own places if that doesn't help.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import common

#: Elements that never hold main text, and those that end a block.
SKIPPED = frozenset("head title nav header footer aside form script style noscript template iframe button select option textarea dialog menu svg canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Names in a class, id or role, split at hyphens and underscores, that mark what isn't main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ATTRIBUTES = r"""(?:[^>"']+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+"""
TAG = re.compile(rf"</([A-Za-z][^\s/>]*)|<([A-Za-z][^\s/>]*)({ATTRIBUTES})>?")


def _raw(name: str) -> str:
    """What follows the < of a raw element, as far as its end tag or, without one, the page's end."""
    letters = "".join(f"[{c}{c.upper()}]" for c in name)
    return rf"{letters}(?=[\s/>]|\Z){ATTRIBUTES}>?[^<]*(?:<(?!/(?i:{name})\b)[^<]*)*+(?:</(?i:{name})\b[^>]*>?)?"


#: Between texts: a tag, a raw element, a comment or a declaration.
MARKUP = re.compile(
    rf"(<(?:/[A-Za-z][^>]*>?|{'|'.join(map(_raw, sorted(RAW)))}|[A-Za-z][^\s/>]*{ATTRIBUTES}>?|!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*>?))", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")

#: Parts before a mark that make it a word about the layout.
LAYOUT = frozenset("has with no without".split())
#: What ends an open element by implication, and the elements at which the search for it ends.
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements in which an open paragraph outside doesn't end.
PARAGRAPH_SCOPE = frozenset("td th caption table button object html template".split())

TEXT = "#"
#: What follows TEXT in a wrapper's slot: main text, none, or as each text's own place says; then the keys of the template's strings.
LABELS = ("+", "-", "?")
#: A string of the template: so many pages of the host have it, and this share of them in fifths.
MIN_PAGES, FIFTHS = 3, 4
#: A slot is main, or isn't, if so many tenths of its texts at least, or the others at most, may be main text.
TENTHS = 9
#: Wrappers up to so many characters in all are broadcast.
MAX_BROADCAST_CHARS = 32_000_000
SALTS = 64
LONGEST_REPEAT = 24
#: What so many tags of at most so many characters say is kept in a worker, as pages repeat them.
KNOWN_TAGS, KNOWN_TAG_CHARS = 16_384, 200
#: Stretches are aligned by an exact longest common subsequence up to so many cells; longer ones are parted at symbols that both have once.
MAX_CELLS = 1_000_000


def marked(attributes: dict[str, str], whole: bool = False) -> bool:
    """Whether a class, id or role has one of the marks as a part of a name (whole: as a name), unless the name is one of the layout: has-sidebar."""
    for value in attributes.values():
        for name in value.split():
            parts = NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if not parts or parts[0] in LAYOUT or whole and len(parts) > 1:
                continue
            if not MARKS.isdisjoint(parts):
                return True
    return False


def string_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Tag(NamedTuple):
    """What a tag says to the reading of a page."""

    opens: bool
    name: str
    #: Empty if the element doesn't end a block.
    symbol: str
    is_void: bool
    is_raw: bool
    skipped: bool
    #: Whether it closes open elements by implication.
    implies: bool
    mark: bool
    whole_mark: bool
    #: The kind of root that it can be: article, main or none.
    root: str


def tag_of(m: re.Match) -> Tag:
    """The tag that TAG has found."""
    name = (m[1] or m[2]).lower()
    is_block, is_void = name in BLOCKS or name in SKIPPED, name in VOID
    if m[1]:
        return Tag(False, name, f"</{name}>" if is_block and not is_void else "", is_void, False, False, False, False, False, "")
    attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])}
    # Numbers in a class differ from page to page.
    symbol = f"<{name}.{DIGITS.sub('', attributes['class'])}>" if attributes.get("class") else f"<{name}>"
    root = "article" if name == "article" else "main" if name == "main" or attributes.get("role") == "main" else ""
    implies = name in IMPLIED or name in PARAGRAPH_ENDS
    return Tag(True, name, symbol if is_block else "", is_void, name in RAW, name in SKIPPED, implies, marked(attributes), marked(attributes, whole=True), root)


class _Known(dict):
    """Tags by their text: pages repeat them, so most are taken apart once. A worker holds a bounded number of short ones. None for comments and declarations."""

    def __missing__(self, markup: str) -> Tag | None:
        m = TAG.match(markup)
        if not m:
            return None
        if m[2] and m.end() < len(markup):
            return self[m[0]]  # the start tag of a raw element
        tag = tag_of(m)
        if len(markup) <= KNOWN_TAG_CHARS:
            if len(self) >= KNOWN_TAGS:
                self.clear()
            self[markup] = tag
        return tag


KNOWN = _Known()

Slot = tuple[int, str, bool]


def read(page: str) -> tuple[list[str], list[Slot]]:
    """The page's symbols; and each text with its place among them and whether it may be main text. A slot never crosses a block."""
    symbols, slots = outline(page)
    return symbols, [(at, one_spaced(text), main) for at, text, main in slots]


def one_spaced(text: str) -> str:
    """White space becomes one space, and none at the ends. In printable text there is none but spaces."""
    return text.strip() if "  " not in text and text.isprintable() else " ".join(text.split())


def stream(page: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The page's symbols, and each text that may be main text with its place among them."""
    symbols, slots = read(page)
    return symbols, [(at, text) for at, text, main in slots if main]


def outline(page: str) -> tuple[list[str], list[Slot]]:
    """As read(), with the texts' white space as it stands in the page."""
    parts = MARKUP.split(page)
    tags = [*map(KNOWN.__getitem__, parts[1::2]), None]
    roots = {tag.root for tag in tags if tag}
    root = "article" if "article" in roots else "main" if "main" in roots else ""
    symbols, slots, hidden = _read(parts[::2], tags, root, False)
    return (symbols, slots) if not hidden or any(main for *_, main in slots) else _read(parts[::2], tags, root, True)[:2]


#: An open element: its name, inside the root, skipped for its element, skipped for a mark, whether its text may be main text, whether a block that starts in it ends a paragraph.
Open = tuple[str, bool, bool, bool, bool, bool]


def _implied(open_: list[Open], name: str) -> None:
    """Close what the start of an element ends by implication: a paragraph, a list item, a cell, a row."""
    if name in IMPLIED:
        ends, scope = IMPLIED[name]
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in ends:
                del open_[k:]
                break
            if open_[k][0] in scope:
                break
    if name in PARAGRAPH_ENDS and open_[-1][5]:
        while open_.pop()[0] != "p":
            pass


def _read(texts: list[str], tags: list[Tag | None], root: str, reveal: bool) -> tuple[list[str], list[Slot], int]:
    """Symbols, slots, and the number of roots that only a mark hides, of texts that each have a tag behind them; reveal: such roots are read."""
    symbols: list[str] = []
    slots: list[Slot] = []
    # The first one stands for the page and is never closed.
    open_: list[Open] = [("", root == "", False, False, root == "", False)]
    held: list[str] = []
    held_main = False
    hidden = 0

    def flush() -> None:
        text = held[0] if len(held) == 1 else "".join(held)
        held.clear()
        if text and not text.isspace():
            slots.append((len(symbols), text, held_main))
            symbols.append(TEXT)

    for text, tag in zip(texts, tags, strict=True):
        if text:
            main = open_[-1][4]
            if main != held_main:
                if held:
                    flush()
                held_main = main
            held.append(html.unescape(text) if "&" in text else text)
        if not tag:
            continue
        opens, name, symbol, is_void, is_raw, skips, implies, mark, whole_mark, may_be_root = tag
        if symbol:
            if held:
                flush()
            symbols.append(symbol)
        if opens:
            if implies:
                _implied(open_, name)
            if is_void:
                continue
            _, inside, skipped, by_mark, _, in_paragraph = open_[-1]
            if may_be_root and not inside and may_be_root == root:
                by_mark = by_mark or root == "article" and whole_mark
                hidden += by_mark and not skipped
                by_mark = by_mark and not reveal
                inside = True
            elif mark and name != "html" and name != "body":
                by_mark = True
            if is_raw:
                symbols.append(f"</{name}>")
                continue
            skipped = skipped or skips
            open_.append((name, inside, skipped, by_mark, inside and not skipped and not by_mark, name == "p" or in_paragraph and name not in PARAGRAPH_SCOPE))
        elif open_[-1][0] == name:
            open_.pop()
        elif not is_void:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        elif name == "br" and held:
            flush()
    if held:
        flush()
    return symbols, slots, hidden


# ---- expressions: a list of symbols, ["+", items] for a repeated and ["?", items] for an optional group ----

Item = str | list


def collapse(items: list[Item]) -> list[Item]:
    """Runs of equal stretches become repeated groups, shorter stretches first."""
    for period in range(1, LONGEST_REPEAT + 1):
        out: list[Item] = []
        i = 0
        while i < len(items):
            body = items[i : i + period]
            n = 1
            while len(body) == period and items[i + n * period : i + (n + 1) * period] == body:
                n += 1
            if n > 1 and not (period == 1 and body[0][0] == "+"):
                out.append(["+", body])
                i += n * period
            elif n > 1:
                out.append(body[0])
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def groups(items: list[Item]) -> list[list]:
    return [g for x in items if isinstance(x, list) for g in ([x] if x[0] == "+" else []) + groups(x[1])]


def wrap_single(items: list[Item], repeated: list[list]) -> list[Item]:
    """A stretch that the other side repeats is a repeated group here too, also if it stands here once."""
    for group in sorted(repeated, key=lambda g: -len(g[1])):
        plain, given = unlabelled(group), [unlabelled(x) for x in items]
        body, out, i, wrapped = plain[1], [], 0, False
        while i < len(items):
            if given[i : i + len(body)] == body:
                if not wrapped:
                    out.append(["+", items[i : i + len(body)]])
                i, wrapped = i + len(body), True
            elif given[i] == plain and wrapped:
                i += 1
            else:
                wrapped = given[i] == plain
                out.append(items[i])
                i += 1
        items = out
    return items


def unlabelled(item: Item) -> Item:
    if isinstance(item, str):
        return TEXT if item[0] == TEXT and item[1:2] in LABELS else item
    return [item[0], [unlabelled(x) for x in item[1]]]


def core(item: Item) -> str:
    """What two items must share to be aligned: an optional single item stands for its content."""
    while isinstance(item, list) and item[0] == "?" and len(item[1]) == 1:
        item = item[1][0]
    return TEXT if isinstance(item, str) and item[0] == TEXT else json.dumps(unlabelled(item))


def optional(items: list[Item]) -> list[Item]:
    if not items:
        return []
    return items if len(items) == 1 and isinstance(items[0], list) and items[0][0] == "?" else [["?", items]]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The expression of both: a longest common subsequence stays, what just one has becomes optional."""
    a, b = wrap_single(a, groups(b)), wrap_single(b, groups(a))
    x, y = [core(i) for i in a], [core(i) for i in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out: list[Item] = []
    # An optional item stays optional; of two slots the wrapper's, which may be labelled, stays.
    pick = lambda i, j: b[j] if isinstance(b[j], list) and b[j][0] == "?" and not (isinstance(a[i], list) and a[i][0] == "?") else a[i]
    i = j = 0
    for di, dj in common_places(x, y, head, tail):
        out += optional(a[i:di]) + optional(b[j:dj])
        out.append(pick(di, dj))
        i, j = di + 1, dj + 1
    return out + optional(a[i:]) + optional(b[j:])


def common_places(x: list[str], y: list[str], head: int, tail: int) -> list[tuple[int, int]]:
    """Places of a common subsequence of x and y, which share their first head and last tail items."""
    middle = _common(x, y, head, len(x) - tail, head, len(y) - tail)
    return [(k, k) for k in range(head)] + middle + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def _common(x: list[str], y: list[str], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """A longest one of x[i0:i1] and y[j0:j1]; beyond MAX_CELLS the longest one through symbols that both have just once, and what lies between."""
    if i0 == i1 or j0 == j1:
        return []
    if (i1 - i0) * (j1 - j0) <= MAX_CELLS:
        return _longest(x, y, i0, i1, j0, j1)
    in_x, in_y = Counter(x[i0:i1]), Counter(y[j0:j1])
    place = {s: j for j, s in enumerate(y[j0:j1], j0) if in_y[s] == 1 and in_x[s] == 1}
    tails: list[int] = []
    chain: list[tuple[int, int, int]] = []  # of x, of y, the one before
    last: list[int] = []
    for i in range(i0, i1):
        j = place.get(x[i])
        if j is not None:
            k = bisect.bisect_left(tails, j)
            chain.append((i, j, last[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                last.append(len(chain) - 1)
            else:
                tails[k], last[k] = j, len(chain) - 1
    anchors, at = [], last[-1] if last else -1
    while at >= 0:
        anchors.append(chain[at][:2])
        at = chain[at][2]
    out: list[tuple[int, int]] = []
    i, j = i0, j0
    for ai, aj in [*reversed(anchors), (i1, j1)] if anchors else []:
        out += _common(x, y, i, ai, j, aj)
        if ai < i1:
            out.append((ai, aj))
        i, j = ai + 1, aj + 1
    return out


def _longest(x: list[str], y: list[str], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    n, m = i1 - i0, j1 - j0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        own, below, symbol = best[i], best[i + 1], x[i0 + i]
        for j in range(m - 1, -1, -1):
            own[j] = below[j + 1] + 1 if symbol == y[j0 + j] else max(below[j], own[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i0 + i] == y[j0 + j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Wrapper:
    """An expression that reads pages. Groups take as much as they can and give nothing back, so reading takes linear time."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.slots: list[str] = []
        self.tree = self._numbered(items)
        # What the template's strings of a slot are, by the slot.
        self.template = [frozenset(map(int, filter(None, x[2:].split(",")))) for x in self.slots]

    def _numbered(self, items: list[Item]) -> tuple:
        out = []
        for x in items:
            if not isinstance(x, str):
                out.append((x[0], self._numbered(x[1])))
            elif x[0] == TEXT:
                out.append((TEXT, len(self.slots)))
                self.slots.append(x)
            else:
                out.append(("", x))
        return tuple(out)

    def places(self, symbols: list[str]) -> list[int] | None:
        """The slot of every text of the page, or None if the expression doesn't match it."""
        out: list[int] = []
        return out if _take(self.tree, symbols, 0, out) == len(symbols) else None

    def matches(self, symbols: list[str]) -> bool:
        return self.places(symbols) is not None


def _take(tree: tuple, symbols: list[str], at: int, out: list[int]) -> int:
    """Where the page goes on behind what the tree takes from at on; -1 if it doesn't match."""
    for kind, body in tree:
        if kind == "" or kind == TEXT:
            if at == len(symbols) or symbols[at] != (body if kind == "" else TEXT):
                return -1
            if kind == TEXT:
                out.append(body)
            at += 1
            continue
        first = True
        while first or kind == "+":
            mark = len(out)
            end = _take(body, symbols, at, out)
            if end < 0:
                del out[mark:]
                if first and kind == "+":
                    return -1
                break
            first = False
            if end == at:
                break
            at = end
    return at


def fold(wrapper: list[Item] | None, items: list[Item]) -> list[Item]:
    return items if wrapper is None or wrapper == items else align(wrapper, items)


def read_by(wrapper: Wrapper, symbols: list[str]) -> tuple[Wrapper, list[int] | None]:
    """The wrapper, aligned with the page first where it doesn't match, and the slots of the page's texts."""
    found = wrapper.places(symbols)
    if found is not None:
        return wrapper, found
    wider = Wrapper(align(wrapper.items, collapse(symbols)))
    return wider, wider.places(symbols)


def main_text(page: str, wrapper: Wrapper) -> tuple[str, bool]:
    """The texts at the wrapper's main slots, and whether it matches as it is."""
    symbols, slots = read(page)
    used, places = read_by(wrapper, symbols)
    if places is None:
        return "\n".join(text for _, text, main in slots if main), False
    kept, constant = [], []
    for (_, text, main), k in zip(slots, places, strict=True):
        label = used.slots[k][1:2]
        if main if label in ("", "?") else label == "+":
            (constant if used.template[k] and string_key(text) in used.template[k] else kept).append(text)
    return "\n".join(kept or constant), used is wrapper


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One expression for each host of a partition; a stream that was seen or that matches isn't aligned again."""
    held: dict[str, Wrapper] = {}
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            symbols, _ = outline(page or "")
            if host in held and held[host].matches(symbols):
                continue
            items = collapse(symbols)
            key = (host, json.dumps(items))
            if key in seen:
                continue
            seen.add(key)
            held[host] = Wrapper(align(held[host].items, items) if host in held else items)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w.items) for w in held.values()])], names=["host", "wrapper"])


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    wrapper: list[Item] | None = None
    for x in sorted(table.column("wrapper").to_pylist()):
        wrapper = fold(wrapper, json.loads(x))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


SHOWN = pa.struct([("slot", pa.int32()), ("key", pa.int64()), ("main", pa.bool_())])


def _read_by(page: pa.Array, wrapper: pa.Array) -> Iterator[tuple[str, Wrapper]]:
    """Each page with its wrapper; rows share theirs, so each is made once."""
    coded = wrapper.dictionary_encode()
    wrappers = [Wrapper(json.loads(w)) for w in coded.dictionary.to_pylist()]
    return zip((x or "" for x in page.to_pylist()), map(wrappers.__getitem__, coded.indices.to_pylist()), strict=True)


@common.vector_udf(pa.list_(SHOWN))
def _shown(page: pa.Array, wrapper: pa.Array) -> pa.Array:
    """What a page shows at the wrapper's slots: each slot and key once, sorted; null for a page that doesn't match."""
    offsets, unmatched, shown = [0], [], []
    for x, w in _read_by(page, wrapper):
        symbols, slots = read(x)
        places = w.places(symbols)
        unmatched.append(places is None)
        if places is not None:
            found = {(k, string_key(text)): main for (_, text, main), k in zip(slots, places, strict=True)}
            shown += [(k, key, main) for (k, key), main in sorted(found.items())]
        offsets.append(len(shown))
    columns = zip(*shown, strict=True) if shown else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(c, field.type) for c, field in zip(columns, SHOWN, strict=True)], fields=list(SHOWN))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, pa.list_(SHOWN), mask=pa.array(unmatched, pa.bool_()))


def evidence(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host and labels of the slots that decide: slot, label, and the keys of the template's strings there."""
    shown = by_host(pages, wrappers).select("host", _shown("html", "wrapper").alias("shown")).where("shown IS NOT NULL")
    distinct = common.materialize(shown.distinct())
    total = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    rows = distinct.select("host", F.explode("shown").alias("x")).select("host", "x.*")
    counts = rows.groupBy("host", "slot").agg(F.count("*").alias("n"), F.count(F.when(F.col("main"), 1)).alias("n_main"))
    # Strings of few pages go before a host's come together: what is left of a host is what many of its pages share.
    shared = rows.groupBy("host", "slot", "key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    strings = shared.join(total, "host").where(F.col("n") * 5 >= F.col("pages") * FIFTHS).groupBy("host", "slot").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    by_slot = counts.join(strings, ["host", "slot"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    main, others = F.col("n_main") * 10 >= F.col("n") * TENTHS, F.col("n_main") * 10 <= F.col("n") * (10 - TENTHS)
    label = F.when(main, "+").when(others, "-").otherwise("?")
    return by_slot.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", label.alias("label"), "keys"))).alias("labels"))


LABELLED = pa.string()


@common.vector_udf(LABELLED)
def _labelled(wrapper: pa.Array, labels: pa.Array) -> pa.Array:
    return pa.array([labelled(w, x or []) for w, x in zip(wrapper.to_pylist(), labels.to_pylist(), strict=True)], LABELLED)


def labelled(wrapper: str, labels: list[dict]) -> str:
    """The wrapper with its slots labelled."""
    of = {x["slot"]: TEXT + x["label"] + ",".join(map(str, x["keys"])) for x in labels}
    number = iter(range(len(wrapper)))

    def put(items: list[Item]) -> list[Item]:
        return [[x[0], put(x[1])] if not isinstance(x, str) else of.get(next(number), TEXT) if x[0] == TEXT else x for x in items]

    return json.dumps(put(json.loads(wrapper)))


def by_host(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows with their host's wrapper."""
    total = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    if total <= MAX_BROADCAST_CHARS:
        return rows.join(F.broadcast(wrappers), "host")
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"]).drop("salt")


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) of every host: the expression, its slots labelled."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = rows.mapInArrow(_partial, "host string, wrapper string").distinct()
    found = found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    found = found.groupBy("host", "salt").applyInArrow(_merged, "host string, wrapper string").distinct()
    expressions = common.materialize(found.groupBy("host").applyInArrow(_merged, "host string, wrapper string"))
    return expressions.join(evidence(rows, expressions), "host", "left").select("host", _labelled("wrapper", "labels").alias("wrapper"))


FOUND = pa.struct([("text", pa.string()), ("matched", pa.bool_())])


@common.vector_udf(FOUND)
def _extracted(page: pa.Array, wrapper: pa.Array) -> pa.Array:
    texts, matched = [], []
    for x, w in _read_by(page, wrapper):
        text, found = main_text(x, w)
        texts.append(text)
        matched.append(found)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(matched, pa.bool_())], fields=list(FOUND))


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars, and whether the host's wrapper matches, of every row of pages."""
    wrappers = common.materialize(infer(pages)) if wrappers is None else wrappers
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = by_host(own, wrappers).select("page_id", "url", _extracted("html", "wrapper").alias("f"))
    return found.select("page_id", "url", F.col("f.text").alias("text"), F.length("f.text").cast("long").alias("n_chars"), F.col("f.matched").alias("wrapper_matched"))

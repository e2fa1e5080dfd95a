"""Main text of web pages by wrappers: expressions without unions, inferred from the pages of each host.

A page is a stream of block tags and text slots. Runs of equal groups are folded into repeated ones; then the streams of a
host are aligned one after the other, and where they differ the odd part becomes optional (or a repeated group, if the
other page repeats it). What comes out is a wrapper: tags, text slots, (...)+ and (...)?. Each of its slots counts the text that
pages had there and whether it was always the same. A wrapper's content is the container with most of the text that varies
from page to page, where an article or main element weighs more; with one article all others are content that are no teasers.
Every page is extracted by aligning it with its host's
wrapper: the wrapper's slot decides for a text of the same path, the wrapper's containers for other texts. Blocks that stand
in an element for menus, adverts and the like never count.

Wrappers are built in each task for the pages it has, merged in two steps by host (so a host with a third of all pages is
aligned in many tasks), and sent to the pages. They keep every item that any page has, however many those are: large ones are
merged by like size and aligned in bounded memory, and go to their hosts' pages once a task, not beside every page.

Defined cases: null and empty pages give an empty text; pages without a host (null or odd urls) form one group; rows that
share a page_id are pages each; unclosed tags, comments and scripts end with the page; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, shuffle_partitions, table

#: Fixed values. Elements whose content is no text of the page; elements that hold no article text; those that don't begin a block.
RAW = "script style noscript template svg math iframe object textarea select canvas audio video title".split()
OUTSIDE = frozenset("nav footer aside form menu dialog button fieldset head option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that tell what an element is for.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs footer sidebar aside rail widget widgets "
    "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager toolbar tags search hidden complementary contentinfo masthead".split()
)
MAIN = frozenset("article main content post story entry body text".split())
#: Words that nothing outweighs; words of layout ("with-sidebar"), whose mark says nothing of the element itself.
NEVER = frozenset("comment comments disqus respond reply replies hidden".split())
LAYOUT = frozenset("with without has no".split())
#: How far an element is from content: in it; in doubt, for the host's varying text to decide; out, but for an article inside; out.
IN, DOUBT, ODD, OUT = range(4)
#: Words that tell a teaser from an article of the page.
TEASER = frozenset("teaser teasers card cards preview previews excerpt excerpts snippet snippets".split())
#: An element that ends when the other begins inside it.
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul td th tr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
SCOPE = frozenset("table ul ol dl article section div td th".split())

TOKEN = re.compile(
    # Each alternative ends with the page at the latest and gives nothing back, so that any page takes linear time.
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    rf"<(?P<raw>{'|'.join(RAW)})(?=[\s>/])[^>]*+(?<!/)>.*?(?:</(?P=raw)[^>]*+(?:>|\Z)|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
GAP = re.compile(r"\s+")
#: First of a doubtful block's path.
DOUBTFUL = "~"
ARTICLE = re.compile(r"(?:article|main)(?:\.|$)")
#: What varying text counts in an article or main element, in one with a word of MAIN, and in one in doubt.
ARTICLE_WEIGHT, MAIN_WEIGHT, DOUBT_WEIGHT = 4, 2, 0.5
#: Groups of up to so many items are tried size by size; longer ones where a stretch of one item more comes again.
FOLD = 12
#: Elements that may be open at once, as in browsers: one more takes the place of the innermost.
DEPTH = 512
#: Alignments keep rows and masks of so many bytes each; what doesn't fit is computed again.
ROOM = 1 << 26
#: A wrapper of more items waits for another of its size, so that not every page is aligned with a large one; a task that
#: holds more in all hands on what it has.
PART, HELD = 4_000, 200_000


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    far: int
    link: int = 0

    @property
    def outside(self) -> bool:
        return self.far > DOUBT

    @property
    def place(self) -> tuple[str, ...]:
        """path, marked where in doubt or outside."""
        return (DOUBTFUL, *self.path) if self.far == DOUBT else ("-", *self.path) if self.outside else self.path


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRS.finditer(raw)} if raw.strip() else {}


def signature(name: str, attrs: dict[str, str]) -> str:
    """Tag with its classes or else its id, digits aside: what stays the same from page to page."""
    mark = (attrs.get("class") or attrs.get("id") or "") if name not in ("html", "body") else ""  # theirs tell page from page
    return f"{name}.{'.'.join(sorted(re.sub(r'[0-9]+', '', mark).split()))}" if mark else name


def purpose(attrs: dict[str, str]) -> list[set[str]]:
    """The words of each mark in class, id and role, layout aside."""
    marks = [set(re.split(r"[^a-z]+", x)) - {""} for k in ("class", "id", "role") for x in attrs.get(k, "").lower().split()]
    return [m for m in marks if m and not m & LAYOUT]


def oddness(marks: list[set[str]], inside: bool) -> int:
    """IN without a word of BOILERPLATE; a mark such as "content" beside the odd one leaves it in doubt, as does one within it ("post-tags") outside articles."""
    words = set().union(*marks)
    if not words & BOILERPLATE:
        return IN
    if words & NEVER:
        return OUT
    return DOUBT if any(m <= MAIN for m in marks) or words & MAIN and not inside else ODD


def deeper(outer: int, own: int, rescue: bool) -> int:
    """How far an element is out, given the one around it; articles and marks of content within an odd one are in doubt."""
    if rescue and outer == ODD and own < ODD:
        return DOUBT
    return ODD if outer == own == DOUBT else max(outer, own)


def teaser(mark: str) -> bool:
    return bool(TEASER & set(re.split(r"[^a-z]+", mark.lower())))


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The outermost article or main element of a block's path (all articles of a place as one, teasers apart), else what holds its paragraphs and lists."""
    for i, x in enumerate(path):
        if ARTICLE.match(x):
            return (*path[:i], x if teaser(x) else x.partition(".")[0])
    box = path[:-1] if path and re.match(r"(p|h[1-6]|li|pre|blockquote|td|dd|dt)\b", path[-1]) else path
    while box and re.match(r"(ul|ol|dl|table|tbody|tr|td|blockquote)\b", box[-1]):
        box = box[:-1]
    return box


def parse(html: str) -> tuple[list[str], list[Block], list[int]]:
    """(stream of block tags and "#" for text slots, blocks, for each block its place in the stream)."""
    stream: list[str] = []
    blocks: list[Block] = []
    places: list[int] = []
    stack: list[tuple[str, str, int, bool]] = []  # name, signature, how far out, in an article
    text: list[str] = []
    link, linked, at = False, 0, 0

    def flush() -> None:
        nonlocal linked
        body = GAP.sub(" ", unescape("".join(text))).strip()
        text.clear()
        if body:
            top = stack[-1] if stack else ("", "", IN, False)
            heading = next((x[0] for x in reversed(stack) if re.fullmatch("h[1-6]", x[0])), None)
            header = any(x[0] == "header" for x in stack)
            stream.append("#")
            places.append(len(stream) - 1)
            blocks.append(Block(body, tuple(x[1] for x in stack), OUT if header and not (top[3] and heading) else top[2], linked))
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            flush()
            stream.append("/" + stack.pop()[1])

    for m in TOKEN.finditer(html):
        piece = html[at : m.start()]
        if piece:
            if stack and stack[-1][0] == "head" and not piece.isspace():
                close(len(stack) - 1)
            text.append(piece)
            linked += len(piece) if link else 0
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        # A head without an end tag ends with the first element or text that it can't hold.
        if stack and stack[-1][0] == "head" and not m["end"] and name not in VOID:
            close(len(stack) - 1)
        if name in VOID:
            if name in ("br", "hr"):
                text.append(" ")
            if name == "hr":
                flush()
            continue
        if m["end"]:
            if name == "a":
                link = False
            spot = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if spot is not None and (name not in ("p", "li", "dt", "dd") or not any(x[0] in SCOPE and x[0] != name for x in stack[spot + 1 :])):
                close(spot)
            continue
        attrs = attributes(m["attrs"])
        marks = purpose(attrs)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.IGNORECASE) is not None
        own = OUT if hidden else oddness(marks, bool(stack) and stack[-1][3])
        if name == "a":
            link = True
        if name in INLINE and not (own and name != "a"):
            continue
        if m["attrs"].rstrip().endswith("/") and name not in CLOSES:
            continue
        flush()
        while stack and name in CLOSES.get(stack[-1][0], ()):
            close(len(stack) - 1)
        close(DEPTH - 1)
        top = stack[-1] if stack else ("", "", IN, False)
        role = "main" if attrs.get("role", "").lower() == "main" else name
        article = role in ("article", "main")
        if name in ("body", "html", "main", "article") and not any(m & {"comment", "comments"} for m in marks):
            own = IN
        elif name in OUTSIDE:
            own = OUT
        stack.append((name, signature(role, attrs), deeper(top[2], own, article or any(m <= MAIN for m in marks)), top[3] or article))
        stream.append(stack[-1][1])
    piece = html[at:]
    if piece and not piece.lstrip().startswith("<"):
        if stack and stack[-1][0] == "head" and not piece.isspace():
            close(len(stack) - 1)
        text.append(piece)
    close(0)
    flush()
    return stream, blocks, places


Item = str | tuple


def stretches(items: list[Item]) -> tuple[list[int], list[list[int]]]:
    """A number for the FOLD + 1 items from each place, and the places of each number."""
    numbers: dict[tuple, int] = {}
    spots: list[list[int]] = []
    grams = []
    for i in range(len(items) - FOLD if len(items) > 2 * FOLD else 0):
        grams.append(numbers.setdefault(tuple(items[i : i + FOLD + 1]), len(numbers)))
        if grams[-1] == len(spots):
            spots.append([])
        spots[grams[-1]].append(i)
    return grams, spots


def long_group(items: list[Item], i: int, grams: list[int], spots: list[list[int]]) -> int | None:
    """Size of the shortest group of over FOLD items that comes twice in a row from place i."""
    places = spots[grams[i]] if i < len(grams) else []
    for k in range(bisect_right(places, i + FOLD), len(places)):
        j, size = places[k], places[k] - i
        if j + size > len(items):
            break
        if all(grams[i + x] == grams[j + x] for x in range(0, size - FOLD, FOLD + 1)) and items[i:j] == items[j : j + size]:
            return size
    return None


def fold(items: list[Item]) -> tuple[list[Item], list[int]]:
    """items with runs of equal groups folded into ("+", group); and for each item where it went."""
    where = list(range(len(items)))
    for _ in range(3):
        out: list[Item] = []
        moved: list[int] = []
        grams, spots = stretches(items)
        i = 0
        while i < len(items):
            best = None
            for size in range(1, min(FOLD, (len(items) - i) // 2) + 1):
                if items[i] != items[i + size] or items[i : i + size] != items[i + size : i + 2 * size]:
                    continue
                best = size
                break
            best = best or long_group(items, i, grams, spots)
            if best:
                n = 2
                while items[i : i + best] == items[i + n * best : i + (n + 1) * best]:
                    n += 1
                group = tuple(items[i : i + best])
                out.append(group[0] if len(group) == 1 and isinstance(group[0], tuple) else ("+", group))
                moved += [len(out) - 1] * (best * n)
                i += best * n
            else:
                out.append(items[i])
                moved.append(len(out) - 1)
                i += 1
        where = [moved[w] for w in where]
        if len(out) == len(items):
            break
        items = out
    return items, where


def repeat_like(items: list[Item], where: list[int], groups: set[tuple]) -> tuple[list[Item], list[int]]:
    """Single groups that the other side repeats, as repeated ones."""
    single, pairs = (set(items), set(zip(items, items[1:], strict=False))) if groups else ((), ())
    for group in groups:
        n, i, out, moved = len(group), 0, [], []
        if not (group[0] in single if n == 1 else group[:2] in pairs) and not (("+", group) in single and (("+", group), ("+", group)) in pairs):
            continue
        while i < len(items):
            if tuple(items[i : i + n]) == group:
                if not (out and out[-1] == ("+", group)):
                    out.append(("+", group))
                moved += [len(out) - 1] * n
                i += n
            elif items[i] == ("+", group) and out and out[-1] == items[i]:
                moved.append(len(out) - 1)
                i += 1
            else:
                out.append(items[i])
                moved.append(len(out) - 1)
                i += 1
        if out != items:
            single, pairs = set(out), set(zip(out, out[1:], strict=False))
        items, where = out, [moved[w] for w in where]
    return items, where


def aligned(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence. Rows of the usual table are integers whose zero bits tell where lengths grow."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    pairs: list[tuple[int, int]] = []
    both = set(a[lo:n]).intersection(b[lo:m]) if lo < min(n, m) else ()
    if both:
        _follow([i for i in range(lo, n) if a[i] in both], [j for j in range(lo, m) if b[j] in both], a, b, pairs)
    return [*((i, i) for i in range(lo)), *reversed(pairs), *((n + i, m + i) for i in range(len(a) - n))]


def _follow(xs: list[int], ys: list[int], a: list[Item], b: list[Item], pairs: list[tuple[int, int]]) -> None:
    """Adds the pairs, last ones first. Of a table larger than ROOM some rows are kept, and those between them computed again, piece by piece from the end."""
    spots: dict[Item, list[int]] = defaultdict(list)
    for k, i in enumerate(xs):
        spots[a[i]].append(k)
    room = max(8 * ROOM // len(xs), 4)

    def mask(y: Item) -> int:
        bits = bytearray(len(xs) // 8 + 1)
        for k in spots[y]:
            bits[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(bits, "little")

    masks = {y: mask(y) for y in (spots if len(spots) <= room else sorted(spots, key=lambda y: -len(spots[y]))[:room])}

    def back(row: int, j: int, end: int, i: int) -> int:
        """From place i after row end back to row j, which is given; the place there."""
        step = -(-(end - j) // room)
        full = (1 << i) - 1
        row &= full
        rows = [row]
        for k in range(j, end):
            y = b[ys[k]]
            same = row & (masks[y] if y in masks else mask(y))
            row = ((row + same) | (row - same)) & full
            if (k + 1 - j) % step == 0:
                rows.append(row)
        if step > 1:
            for k in range((end - j - 1) // step, -1, -1):
                i = i and back(rows[k], j + k * step, min(j + (k + 1) * step, end), i)
            return i
        for k in range(end - j, 0, -1):
            i = (~rows[k] & ((1 << i) - 1)).bit_length()
            if not i:
                break
            if rows[k - 1] >> (i - 1) & 1:
                i -= 1
                pairs.append((xs[i], ys[j + k - 1]))
        return i

    back((1 << len(xs)) - 1, 0, len(ys), len(xs))


def repeated(items: list[Item]) -> set[tuple]:
    return {x[1] for x in items if isinstance(x, tuple)}


def within(path: tuple[str, ...]) -> bool:
    """Whether a path leads into an article or main element."""
    return any(map(ARTICLE.match, path))


def weight(box: tuple[str, ...]) -> int:
    if box[:1] == (DOUBTFUL,):
        return DOUBT_WEIGHT
    if within(box):
        return 1 if teaser(box[-1]) else ARTICLE_WEIGHT
    return MAIN_WEIGHT if box and MAIN & set(re.split(r"[^a-z]+", box[-1].lower())) else 1


@dataclass
class Content:
    """A wrapper's slots of content, the containers they lie in, and those that at least half of the pages have."""

    slots: set[int]
    boxes: tuple[tuple[str, ...], ...]
    common: set[tuple[str, ...]]

    def __post_init__(self) -> None:
        self.all = set(self.boxes)
        self.plain = {b for b in self.boxes if not within(b)}
        self.depths = sorted({len(b) for b in self.plain})

    def holds(self, path: tuple[str, ...]) -> bool:
        box = container(path)
        return box in self.all or not (within(box) and teaser(box[-1])) and any(path[:n] in self.plain for n in self.depths if n or path[:1] != (DOUBTFUL,))


@dataclass
class Wrapper:
    """Items with: in how many pages each occurred, characters of its text, characters in links, hash of the text or None if it varies, path, article."""

    items: list[Item] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    same: list[int | None] = field(default_factory=list)
    paths: list[tuple] = field(default_factory=list)
    pages: int = 0

    @classmethod
    def of(cls, stream: list[str], blocks: list[Block], places: list[int]) -> Wrapper:
        items, where = fold(stream)
        n = len(items)
        own = cls(items, [1] * n, [0] * n, [0] * n, [0] * n, [()] * n, 1)
        for b, p in zip(blocks, places, strict=True):
            i = where[p]
            if b.outside:
                own.paths[i] = own.paths[i] or b.place
                continue
            own.chars[i] += len(b.text)
            own.links[i] += b.link
            own.same[i] = hash_text(f"{own.same[i]}{b.text}")
            if not own.paths[i] or own.paths[i][0] == "-":
                own.paths[i] = b.place
        return own

    def regroup(self, groups: set[tuple]) -> Wrapper:
        items, where = repeat_like(self.items, list(range(len(self.items))), groups)
        if len(items) == len(self.items):
            return self
        n = len(items)
        out = Wrapper(items, [0] * n, [0] * n, [0] * n, [0] * n, [()] * n, self.pages)
        for i, w in enumerate(where):
            out.seen[w] = max(out.seen[w], self.seen[i])
            out.chars[w] += self.chars[i]
            out.links[w] += self.links[i]
            out.same[w] = None if self.same[i] is None or out.same[w] is None else out.same[w] ^ self.same[i]
            out.paths[w] = out.paths[w] or self.paths[i]
        return out

    def merge(self, other: Wrapper) -> Wrapper:
        """One wrapper for the pages of both."""
        if not self.pages or not other.pages:
            return other if not self.pages else self
        a, b = self.regroup(repeated(other.items)), other.regroup(repeated(self.items))
        out = Wrapper(pages=a.pages + b.pages)
        i = k = 0
        for x, y in [*aligned(a.items, b.items), (len(a.items), len(b.items))]:
            for w, z in (*((a, z) for z in range(i, x)), *((b, z) for z in range(k, y))):
                out._add(w.items[z], w.seen[z], w.chars[z], w.links[z], w.same[z], w.paths[z])
            if x < len(a.items):
                out._add(a.items[x], a.seen[x] + b.seen[y], a.chars[x] + b.chars[y], a.links[x] + b.links[y], a.same[x] if a.same[x] == b.same[y] else None, a.paths[x] or b.paths[y])
            i, k = x + 1, y + 1
        return out

    def _add(self, item, seen, chars, links, same, path) -> None:
        for x, y in ((self.items, item), (self.seen, seen), (self.chars, chars), (self.links, links), (self.same, same), (self.paths, path)):
            x.append(y)

    def expression(self) -> str:
        """The wrapper as a regular expression without unions: optional items in (...)?, repeated ones in (...)+."""

        def show(item: Item) -> str:
            return item if isinstance(item, str) else "(" + " ".join(map(show, item[1])) + ")+"

        out, odd = [], []
        for item, seen in [*zip(self.items, self.seen, strict=True), ("", self.pages)]:
            if seen < self.pages:
                odd.append(show(item))
                continue
            if odd:
                out.append("(" + " ".join(odd) + ")?")
                odd = []
            if item:
                out.append(show(item))
        return " ".join(out)

    def constant(self, i: int) -> bool:
        """Whether pages had the same text in the slot."""
        return self.pages > 2 and self.seen[i] > 2 and self.same[i] is not None

    def content(self) -> Content:
        """The containers of content and their slots: the one with most varying text outside links, and articles that are no teasers."""
        mass: Counter = Counter()
        seen: Counter = Counter()
        boxes = [container(path) if path[:1] != ("-",) else None for path in self.paths]
        for i, box in enumerate(boxes):
            if box is not None:
                seen[box] = max(seen[box], self.seen[i])
        for vary in (True, False):  # where all pages are copies, nothing varies
            for i, box in enumerate(boxes):
                if self.chars[i] and box is not None and not (vary and self.constant(i)):
                    mass[box] += max(self.chars[i] - 2 * self.links[i], 0)
            if mass:
                break
        common = {b for b, n in seen.items() if 2 * n >= self.pages}
        if not mass:
            return Content(set(), (), common)
        article = lambda b: within(b) and not teaser(b[-1])
        doubt = lambda b: b[:1] == (DOUBTFUL,)
        base = lambda b: b[1:] if doubt(b) else b
        # A container counts with its parts in doubt.
        score = {b: mass[b] * weight(b) + (mass[DOUBTFUL, *b] * DOUBT_WEIGHT if not doubt(b) else 0) for b in mass}
        best = max(mass, key=lambda b: (score[b], not doubt(b), -len(b), b))

        def also(b: tuple[str, ...]) -> bool:
            if doubt(b) != doubt(best):  # parts of one container, of which those in doubt hold most
                return base(b)[: len(base(best))] == base(best) and mass[b] >= mass[best] if doubt(b) else base(b) == base(best)
            # Beside an article any other; beside another container those with half as much text.
            return article(b) and mass[b] >= (1 if article(best) and not doubt(b) else max(mass[best] / 2, 1))

        own = Content(set(), (best, *sorted(b for b in mass if b != best and also(b))), common)
        # Of an article all counts; elsewhere short texts that never change are labels.
        label = lambda i: not within(self.paths[i]) and self.constant(i) and self.chars[i] < 200 * self.seen[i]
        own.slots = {i for i, path in enumerate(self.paths) if self.chars[i] and boxes[i] is not None and own.holds(path) and not label(i)}
        return own

    def dump(self) -> bytes:
        paths = {p: i for i, p in enumerate(dict.fromkeys(self.paths))}
        return zlib.compress(json.dumps([self.items, self.seen, self.chars, self.links, self.same, list(paths), [paths[p] for p in self.paths], self.pages]).encode(), 1)

    @classmethod
    def load(cls, dumped: bytes) -> Wrapper:
        items, seen, chars, links, same, paths, places, pages = json.loads(zlib.decompress(dumped))
        tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else sys.intern(x)
        paths = [tuples(p) for p in paths]
        return cls([tuples(x) for x in items], seen, chars, links, same, [paths[i] for i in places], pages)


class Growing:
    """A host's wrapper while pages come in: page after page up to PART items, then by merges of wrappers of like size."""

    def __init__(self) -> None:
        self.large: list[Wrapper] = []
        self.last = Wrapper()

    def add(self, wrapper: Wrapper) -> int:
        """Takes pages in and gives how many items more there are."""
        before = self.items()
        self.last = self.last.merge(wrapper)
        if len(self.last.items) > PART:
            self.large.append(self.last)
            self.last = Wrapper()
            while len(self.large) > 1 and len(self.large[-2].items) <= 2 * len(self.large[-1].items):
                self._join()
        return self.items() - before

    def items(self) -> int:
        return sum(len(w.items) for w in self.large) + len(self.last.items)

    def _join(self) -> None:
        last = self.large.pop()
        self.large[-1] = self.large[-1].merge(last)

    def whole(self) -> Wrapper:
        if not self.large:
            return self.last
        self.large.append(self.last)
        while len(self.large) > 1:
            self._join()
        self.last = Wrapper()
        return self.large[0]


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "big")


def extract(stream: list[str], blocks: list[Block], places: list[int], wrapper: Wrapper | None, content: Content | None) -> str:
    """The blocks of content, with an empty line between each two."""
    inside = [(b, p) for b, p in zip(blocks, places, strict=True) if not b.outside]
    if not inside:
        return ""
    if wrapper is None or content is None or not wrapper.pages:
        wrapper = Wrapper.of(stream, blocks, places)
        content = wrapper.content()
    items, where = fold(stream)
    items, moved = repeat_like(items, list(range(len(items))), repeated(wrapper.items))
    spot = {b: a for a, b in aligned(wrapper.items, items)}

    def keep(b: Block, p: int) -> bool:
        slot = spot.get(moved[where[p]])
        return slot in content.slots if slot is not None and wrapper.paths[slot] == b.place else content.holds(b.place)

    kept = [keep(b, p) for b, p in inside]
    if not any(kept):  # nothing of the page fits its host's wrapper: it is judged by itself
        own = Wrapper.of(stream, blocks, places).content()
        kept = [own.holds(b.place) for b, _ in inside]
    else:  # so are containers that few of the host's pages have, if they hold more than was kept
        rare = [not k and container(b.place) not in content.common for k, (b, _) in zip(kept, inside, strict=True)]
        if sum(len(b.text) for r, (b, _) in zip(rare, inside, strict=True) if r) > sum(len(b.text) for k, (b, _) in zip(kept, inside, strict=True) if k):
            some = [x for k, r, x in zip(kept, rare, inside, strict=True) if k or r]
            own = Wrapper.of(stream, *map(list, zip(*some, strict=True))).content()
            if not content.holds(own.boxes[0] if own.boxes else ()):
                kept = [(k or r) and own.holds(b.place) for k, r, (b, _) in zip(kept, rare, inside, strict=True)]
    return "\n\n".join(b.text for k, (b, _) in zip(kept, inside, strict=True) if k)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _rows(found: list[tuple[str | None, int, Wrapper]]) -> Iterator[pa.RecordBatch]:
    """host, size, wrapper: a batch of small wrappers, one each of the others."""
    small: list[tuple] = []
    for host, size, wrapper in found:
        row = (host, size, wrapper.dump())
        if len(row[2]) <= BIG:
            small.append(row)
        else:
            yield _batch([row])
    yield _batch(small)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*rows, strict=True)] or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["host", "size", "wrapper"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, size, wrapper: one for each host of the task's pages; more where a task would hold too much."""
    growing: dict[str, Growing] = defaultdict(Growing)
    sizes: Counter = Counter()
    held = 0
    for batch in batches:
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            html = html.as_py() or ""
            sizes[host] += len(html)
            stream, blocks, places = parse(html)
            if not stream:
                continue
            held += growing[host].add(Wrapper.of(stream, blocks, places))
            if held > HELD:
                yield from _rows([(h, sizes.pop(h), growing[h].whole()) for h in sorted(growing)])
                growing.clear()
                held = 0
    yield from _rows([(h, sizes[h], growing[h].whole()) for h in sorted(growing)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, size, growing = None, 0, Growing()
    done: list[tuple[str | None, int, Wrapper]] = []
    held = 0
    for batch in batches:
        for host, own, dumped in zip(batch.column("host").to_pylist(), batch.column("size").to_pylist(), batch.column("wrapper"), strict=True):
            if host != now:
                if growing.items():
                    done.append((now, size, growing.whole()))
                    held += len(done[-1][2].items)
                if held > HELD:
                    yield from _rows(done)
                    done, held = [], 0
                now, size, growing = host, 0, Growing()
            size += own
            growing.add(Wrapper.load(dumped.as_py()))
    if growing.items():
        done.append((now, size, growing.whole()))
    yield from _rows(done)


#: Wrappers of up to BIG bytes (most have less than 1 kB) stand beside their hosts' pages; they are sent to all tasks if they are
#: few, else each goes there by a join. A larger one goes once to each group of about GROUP characters of its host's pages, or
#: of four times its own size if that is more.
MAX_BROADCAST, SALTS, BIG, GROUP = 4_000, 16, 1 << 14, 1 << 22


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, characters of its pages, wrapper (as compressed JSON) of every host with any structure."""
    parts = shuffle_partitions(pages.sparkSession)
    schema = "host string, size long, wrapper binary"
    own = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(_infer, schema)
    own = own.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = own.repartition(parts, "host", "salt").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, schema)
    return some.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, schema)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row of pages."""
    found = checkpointed(wrappers(pages, url, html))
    large = F.octet_length("wrapper") > BIG
    salts = F.floor(F.col("size") / F.greatest(F.lit(GROUP), 4 * F.octet_length("wrapper"))) + 1
    count, some = found.agg(F.count("*"), F.coalesce(F.count_if(large), F.lit(0))).first()
    beside = found.select("host", F.when(~large, F.col("wrapper")).alias("wrapper"), F.when(large, salts).alias("salts"))
    if count <= MAX_BROADCAST:
        beside = F.broadcast(beside)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).join(beside, "host", "left")
    kinds = dict(rows.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        held = 0
        for batch in batches:
            texts = []
            for html_, host, wrapper in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                parsed = parse(html_.as_py() or "")
                if host not in cache:
                    if len(cache) > 200 or held > HELD:
                        cache.clear()
                        held = 0
                    w = Wrapper.load(wrapper.as_py()) if wrapper.as_py() else None
                    cache[host] = (w, w.content() if w else None)
                    held += len(w.items) if w else 0
                texts.append(extract(*parsed, *cache[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    def group(own: pa.Table, wrapper: pa.Table) -> pa.Table:
        w = Wrapper.load(wrapper["wrapper"][0].as_py())
        content = w.content()
        texts = [extract(*parse(html_.as_py() or ""), w, content) for html_ in own["html"]]
        return pa.table([own["page_id"], own["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    columns = ["page_id", "url", "html", "host"]
    if not some:
        return rows.select(*columns, "wrapper").mapInArrow(each, schema)
    keys = ["host", "salt"]
    near = rows.where("salts IS NULL").select(*columns, "wrapper").mapInArrow(each, schema)
    far = rows.where("salts IS NOT NULL").select(*columns, F.pmod(F.xxhash64("page_id", "url", "html"), F.col("salts")).alias("salt"))
    copies = found.where(large).select("host", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "wrapper")
    return near.unionByName(far.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(group, schema))


def op3_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))

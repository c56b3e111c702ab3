"""HTML as a sequence of leaf blocks, with what the block labeller reads of each.

A tolerant one-pass reader: it follows the open elements, closes what HTML
closes by itself (paragraphs, list items, cells), skips scripts, styles and the
titles of head and drawings, and cuts the text at block-level tags. White space
within a block (including line breaks) becomes one space; character references
are decoded. Everything else (formulas, drawings' texts, what stands in noscript,
select or object) is a block or part of one, and left to the labeller.

Time and memory follow the page: paths are nodes that point to the path around them,
the last open element of every tag is at hand, and no tag is tried twice.
    unclosed tags      without a ">" in the rest of the page: text
    unclosed quotes    if a tag's quotes run to the end of the page, tags are read
                       without regard to quotes from there on
    unclosed comments and scripts, styles, text areas: the rest of the page belongs to
                       them; of a tag written as empty (<script .../>), only the tag
    unclosed titles, frames: only the tag is skipped
"""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass

PATH_BUCKETS, WORD_BUCKETS, N_NUMBERS = 512, 512, 12

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop|data-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\s\w]")

#: Elements by how they are read (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Raw elements of which the rest of the page is a part if they aren't closed.
OPEN_END = frozenset("script style textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript object ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
#: What an opening tag closes, and the elements that stop the search.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - {"body", "html", "head", "button", "label", "noscript", "object", "optgroup", "option", "select", "summary", "caption", "template"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


def bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


class Buckets(dict):
    """Token -> bucket, remembered (a bounded memo)."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[token] = bucket(token, self.buckets)
        return out


_PATHS, _WORDS = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)


class Path:
    """The open elements around a block: the innermost one's tokens and the path around
    it. The same path of one reader is one object."""

    __slots__ = ("above", "count", "depth", "inside", "tokens")

    def __init__(self, above: Path | None = None, tokens: tuple[int, ...] = ()) -> None:
        self.above, self.tokens = above, tokens
        self.depth = above.depth + 1 if above else 0
        self.count = above.count + len(tokens) if above else 0
        self.inside: dict[tuple[int, ...], Path] = {}

    def enter(self, tokens: tuple[int, ...]) -> Path:
        if tokens not in self.inside:
            self.inside[tokens] = Path(self, tokens)
        return self.inside[tokens]

    def flat(self) -> list[int]:
        parts, at = [], self
        while at.above is not None:
            parts.append(at.tokens)
            at = at.above
        return [t for tokens in reversed(parts) for t in tokens]


@dataclass
class Element:
    tag: str
    path: Path
    label: int | None


@dataclass
class Block:
    text: str
    path: Path
    tag: str
    linked: int  # code points inside links
    label: int | None = None


def _attributes(tag: str, attributes: str, above: int | None) -> tuple[tuple[int, ...], int | None]:
    tokens, label = [tag], above
    if attributes:
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                for part in _PART.findall(value):
                    tokens += [part.lower(), f"{tag}.{part.lower()}"]
            elif name == "data-label":
                label = int(value == "1")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                tokens.append("#hidden")
    return tuple(_PATHS[t] for t in tokens), label


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Path) -> None:
        self.root, self.stack = root, []
        self.places: dict[str, list[int]] = {}

    def last(self, tags: frozenset[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def push(self, tag: str, attributes: str) -> None:
        top = self.stack[-1] if self.stack else None
        tokens, label = _attributes(tag, attributes, top.label if top else None)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, (top.path if top else self.root).enter(tokens), label))

    def close(self, names: frozenset[str], stops: frozenset[str] = frozenset()) -> None:
        """Closes the innermost of the names and all inside it, unless a stop stands between."""
        at = self.last(names)
        if at > self.last(stops):
            while len(self.stack) > at:
                self.places[self.stack.pop().tag].pop()


_P, _P_STOPS = frozenset(("p",)), frozenset(("td", "th", "button", "object", "template"))


class Tags:
    """The tags and comments of a page in order: (start, end, closing, name, attributes)."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if start > self.last:
                return None
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, False, "", ""
            if m := _NAME.match(page, start + 1):
                end = None
                if self.quotes:
                    found = _QUOTED.match(page, m.end())
                    if found:
                        end = found.end()
                    else:
                        self.quotes = False
                if end is None:
                    end = page.find(">", m.end()) + 1
                    if not end:
                        return None
                return start, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


def blocks(page: str | None, root: Path | None = None) -> list[Block]:
    """root: a Path that the pages of a batch share."""
    page = page or ""
    root = root or Path()
    out: list[Block] = []
    held, tags = Open(root), Tags(page)
    buffer: list[str] = []
    at, link, linked = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                top = held.stack[-1] if held.stack else None
                out.append(Block(text, top.path if top else root, top.tag if top else "", linked, top.label if top else None))
            buffer.clear()
        linked = 0

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if link:
                linked += len(text)

    no_end: set[str] = set()
    while (found := tags.next(at)) is not None:
        start, end, closing, tag, attributes = found
        words(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW:
            if tag not in no_end and not closing:
                stop = _RAW_END[tag].search(page, at)
                if stop:
                    at = stop.end()
                elif tag in OPEN_END and not attributes.endswith("/"):
                    at = len(page)
                else:
                    no_end.add(tag)
            continue
        if tag == "br":
            buffer.append(" ")
        elif tag == "hr":
            flush()
        elif tag in VOID:
            continue
        elif tag not in BLOCK:
            if tag == "a":
                link = not closing
        elif closing:
            flush()
            held.close(frozenset((tag,)))
        else:
            flush()
            if tag in ENDS_P:
                held.close(_P, _P_STOPS)
            if tag in CLOSES:
                held.close(*CLOSES[tag])
            held.push(tag, attributes)
    words(page[at:])
    flush()
    return out


def numbers(block: Block, i: int, n: int) -> list[float]:
    text, tokens = block.text, block.text.count(" ") + 1
    chars = len(text)
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        min(math.log1p(chars) / 6, 2.0),
        min(math.log1p(tokens) / 4, 2.0),
        min(block.linked / chars, 1.0),
        min(ends / tokens, 1.0),
        min(text.count(",") / tokens, 1.0),
        float(text[-1] in ".!?:…\"”"),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
        float(block.tag in ("li", "dt", "dd")),
        float(block.tag == "p"),
        min(block.path.depth / 12, 2.0),
        i / n,
        min(n / 100, 2.0),
    ]


def word_buckets(text: str) -> list[int]:
    return list(map(_WORDS.__getitem__, _WORD.findall(text.lower())))

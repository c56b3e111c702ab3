"""Short mathematical answers: a token reader for LaTeX and exact values. Pure Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

#: Commands and marks of presentation only (fixed values of the format).
SILENT = frozenset(("$", "%", r"\%", r"\!", r"\,", r"\;", r"\left", r"\right"))
FRACTIONS = frozenset((r"\frac", r"\dfrac", r"\tfrac"))
_TOKEN = re.compile(r"\\[A-Za-z]+|\\?.", re.S)
_DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)")
_RATIO = re.compile(r"([+-]?\d+)/(\d+)")
_PLAIN = re.compile(r"-?[\d.]+")
_STATED = re.compile(r"answer(?:\s*(?:is|:|=))?\s*(-?[\d,./]+)", re.I)
_NUMBER = re.compile(r"-?\d[\d,]*\.?\d*")


class Reader:
    """Reads one answer as a sequence of tokens; groups in braces nest."""

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = _TOKEN.findall(text)
        self.at = 0

    def blanks(self) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at].isspace():
            self.at += 1

    def group(self) -> str | None:
        """The inside of a group that starts here, read; None if none does."""
        self.blanks()
        if self.at == len(self.tokens) or self.tokens[self.at] != "{":
            return None
        self.at += 1
        return "".join(self.parts(inside=True))

    def parts(self, inside: bool = False) -> Iterator[str]:
        while self.at < len(self.tokens):
            token = self.tokens[self.at]
            self.at += 1
            if inside and token == "}":
                return
            if token in SILENT or token.isspace():
                continue
            if token == r"\text":
                held = self.group()
                yield token if held is None else held
            elif token in FRACTIONS:
                top, bottom = self.group(), self.group()
                if top is None or bottom is None:
                    yield r"\frac" + "".join("{" + x + "}" for x in (top, bottom) if x is not None)
                else:
                    alone = self.at == len(self.tokens) and _PLAIN.fullmatch(top) and _PLAIN.fullmatch(bottom)
                    yield f"{top}/{bottom}" if alone else rf"\frac{{{top}}}{{{bottom}}}"
            elif token == "{":
                yield "{" + "".join(self.parts(inside=True)) + "}"
            else:
                yield token


def value(text: str) -> Fraction | None:
    """The exact number a text writes as a decimal or a ratio; thousands may be set apart."""
    digits = text.replace(",", "").strip()
    if ratio := _RATIO.fullmatch(digits):
        return Fraction(int(ratio[1]), int(ratio[2])) if int(ratio[2]) else None
    return Fraction(digits.rstrip(".") if digits[-1:] == "." else digits) if _DECIMAL.fullmatch(digits) else None


def canonical(answer: str) -> str:
    """One form for ways to write the same short answer; no algebra is done."""
    parts = list(Reader(unicodedata.normalize("NFKC", answer)).parts())
    if len(parts) > 2 and parts[1] == "=" and len(parts[0]) == 1 and parts[0].isascii() and parts[0].isalpha():
        parts = parts[2:]  # "x = 5" names its variable
    form = "".join(parts).rstrip(".")
    exact = value(form)
    return form if exact is None else str(exact)


def last_box(text: str) -> str | None:
    r"""What stands in the last \boxed{...}; to the end where it is never closed."""
    tokens = _TOKEN.findall(unicodedata.normalize("NFKC", text))
    for start in reversed([i for i, t in enumerate(tokens) if t == r"\boxed"]):
        at = next((i for i in range(start + 1, len(tokens)) if not tokens[i].isspace()), None)
        if at is None or tokens[at] != "{":
            continue
        open_groups = 0
        for end in range(at, len(tokens)):
            open_groups += {"{": 1, "}": -1}.get(tokens[end], 0)
            if not open_groups:
                return "".join(tokens[at + 1 : end]).strip()
        return "".join(tokens[at + 1 :]).strip() or None
    return None


def stated(text: str | None) -> str | None:
    """A reply's answer in canonical form: its last box, else its last stated answer, else
    its last number."""
    said = text or ""
    if box := last_box(said):
        return canonical(box)
    flat = " ".join(re.sub(r"```|`|\*\*|__", " ", unicodedata.normalize("NFKC", said)).split())
    for pattern in (_STATED, _NUMBER):
        if found := pattern.findall(flat):
            return canonical(found[-1])
    return None


def same(first: str, second: str) -> bool:
    one, two = canonical(first), canonical(second)
    exact = value(one)
    return one == two or (exact is not None and exact == value(two))

"""Base rules for personal data: spans of e-mail, IP, card and phone numbers by pattern.

Spans are code point offsets, end exclusive; the matches of a kind do not overlap and are
taken from left to right, and a match that fails its check is dropped. Every rule takes
time in proportion to the text, long runs of digits or letters included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every place inside.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            taken = domain.end()
            yield "email", start, taken
        at = text.find("@", max(at + 1, taken))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def passes_luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed and then by start."""
    spans = list(_emails(text))
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(map(_small, match.group().split("."))):
                spans.append(("ip", *match.span()))
        for match in _CARD.finditer(text):
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                spans.append(("card", *match.span()))
        for match in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(match.group())) <= 15:
                spans.append(("phone", *match.span()))
    return spans


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)

"""Taking postal addresses apart."""

from __future__ import annotations

import re
from typing import NamedTuple

from caseloom.llm.names import fold

# Full words of street types, of units, and of buildings; their short forms are mined.
STREET_TYPES = frozenset(
    "road street avenue lane drive close crescent court place terrace way square gardens grove hill walk mews parade row park rise view green yard quay broadway boulevard circus".split()
)
UNIT_WORDS = frozenset("unit flat suite apartment room floor studio office block".split())
BUILDINGS = frozenset("house mill chambers works building buildings tower hall lodge centre center wharf studios mansions".split())
_CARE_OF = re.compile(r"\b(?:c/o|c\.o\.|care of|attn:?|f\.?a\.?o\.?)\s+(?:(?![,\n]|\d).)*(?:,|(?=\d)|$)", re.I)
#: Area, district (with its letter, if any), and what stands behind the blank; then two letters of area with digits that may be mistyped as letters.
_POSTCODE = re.compile(
    r"(?<![A-Za-z0-9])(?:([A-Za-z]{1,2})([0-9]{1,2})([A-Za-z]?)\s?([0-9])\s?([A-Za-z]{2})|([A-Za-z]{2})\s?([0-9OoIiLl]{1,2})\s?([0-9OoIiLl])\s?([A-Za-z]{2}))(?![A-Za-z0-9])"
)
#: What may be a unit and an ordinal ("B3 2nd Floor") is a postcode only where the field or a part of it ends.
_ORDINAL = re.compile(r"(1st|2nd|3rd|[04-9]th)$", re.I)
_NUMBER = re.compile(r"\d{1,4}[a-z]?")
_GLUED_UNIT = re.compile(r"u\d{1,4}[a-z]?")
_DIGITS = str.maketrans("OoIiLl", "001111")


class Parts(NamedTuple):
    """'' stands for what is absent. before_1, before_2: the words before the smaller and the larger of two numbers, as text."""

    number: str
    unit: str
    postcode: str
    street: str
    kind: str
    town: str
    pair: str
    before_1: str
    before_2: str


def postcode_of(text: str | None, whole: bool = False) -> tuple[str, int]:
    """(postcode without blanks, where it begins); digits mistyped as letters are put right. ('', -1) without one."""
    text = text or ""
    found = [m for m in _POSTCODE.finditer(text) if any(c.isdigit() for c in m[0]) or whole]
    if not whole:
        found = [m for m in found if not _ORDINAL.search(m[0]) or not text[m.end() :].strip(" .") or text[m.end() :].lstrip().startswith((",", ";", "\n"))]
    if not found:
        return "", -1
    m = found[-1]
    if m[1]:
        return "".join(m.group(1, 2, 3, 4, 5)).upper(), m.start()
    return (m[6] + m[7].translate(_DIGITS) + m[8].translate(_DIGITS) + m[9]).upper(), m.start()


def parts_of(line_1: str | None, line_2: str | None, locality: str | None, postal_code: str | None, rewrites: dict[str, str] | None = None) -> Parts | None:
    """Parts of an address; None if all of it is null or blank.

    rewrites maps words to their normal form and is applied before anything is
    recognised. Care-of names and buildings' names are left out.
    """
    fields = [f for f in (line_1, line_2, locality, postal_code) if f and f.strip()]
    if not fields:
        return None
    code, _ = postcode_of(postal_code, whole=True)
    texts: list[str] = []
    for f in (line_1, line_2, locality):
        t = _CARE_OF.sub(" ", f or "")
        inner, at = postcode_of(t)
        if inner and (not code or inner == code):
            code = inner
            t = t[:at] + _POSTCODE.sub(" ", t[at:])
        texts.append(t)
    rewrite = rewrites or {}
    say = lambda t: [rewrite.get(w, w) for w in fold(t).split()]
    tokens = say(texts[0]) + say(texts[1])
    town = " ".join(say(texts[2]))
    number = unit = ""
    words: list[str] = []
    numbered: list[tuple[str, str]] = []
    i = 0
    while i < len(tokens):
        w, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
        numeric = bool(_NUMBER.fullmatch(w))
        if w in UNIT_WORDS and (_NUMBER.fullmatch(after) or (len(after) == 1 and after.isalpha())):
            unit, i = after, i + 2
            numbered.append((after, w))
            continue
        if _GLUED_UNIT.fullmatch(w):
            unit = w[1:]
        elif w in ("no", "nr", "number") and _NUMBER.fullmatch(after):
            number, i = after, i + 2
            numbered.append((after, "no"))
            continue
        elif numeric:
            numbered.append((w, tokens[i - 1] if i else ""))
            if not number:
                number = w
            elif not unit:  # two numbers without a word for the unit: the first of neighbours is the unit
                unit, number = (number, w) if tokens[i - 1] == number else (w, number)
        elif w in BUILDINGS and words and words[-1] not in STREET_TYPES:
            words.pop()
        else:
            words.append(w)
        i += 1
    street = words[0] if words else ""
    at = next((k for k, w in enumerate(words) if w in STREET_TYPES and k), 0)
    kind, rest = (words[at], words[at + 1 :]) if at else ("", words[1:])
    if at > 1:
        street = " ".join(words[:at])
    elif not at and rest and len(rest[0]) <= 5 and (town or len(rest) > 1):  # perhaps a short form that is not known yet
        kind, rest = rest[0], rest[1:]
    numbered.sort()
    pair = "-".join(n for n, _ in numbered) if len(numbered) == 2 else ""
    before = [b for _, b in numbered] if pair else ["", ""]
    return Parts(number, unit, code, street, kind, town or " ".join(rest), pair, before[0], before[1])

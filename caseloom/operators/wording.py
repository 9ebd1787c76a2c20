"""Gates over prose: listed terms outside exempt quotations, regions of a memo, and years of origin."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions import text as X

# Words that no memo may use of a company.
TERMS = ("fraud", "fraudulent", "fraudster", "lying", "liar", "lied", "criminal", "crime", "scam", "sham", "dishonest", "dishonesty", "deceit", "deceitful", "crook", "con artist")
_URL = re.compile(r"https?://\S+")

# Months, and the verbs of an origin, which a year must follow.
_MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_YEAR = rf"(?:(?:\d{{1,2}}\s+)?{_MONTHS}\s+)?(\d{{4}})(?![\p{{L}}\p{{N}}_])"
_LASTING = r"(?:operat(?:e[ds]?|ing)|trad(?:e[ds]?|ing)|start(?:ed|ing))(?:\s+operations)?\s+(?:since|from)\s+"
_BEGINNING = r"(?:founded|established|incorporated|formed|launched|launching|began|begun)(?:\s+operations|\s+trading)?(?:\s+(?:in|on))?\s+"
_DENIALS = ("not", "never", "no longer", "stopped", "ceased", "without")
#: Characters before an origin's verb in which a denial takes it back.
DENIAL_WINDOW = 48


def term_pattern(terms: Iterable[str]) -> str:
    """Whole words, any white space inside a term; boundaries are those of letters, digits and _ of any script."""
    either = "|".join(r"\s+".join(re.escape(p) for p in t.split()) for t in terms)
    return rf"(?<![\p{{L}}\p{{N}}_])({either})(?![\p{{L}}\p{{N}}_])"


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+", " ")


def listed_terms(c: Column, terms: Iterable[str] = TERMS) -> Column:
    """All listed terms of a text, in order and lower-cased; addresses are no prose."""
    return F.regexp_extract_all(F.lower(without_urls(c)), F.lit(term_pattern(terms)), F.lit(1))


def occurrences(prose: str, quote: str) -> np.ndarray:
    """(begin, end) of the occurrences of a quotation that don't overlap, from the left; none of a blank one."""
    if not quote or not quote.strip():
        return np.zeros((0, 2), np.int64)
    parts = np.array([len(p) for p in prose.split(quote)[:-1]], np.int64)
    begin = np.cumsum(parts) + len(quote) * np.arange(len(parts))
    return np.stack((begin, begin + len(quote)), 1)


def open_terms(prose: str | None, quotes: Iterable[str] | None, pattern: re.Pattern[str]) -> list[str]:
    """Listed terms that don't lie wholly inside one occurrence of an exempt quotation."""
    if not prose:
        return []
    prose = _URL.sub(" ", prose)
    hits = [(m.start(), m.end(), m[0].lower()) for m in pattern.finditer(prose)]
    if not hits:
        return []
    spans = [occurrences(prose, q) for q in dict.fromkeys(quotes if quotes is not None else ()) if q]
    spans = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
    spans = spans[np.lexsort((-spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]
    # A hit is inside a span if, of those that begin no later, one reaches its end.
    upto = np.searchsorted(spans[:, 0], [h[0] for h in hits], side="right")
    return [h[2] for h, k in zip(hits, upto.tolist(), strict=True) if not k or reach[k - 1] < h[1]]


def gate(prose: Column, quotes: Column, terms: Iterable[str] = TERMS) -> Column:
    """open_terms of every row, an array; null prose has none."""
    terms = tuple(terms)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, exempt: pd.Series) -> pd.Series:
        pattern = re.compile(r"\b(" + "|".join(r"\s+".join(re.escape(p) for p in t.split()) for t in terms) + r")\b", re.I)
        return pd.Series([open_terms(t, q, pattern) for t, q in zip(texts, exempt, strict=True)], dtype=object)

    return run(prose, quotes)


def region_of(memo: str | None, heading: str, openers: tuple[str, ...]) -> tuple[int, int] | None:
    """(begin, end) of the first section under the very heading whose next line with text begins with an opener, up to the next heading of its rank; None without such an end."""
    lines = (memo or "").splitlines(keepends=True)
    at = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(int)
    plain = [x.rstrip("\r\n") for x in lines]
    filled = [i for i, x in enumerate(plain) if x.strip()]
    following = np.searchsorted(filled, np.arange(len(lines)), side="right")
    rank = heading.split(" ")[0] + " "
    for i, x in enumerate(plain):
        if x == heading and following[i] < len(filled) and plain[filled[following[i]]].startswith(openers):
            end = next((j for j in range(i + 1, len(lines)) if plain[j].startswith(rank)), None)
            return None if end is None else (int(at[i]), int(at[end]))
    return None


def memo_gate(memo: Column, claims: Column, names: Column, heading: str, openers: tuple[str, ...], terms: Iterable[str] = TERMS) -> Column:
    """struct(region_begin, region_end, hits): open terms of a memo, quotations of claims being exempt inside the region only, names everywhere; without a region claims are exempt nowhere."""
    terms = tuple(terms)

    @F.pandas_udf("region_begin int, region_end int, hits array<string>")
    def run(texts: pd.Series, quoted: pd.Series, known: pd.Series) -> pd.DataFrame:
        pattern = re.compile(r"\b(" + "|".join(r"\s+".join(re.escape(p) for p in t.split()) for t in terms) + r")\b", re.I)
        rows = []
        for text, q, n in zip(texts, quoted, known, strict=True):
            own = list(n) if n is not None else []
            region = region_of(text, heading, openers)
            if region is None:
                rows.append((None, None, open_terms(text, own, pattern)))
                continue
            b, e = region
            inside = [*(q if q is not None else ()), *own]
            rows.append((b, e, open_terms(text[:b], own, pattern) + open_terms(text[b:e], inside, pattern) + open_terms(text[e:], own, pattern)))
        out = pd.DataFrame(rows, columns=["region_begin", "region_end", "hits"])
        return out.astype({"region_begin": "Int32", "region_end": "Int32"})

    return run(memo, claims, names)


def origin_years(c: Column) -> Column:
    """Years that a text gives as its company's origin, 1800 to 2099, ascending, each once; a denial shortly before takes one back."""
    edge, folded = r"(?<![\p{L}\p{N}_])", X.fold_for_match(c)
    denied = "".join(rf"(?<!{edge}{d}(?![\p{{L}}\p{{N}}_]).{{0,{DENIAL_WINDOW - len(d)}}})" for d in _DENIALS)
    # What stands before is looked at only where a verb and a year follow. The year in the lookahead is a group too.
    found = [F.regexp_extract_all(folded, F.lit(f"{edge}(?={verb}{_YEAR}){denied}{verb}{_YEAR}"), F.lit(2)) for verb in (_LASTING, _BEGINNING)]
    lead = F.regexp_extract_all(folded, F.lit(rf"^since\s+{_YEAR}"), F.lit(1))
    years = F.transform(F.concat(*found, lead), lambda y: y.cast("int"))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(1800, 2099)))), F.array().cast("array<int>"))

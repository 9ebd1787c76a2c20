"""Keyword-stuffed, link-list and tag pages, by the shapes of their lines.

Lines are cut at sentence stops into segments, and every segment is reduced to
its form: dates, links, prices, codes, capitalised words, numbers and other
words, with the separators between them. What kind of segment it is follows from
the form alone: how many words, links, codes and separators it has, whether a
stop ends it, and how often its word pairs repeat. A segment's shape is its
kind, its word count's magnitude and its form: of a sentence, one by one, with
capitals in a row and numbers in a row counting once; of the rest, which marks
and separators it has. Segments are grouped by document and shape, and a
document is flagged if most of its characters stand in few non-sentence shapes.
Sentences are such shapes too where one of them is used again and again with a
phrase repeated inside it: a form letter for a search phrase.

A document's shapes need no other document, so all of it is one pass without a
shuffle: numpy over arrays of the characters of many whole texts at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.spread import spread

#: A page is flagged if more than this share of its characters stands in its FEW_SHAPES largest stuffed shapes.
STUFFED_SHARE, FEW_SHAPES = 0.5, 12
#: Separators per word from which a segment is a list, and different words per word below which it repeats itself.
LIST_SEPARATORS, REPEATING = 0.2, 0.8
#: Marks of tags from which a segment is tags, if most words have one.
TAGS = 3
#: Words without a stop from which a segment is no heading, and at most in a sentence.
RUN_ON, LONGEST_SENTENCE = 25, 70
#: A sentence's shape is a form letter's if so many segments of the document have it; such sentences are stuffed if this share of them repeats a phrase.
FORM_LETTER, PHRASE_SHARE = 3, 0.3
#: Share of a segment's word pairs that are repetitions, from which it is no sentence whatever ends it.
REPEATED_PAIRS = 0.25
#: Characters per word, blanks included, from which a segment without a stop is made of phrases written as one word.
GLUED = 13
#: Characters looked at together; more where one line is longer.
BLOCK_CHARS = 500_000

#: What a character may be, as bits.
UPPER, LETTER, MARK, DIGIT, BLANK, BREAK, STOP, BANG, WIDE_STOP, CLOSER, COLON, SEPARATOR, CURRENCY, INNER = (1 << i for i in range(14))
# Characters by what they do in a line; STOPS end a segment before a blank.
STOPS, WIDE_STOPS, CLOSERS, COLONS, SEPARATORS, CURRENCIES, BREAKS = ".?…", "。！？।", "\"”’»)", ":;", "|/;,•·»›#=~>", "£$€¥", "\n\r\x0b\x0c\x85  "
DATE, LINK, PRICE, CODE, CAPITAL, NUMBER, WORD = range(1, 8)
SENTENCE, FACT, HEADING, LINKS, PRODUCT, KEYWORD = range(6)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(bits, lower case) of every code point."""
    bits, lower = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            bits[c] = LETTER | (UPPER if kind in ("Lu", "Lt") else 0)
            if kind in ("Lu", "Lt"):
                lower[c] = ord(chr(c).lower()[0])
        elif kind[0] == "M":
            bits[c] = MARK
        elif kind[0] == "N":
            bits[c] = DIGIT
        elif kind[0] == "Z":
            bits[c] = BLANK
    bits[[9, 31, 30, 29, 28]] |= BLANK
    for chars, bit in ((STOPS, STOP), ("!", BANG), (WIDE_STOPS, WIDE_STOP), (CLOSERS, CLOSER), (COLONS, COLON), (SEPARATORS, SEPARATOR), (CURRENCIES, CURRENCY), ("@_", LETTER), ("'’-", INNER)):
        bits[[ord(c) for c in chars]] |= bit
    for c in BREAKS:
        bits[ord(c)] = BREAK
    return bits, lower


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    step, back = int(_STEP), pow(int(_STEP), -1, 1 << 64)
    out = np.ones((2, n), np.uint64)
    out[:, 1:] = np.array([[step], [back]], np.uint64)
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


def _hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every slice of values, the same for equal slices wherever they stand."""
    up, down = _powers(1 << max(int(len(values)).bit_length(), 10))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * up[: len(values)], dtype=np.uint64)))
    mixed = (total[end] - total[begin]) * down[begin]
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _distinct(segment: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values every segment has."""
    order = np.lexsort((value, segment))
    s, v = segment[order], value[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    return np.bincount(s[new], minlength=n)


def _at(text: np.ndarray, word: str) -> np.ndarray:
    """Where a word begins, in lower-cased text."""
    n = len(text) - len(word) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = text[:n] == ord(word[0])
    for i, c in enumerate(word[1:], 1):
        hit &= text[i : i + n] == ord(c)
    return np.flatnonzero(hit)


def segment_shapes(texts: list[str]) -> dict[str, np.ndarray]:
    """text (number in the list), shape, kind, chars, repeats: a row per segment of the texts."""
    bits, lower = _characters()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    flag, low, size = bits[raw], lower[raw], len(raw)
    has = lambda bit: (flag & bit) > 0
    blank, broken = has(BLANK), has(BREAK)
    gap = blank | broken

    # Links reach to the next blank; what they hold is nothing else.
    blanks = np.append(np.flatnonzero(gap), size)
    links = np.unique(np.concatenate([_at(low, w) for w in ("http://", "https://", "www.")]))
    until = blanks[np.searchsorted(blanks, links)]
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, links, 1)
    np.add.at(cover, until, -1)
    linked = np.cumsum(cover[:-1]) > 0
    link_at, _ = _runs(linked)

    # Segments: between breaks, after stops before a blank, after ! before a capital, after stops of scripts without blanks.
    ahead = lambda a, k: np.concatenate((a[k:], np.zeros(k, bool)))
    solid = (flag & (LETTER | MARK | DIGIT | CLOSER | STOP)) > 0
    solid |= (raw == ord("%")) | (raw == ord("]"))
    before = np.concatenate(([False], solid[:-1])) & np.concatenate(([False, False], solid[:-2]))
    stop = has(STOP) & before & ~linked
    cuts = stop & ahead(blank, 1)
    cuts |= np.concatenate(([False], (stop & ahead(has(CLOSER), 1) & ahead(blank, 2))[:-1]))
    cuts |= has(BANG) & ahead(blank, 1) & ahead(has(UPPER), 2)
    cuts |= has(WIDE_STOP) | broken
    owner = np.cumsum(cuts) - cuts
    filled = np.flatnonzero(~gap)
    if not len(filled):
        return {k: np.zeros(0, np.int64) for k in ("text", "shape", "kind", "chars", "repeats")}
    own, first = np.unique(owner[filled], return_index=True)
    number = np.full(int(owner[-1]) + 1, -1, np.int64)
    number[own] = np.arange(len(own))
    n = len(own)
    last = filled[np.append(first[1:], len(filled)) - 1]
    first = filled[first]
    segment = lambda at: number[owner[at]]
    count = lambda at: np.bincount(segment(at), minlength=n)
    chunk, _ = _runs(~gap)
    chars = count(filled) + count(chunk[chunk != first[segment(chunk)]])
    tail, tail_2 = flag[last], flag[np.maximum(last - 1, 0)]
    ends = (tail & (STOP | COLON | WIDE_STOP)) > 0
    calls = (tail & BANG) > 0
    closed = (tail & CLOSER) > 0
    ends |= closed & ((tail_2 & (STOP | COLON | WIDE_STOP)) > 0)
    calls |= closed & ((tail_2 & BANG) > 0)

    # Tokens: runs of letters, digits, apostrophes and hyphens.
    begin, end = _runs(((flag & (LETTER | MARK | DIGIT | INNER)) > 0) & ~linked)
    upto = lambda bit: np.concatenate(([0], np.cumsum(has(bit))))
    letters, digits, uppers = (u[end] - u[begin] for u in (upto(LETTER), upto(DIGIT), upto(UPPER)))
    kept = (letters > 0) | (digits > 0)
    begin, end, letters, digits, uppers = (x[kept] for x in (begin, end, letters, digits, uppers))
    length = end - begin
    kind = np.where(letters > 0, np.where((flag[begin] & UPPER) > 0, CAPITAL, WORD), NUMBER)
    nothing = len(begin) == 0
    iso = (kind == NUMBER) & (length == 10) & (digits == 8) & (raw[np.minimum(begin + 4, size - 1)] == ord("-")) & (raw[np.minimum(begin + 7, size - 1)] == ord("-"))
    code = ((kind == NUMBER) & (length >= 5) & (length == digits)) | ((kind == CAPITAL) & (uppers >= 2) & (uppers <= 4) & (digits >= 2) & (uppers + digits == length) & ((flag[np.maximum(end - 1, 0)] & DIGIT) > 0))
    kind = np.where(iso, DATE, np.where(code, CODE, kind))
    if not nothing:
        mark = np.maximum(begin - 1, 0)
        priced = ((flag[mark] & CURRENCY) > 0) | (((flag[mark] & BLANK) > 0) & ((flag[np.maximum(begin - 2, 0)] & CURRENCY) > 0) & (begin > 1))
        kind = np.where(priced & (begin > 0) & (letters == 0), PRICE, kind)
    space = begin[1:] - end[:-1] if not nothing else np.zeros(0, np.int64)
    between = raw[np.minimum(end[:-1], size - 1)] if not nothing else np.zeros(0, np.uint32)
    plain_number = (digits == length) & (letters == 0)
    if len(begin) > 2:
        slim = np.isin(between, [ord("."), ord("/")]) & (space == 1)
        short, four = plain_number & (length <= 2), plain_number & (length == 4)
        numeric = short[:-2] & short[1:-1] & four[2:] & slim[:-1] & slim[1:]
        one_blank = (space == 1) & ((flag[np.minimum(end[:-1], size - 1)] & BLANK) > 0)
        dotted_day = (space == 2) & (between == ord(".")) & ((flag[np.minimum(end[:-1] + 1, size - 1)] & BLANK) > 0)
        month = (letters == length) & (length >= 3) & (length <= 10)
        named = short[:-2] & month[1:-1] & four[2:] & (one_blank | dotted_day)[:-1] & one_blank[1:]
        at = np.flatnonzero(numeric | named)
        kind[at] = DATE
        kind[at + 1] = kind[at + 2] = 0
    # Numbers go on behind a dot, comma, colon or slash; words with dots inside are a link, or written like one.
    joined = (space == 1) & np.isin(between, [ord(c) for c in ".,:/"]) & (digits[:-1] > 0) & (letters[:-1] == 0) & (letters[1:] == 0)
    kind[1:][joined] = 0
    dots = (space == 1) & (between == ord(".")) & (letters[:-1] > 0) & (letters[1:] > 0) & (length[:-1] >= 2) & (length[1:] >= 2)
    kind[1:][dots] = 0
    kind[:-1][dots & ~np.concatenate(([False], dots[:-1]))] = LINK
    kept = kind > 0
    spot, kind = np.concatenate((begin[kept], link_at)), np.concatenate((kind[kept], np.full(len(link_at), LINK)))
    by = np.argsort(spot, kind="stable")
    spot, kind = spot[by], kind[by]
    seg = segment(spot)
    tally = lambda k: np.bincount(seg[kind == k], minlength=n)
    tokens = np.maximum(np.bincount(seg, minlength=n), 1)
    link, code, price, date = tally(LINK), tally(CODE), tally(PRICE), tally(DATE)
    sep_at = np.flatnonzero(has(SEPARATOR) & ~linked)
    seps, tags = count(sep_at), count(sep_at[raw[sep_at] == ord("#")])

    # Words and pairs of neighbouring words that come again.
    w_begin, w_end = _runs((flag & (LETTER | MARK | DIGIT)) > 0)
    w_seg, w_hash = segment(w_begin), _hashes(low, w_begin, w_end)
    words = np.bincount(w_seg, minlength=n)
    different = _distinct(w_seg, w_hash, n)
    side = w_seg[1:] == w_seg[:-1]
    pair_seg, pair = w_seg[1:][side], (w_hash[:-1] * _STEP + w_hash[1:])[side]
    again = np.bincount(pair_seg, minlength=n) - _distinct(pair_seg, pair, n)

    stopped = np.where(calls, again == 0, ends)
    prose = stopped & (tokens >= 3) & (tokens <= LONGEST_SENTENCE) & (seps < 0.35 * tokens) & (again < REPEATED_PAIRS * words)
    lead = flag[first]
    # A reference: its number, then a link.
    t_first = np.searchsorted(seg, np.arange(n))
    t_last = max(len(seg) - 1, 0)
    second = np.minimum(t_first + 1, t_last)
    if len(seg):
        numbered = (kind[np.minimum(t_first, t_last)] == NUMBER) & (kind[second] == LINK) & (seg[second] == np.arange(n)) & (spot[second] - first <= 8)
        numbered &= linked[spot[second]]
        numbered &= ((lead & DIGIT) > 0) | np.isin(raw[first], [ord(c) for c in "[(^"])
    else:
        numbered = np.zeros(n, bool)
    what = np.select(
        [
            numbered, (link >= 1) & ~(prose & (tokens > 12 * link)), ~prose & (date >= 1), ~prose & (price >= 1) & (code >= 1), ~prose & (code >= 0.25 * tokens), prose,
            (tags >= TAGS) & (tags >= 0.3 * tokens), (tokens >= 8) & ((seps >= LIST_SEPARATORS * tokens) | (different < REPEATING * words)), tokens >= RUN_ON, (tokens >= 5) & (chars >= GLUED * tokens),
        ],
        [FACT, LINKS, FACT, PRODUCT, FACT, SENTENCE, KEYWORD, KEYWORD, KEYWORD, KEYWORD],
        HEADING,
    )

    # Shapes. Of sentences, tokens and other characters in order; capitals and numbers in a row count once.
    other = np.flatnonzero(~gap & ((flag & (LETTER | MARK | DIGIT | INNER)) == 0) & ~linked)
    place, value = np.concatenate((spot, other)), np.concatenate((kind, raw[other].astype(np.int64) + 8))
    by = np.argsort(place, kind="stable")
    place, value = place[by], value[by]
    e_seg = segment(place)
    twice = np.zeros(len(value), bool)
    twice[1:] = (value[1:] == value[:-1]) & (e_seg[1:] == e_seg[:-1]) & ((value[1:] == CAPITAL) | (value[1:] == NUMBER))
    value, e_seg = value[~twice], e_seg[~twice]
    ordered = _hashes(value, np.searchsorted(e_seg, np.arange(n)), np.searchsorted(e_seg, np.arange(n), side="right"))
    marks = np.zeros(n, np.uint64)
    for k in (DATE, LINK, PRICE, CODE):
        marks |= (tally(k) > 0).astype(np.uint64) << np.uint64(k)
    for i, c in enumerate(SEPARATORS):
        marks |= (count(sep_at[raw[sep_at] == ord(c)]) > 0).astype(np.uint64) << np.uint64(8 + i)
    magnitude = np.minimum(np.floor(np.log2(tokens)), 8).astype(np.uint64)
    shape = np.where(what == SENTENCE, ordered, marks) * np.uint64(16) + magnitude
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    return {"text": np.searchsorted(ends_at, first, side="right"), "shape": shape.view(np.int64), "kind": what, "chars": chars, "repeats": again > 0}


def stuffed_characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, those in its FEW_SHAPES largest stuffed shapes) of every text; 0 and 0 for a blank one."""
    parts: list[dict[str, np.ndarray]] = []
    held: list[str] = []
    ids: list[int] = []

    def flush() -> None:
        if held:
            part = segment_shapes(held)
            parts.append(part | {"text": np.array(ids, np.int64)[part["text"]]})
            held.clear()
            ids.clear()

    size = 0
    for i, text in enumerate(texts):
        begin = 0
        while begin < len(text):  # a long text goes in pieces, at line breaks
            end = len(text) if len(text) - begin <= BLOCK_CHARS else text.find("\n", begin + BLOCK_CHARS)
            end = len(text) if end < 0 else end
            if size + end - begin > BLOCK_CHARS:
                flush()
                size = 0
            held.append(text[begin:end])
            ids.append(i)
            size += end - begin
            begin = end + 1
    flush()
    if not parts:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    text, shape, kind, chars, repeats = (np.concatenate([p[k] for p in parts]) for k in ("text", "shape", "kind", "chars", "repeats"))
    by = np.lexsort((shape, kind, text))
    text, shape, kind = text[by], shape[by], kind[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (kind[1:] != kind[:-1]) | (shape[1:] != shape[:-1])
    at = np.flatnonzero(new)
    segments = np.diff(np.append(at, len(text)))
    g_chars, g_again = np.add.reduceat(chars[by], at), np.add.reduceat(repeats[by].astype(np.int64), at)
    text, kind = text[at], kind[at]
    letter = (kind == SENTENCE) & (segments >= FORM_LETTER)
    per_text = lambda w: np.bincount(text, w, len(texts))
    letters, again = per_text(np.where(letter, segments, 0)), per_text(np.where(letter, g_again, 0))
    phrased = (letters > 0) & (again >= PHRASE_SHARE * letters)
    stuffing = np.where((kind >= LINKS) | (letter & phrased[text]), g_chars, 0)
    by = np.lexsort((-stuffing, text))
    rank = np.arange(len(by)) - np.searchsorted(text[by], text[by])
    few = np.bincount(text[by], np.where(rank < FEW_SHAPES, stuffing[by], 0), len(texts))
    return per_text(g_chars).astype(np.int64), few.astype(np.int64)


def page_shapes(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, chars, stuffed_chars, stuffed), a row per row with text; null, empty and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, few = stuffed_characters(batch.column(1).to_pylist())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars), pa.array(few), pa.array(few > STUFFED_SHARE * chars)], ["doc_id", "chars", "stuffed_chars", "stuffed"])
            yield made.filter(pa.array(chars > 0))

    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    return spread(read, "doc_id").mapInArrow(run, "doc_id bigint, chars bigint, stuffed_chars bigint, stuffed boolean")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that are stuffed; null, empty and blank texts never are."""
    return page_shapes(documents).where(F.col("stuffed")).select("doc_id").distinct()

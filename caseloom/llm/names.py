"""Names of persons and companies: taking apart, and likeness of two of them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# What stands beside a person's name without being part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lord lady rev hon esq obe mbe cbe phd jr sr".split())
# Short forms of given names.
SHORT_FORMS = {
    "abigail": "abby gail", "alexander": "alex xander sandy al", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony ant",
    "barbara": "barb babs", "benjamin": "ben benjy benny", "catherine": "cathy kate katie", "charles": "charlie chuck", "charlotte": "lottie charlie",
    "christine": "chris tina", "christopher": "chris kit", "cornelius": "neil con", "daniel": "dan danny", "david": "dave davy",
    "deborah": "debbie debs deb", "dorothy": "dot dolly dottie", "edward": "ned eddie ted ed", "eleanor": "ellie nell nora",
    "elizabeth": "beth lizzie liz betty eliza", "frances": "fran", "francis": "frank", "frederick": "fred freddie", "gabrielle": "gaby gabby",
    "geoffrey": "geoff", "george": "georgie", "gerald": "gerry", "gregory": "greg", "harold": "harry", "harriet": "hattie", "helen": "nell",
    "henry": "harry hal", "isabella": "izzy bella", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny",
    "jonathan": "jon jonny", "joseph": "joe joey", "joshua": "josh", "katherine": "kate katie kathy kitty", "kenneth": "ken kenny",
    "lawrence": "larry laurie", "leonard": "len lenny leo", "louise": "lou", "margaret": "meg maggie peggy marge", "martin": "marty",
    "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey", "natalia": "tasha nat", "nathaniel": "nat nate", "nicholas": "nick nicky",
    "nicola": "nicky", "pamela": "pam", "patricia": "pat trish patsy", "patrick": "pat paddy", "penelope": "penny nell", "peter": "pete",
    "philip": "phil", "philippa": "pippa", "rachel": "rae", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick richie rich",
    "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally", "stephen": "steve stevie",
    "steven": "steve", "stuart": "stu", "susan": "sue susie", "susannah": "sue susie", "terence": "terry", "theodora": "thea dora",
    "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "valerie": "val", "victor": "vic",
    "victoria": "vicky tori vic", "vincent": "vince", "walter": "wally walt", "william": "bill will billy willy", "winifred": "freda win winnie",
    "zachary": "zach zack",
}
_FULL: dict[str, frozenset[str]] = {}
for _name, _shorts in SHORT_FORMS.items():
    for _s in [_name, *_shorts.split()]:
        _FULL[_s] = _FULL.get(_s, frozenset()) | {_name}
# Legal forms and other words that don't tell companies apart.
LEGAL_WORDS = frozenset(
    "limited ltd lmtd ltda plc llp lp inc incorporated corp corporation co company gmbh ag sa sarl bv nv cic pty the uk".split()
)
_LEGAL_PHRASES = re.compile(r"\b(limited liability partnership|public limited company|private limited company|l ?l ?p|p ?l ?c|l ?t ?d)\b")
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


@lru_cache(20_000)
def fold(text: str) -> str:
    """Lower case, without accents; what is no letter or digit of any script becomes one blank, apostrophes vanish."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().translate(_LETTERS)
    t = re.sub(r"[’'`]", "", t)
    return re.sub(r"[\W_]+", " ", t).strip()


@lru_cache(50_000)
def osa(a: str, b: str, most: int = 3) -> int:
    """Edits between a and b, a swap of neighbours counting one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(20_000)
def sounded(word: str) -> str:
    """One spelling for letters that sound alike, doubled letters once; q-grams and edits are counted on it."""
    for old, new in (("ph", "f"), ("qu", "kw"), ("ck", "k"), ("c", "k"), ("x", "ks"), ("ie", "y"), ("ey", "y")):
        word = word.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", word)


def is_short_for(short: str, word: str) -> bool:
    """Whether short abbreviates word: same first letter, its letters in order, and clearly shorter."""
    if len(short) < 2 or len(short) > 0.85 * len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short.removesuffix("s") or short)


def person_parts(name: str | None, given_words: frozenset[str] = frozenset()) -> tuple[str, tuple[str, ...]]:
    """(surname, given names and initials), titles left out; ('', ()) if nothing is left.

    With a comma the surname stands first. Without one it is the first or the
    last word: not an initial, and not a word of given_words where the other
    isn't one either; else the last, or the first if only that is in capitals.
    """
    if not name:
        return "", ()
    parts = [[w for w in fold(p).split() if w not in TITLES] for p in name.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return "", ()
    if len(parts) > 1:
        return " ".join(parts[0]), tuple(w for p in parts[1:] for w in p)
    words = parts[0]
    if len(words) == 1:
        return words[0], ()
    first, last = words[0], words[-1]
    given = lambda w: len(w) == 1 or w in given_words or w in _FULL
    if given(first) != given(last):
        at_end = given(first)
    else:
        raw = [w for w in re.split(r"\s+", name.strip()) if fold(w) in (first, last)]
        at_end = not (len(raw) > 1 and raw[0].isupper() and len(raw[0]) > 1 and not raw[-1].isupper())
    return (last, tuple(words[:-1])) if at_end else (first, tuple(words[1:]))


@lru_cache(200_000)
def same_given(a: str, b: str) -> float:
    """Likeness of two given names: 1 equal, less for short forms, initials and typos, 0 for different ones."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        short, full = (a, b) if len(a) == 1 else (b, a)
        firsts = {full[0]} | {f[0] for f in _FULL.get(full, ())}
        return 0.8 if short in firsts else 0.0
    fa, fb = _FULL.get(a, frozenset()), _FULL.get(b, frozenset())
    if fa & fb:
        return 0.95
    if fa and fb:
        return 0.0
    most = 1 if min(len(a), len(b)) < 6 else 2
    if sounded(a) == sounded(b) or osa(a, b) <= most:
        return 0.85
    for known, typed in ((fa, b), (fb, a)):
        for full in known:
            if any(osa(sounded(typed), sounded(s)) <= 1 for s in [full, *SHORT_FORMS[full].split()] if len(s) > 3):
                return 0.8
    return 0.0


@lru_cache(200_000)
def same_surname(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    a, b = a.replace(" ", ""), b.replace(" ", "")
    edits = min(osa(a, b), osa(sounded(a), sounded(b)) + 1)
    return 1 - edits / max(len(a), len(b)) if edits <= (0 if n < 4 else 1 if n < 7 else 2) else 0.0


def person_likeness(a: tuple[str, tuple[str, ...]], b: tuple[str, tuple[str, ...]]) -> float:
    """Monge-Elkan likeness of two persons' names, 0 where a part contradicts the other.

    The surname counts double. Given names are compared in order; one that the
    other name lacks counts nothing. A single swap of first and middle name is allowed.
    """
    s = same_surname(a[0], b[0])
    if not s or not a[0]:
        return 0.0
    ga, gb = a[1], b[1]
    if not ga or not gb:
        return (2 * s + 0.5) / 3
    n = min(len(ga), len(gb))
    each = [same_given(x, y) for x, y in zip(ga, gb, strict=False)]
    if n > 1 and min(each) == 0.0:
        crossed = [same_given(ga[0], gb[1]), same_given(ga[1], gb[0])]
        each = crossed if min(crossed) > 0 else each
    if min(each) == 0.0:
        return 0.0
    return (2 * s + sum(each) / n) / 3


@lru_cache(20_000)
def company_words(name: str | None) -> tuple[str, ...]:
    """A company's telling words, in order; legal forms left out unless nothing else is left."""
    t = (name or "").replace("&", " and ")
    if re.search(r"\b[a-z][A-Z]{2}", t) and not re.search(r"\b[A-Z][a-z]", t):  # typed with the wrong shift
        t = t.swapcase()
    t = fold(re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", t))
    words = _LEGAL_PHRASES.sub(" ", t).split()
    kept = tuple(w for w in words if w not in LEGAL_WORDS)
    return kept or tuple(words)


@lru_cache(50_000)
def same_word(a: str, b: str) -> float:
    """Likeness of two telling words: equal, abbreviated, or a typo apart; else 0."""
    if a == b:
        return 1.0
    edits = osa(a, b, 2)
    n = min(len(a), len(b))
    if edits <= (0 if n < 4 else 1 if n < 8 else 2):
        return 1 - edits / max(len(a), len(b))
    if is_short_for(a, b) or is_short_for(b, a):
        return 0.9
    for short, full in ((a, b), (b, a)):  # an abbreviation with a typo
        if 4 <= len(short) < len(full) and osa(short, full[: len(short)], 1) <= 1 and short[0] == full[0]:
            return 0.75
    return 0.0


def company_likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Monge-Elkan likeness in which every word must find one of its own in the other name; 0 if a telling word is left over.

    Words run together are compared as one string as well.
    """
    if not a or not b:
        return 0.0
    if a == b or sorted(a) == sorted(b):
        return 1.0
    ja, jb = "".join(a), "".join(b)
    joined = 1 - osa(ja, jb, 2) / max(len(ja), len(jb)) if len(a) != len(b) and osa(ja, jb, 2) <= 2 else 0.0
    if len(a) == len(b):
        free, total = list(b), 0.0
        for w in sorted(a, key=len, reverse=True):
            best = max(free, key=lambda v: same_word(w, v))
            s = same_word(w, best)
            if s == 0.0:
                return joined
            total += s
            free.remove(best)
        return max(joined, total / len(a))
    few, many = (a, b) if len(a) < len(b) else (b, a)
    if len(many) - len(few) <= 2:  # two words written as one, the others in any order
        best = joined
        for i in range(len(many)):
            for j in range(len(many)):
                if i != j:
                    rest = [w for k, w in enumerate(many) if k not in (i, j)]
                    merged = (*rest, many[i] + many[j])
                    glued = [w for w in few if len(w) > max(len(many[i]), len(many[j]))]
                    if len(merged) == len(few) and any(_glued(w, many[i], many[j]) for w in glued):
                        w = next(w for w in glued if _glued(w, many[i], many[j]))
                        left = tuple(x for x in few if x is not w)
                        if not left or (len(left) == len(rest) and company_likeness(left, tuple(rest)) > 0):
                            best = max(best, 0.9)
        return best
    return joined


def _glued(word: str, x: str, y: str) -> bool:
    """Whether word is x and y written as one, a typo or an abbreviation of y allowed."""
    if osa(word, x + y, 2) <= 2:
        return True
    rest = word[len(x) :]
    return word.startswith(x) and len(rest) > 1 and is_short_for(rest, y)

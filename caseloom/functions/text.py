"""Text derivations as Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words before a person's name that are no part of it.
HONORIFICS = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "lord", "lady")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse_space(c: Column) -> Column:
    """Runs of white space, of any script, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_for_match(c: Column) -> Column:
    """Quotes and dashes made plain, white space collapsed, case folded (with ss for sharp s)."""
    plain = F.translate(c, "‘’‚‛“”„‟‐‑‒–—―−", "''''\"\"\"\"-------")
    return F.replace(F.lower(collapse_space(plain)), F.lit("ß"), F.lit("ss"))


def company_number(c: Column) -> Column:
    """Eight characters: six to eight digits, padded, or two letters and six digits; null for anything else."""
    bare = F.upper(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.when(bare.rlike(r"^\d{6,8}$"), F.lpad(bare, 8, "0")).when(bare.rlike(r"^[A-Z]{2}\d{6}$"), bare)


def title_key(c: Column) -> Column:
    """Lower case; runs of what is no ASCII letter or digit as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def name_tokens(c: Column) -> Column:
    """Sorted words of a person's name without honorifics; repeated words stay."""
    drop = F.array(*(F.lit(h) for h in HONORIFICS))
    return F.array_sort(F.filter(F.split(title_key(c), " "), lambda t: (t != "") & ~F.array_contains(drop, t)))


def officer_id(link: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.trim(link), r"^/officers/([^/]+)/appointments/?$", 1))


def birth_text(year: Column, month: Column) -> Column:
    """YYYY-MM, or YYYY without a valid month; null without a year."""
    return F.when(month.between(1, 12), F.format_string("%04d-%02d", year, month)).when(year.isNotNull(), F.format_string("%04d", year))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def source_domain(url: Column) -> Column:
    """Lower-case host with its port, without a leading www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the path's end, the query kept, no fragment."""
    t = F.trim(url)
    head = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(head, path, F.regexp_extract(t, r"^[^?#]*(\?[^#]*)", 1))


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def shorten(c: Column, most: int = 280) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def slug(c: Column, most: int = 60, default: str = "company") -> Column:
    cut_ = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.coalesce(F.nullif(F.regexp_replace(cut_, "-+$", ""), F.lit("")), F.lit(default))


def full_years(start: Column, end: Column) -> Column:
    """Whole years between two dates, none if the end lies before."""
    early = F.date_format(end, "MMdd") < F.date_format(start, "MMdd")
    return F.greatest(F.lit(0), F.year(end) - F.year(start) - early.cast("int"))


def safe_params(params: Column) -> Column:
    """Parameters whose name speaks of no secret."""
    return F.map_filter(params, lambda k, v: ~k.rlike("(?i)(key|token|secret|auth|password)"))


def folder_number(c: Column) -> Column:
    """A company's number in lower case if it may name a folder (one to ten ASCII letters and digits); else null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[A-Za-z0-9]{1,10}$"), F.lower(t))


def escape_bars(c: Column) -> Column:
    """Text for a table's cell."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def without_fence(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def canonical_json(params: Column) -> Column:
    """A map of texts as compact JSON, its keys sorted; null values are empty."""
    entries = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("")).alias("value")))
    return F.to_json(F.map_from_entries(entries))


def marked(c: Column, pattern: str) -> Column:
    """The first group of the first place that fits the pattern; '' without one."""
    return F.regexp_extract(c, pattern, 1)

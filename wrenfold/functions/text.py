"""Scalar functions: identifiers, headers, amounts, dates, contacts, tags. All are built-in column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of identifiers.
ISRC, ISWC, ISNI = "^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$", "^T[0-9]{10}$", "^[0-9]{15}[0-9X]$"


def squeezed(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]", ""))


def canonical(c: Column, shape: str) -> Column:
    """Upper case without punctuation, or "" if it hasn't the shape."""
    s = squeezed(c)
    return F.when(s.rlike(shape), s).otherwise("")


def canonical_gtin(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when(F.length(digits).isin(8, 12, 13, 14), F.lpad(digits, 14, "0")).otherwise("")


def _folds() -> tuple[str, str, dict[str, str]]:
    """What NFKD without non-ASCII characters makes of Latin letters: characters that become one, and those that become several or none."""
    one, several = {}, {}
    for point in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        ascii_only = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        (one if len(ascii_only) == 1 else several)[chr(point)] = ascii_only
    return "".join(one), "".join(one.values()), {k: v for k, v in several.items() if v}


def ascii_folded(c: Column) -> Column:
    """Accents folded to their letters, all else that isn't ASCII dropped."""
    letters, plain, several = _folds()
    out = F.translate(c, letters, plain)
    for sign, letters in several.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return F.regexp_replace(out, r"[^\x00-\x7F]+", "")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_folded(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\(\)\[\]:]", " "), r"[\s_\-]+", " "))


def parse_amount(c: Column) -> Column:
    """An exact amount, accounting negatives included; NULL if it can't be read (never 0)."""
    bare = F.regexp_replace(F.trim(c), r"[$€£,\s]", "")
    sign = F.when(bare.rlike(r"^\(.*\)$"), "-").otherwise("")
    return F.concat(sign, F.regexp_replace(bare, r"[()]", "")).try_cast("decimal(18,6)")


def parse_count(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[,\s]", "").try_cast("long")


def parse_day(c: Column) -> Column:
    """A day in one of the formats; a month alone isn't a day."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")])


def month_bounds(c: Column) -> tuple[Column, Column]:
    first = F.trunc(c, "month")
    return first, F.last_day(first)


def territory(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).otherwise(F.substring(t, 1, 64))


def normalise_email(c: Column) -> Column:
    """The first recipient without scheme and query, only its domain in lower case; "" if it is none."""
    one = F.trim(F.split_part(F.split_part(F.regexp_replace(c, "^mailto:", ""), F.lit("?"), F.lit(1)), F.lit(","), F.lit(1)))
    mail = F.concat(F.split_part(one, F.lit("@"), F.lit(1)), F.lit("@"), F.lower(F.split_part(one, F.lit("@"), F.lit(2))))
    return F.when(mail.rlike(r"^[^@\s]+@[a-z0-9-]+(\.[a-z0-9-]+)+$"), mail).otherwise("")


def normalise_phone(c: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.regexp_replace(c, "^tel:", ""), r"[^0-9+()\-. ]", ""))
    return F.when(F.length(F.regexp_replace(kept, "[^0-9]", "")) >= 7, kept).otherwise("")


def clean_tags(c: Column, sep: str = ",") -> Column:
    """Trimmed, lower-cased tags in their order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, sep), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def strip_html(c: Column, cap: int) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&nbsp;", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.rtrim(F.substring(F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")), 1, cap))


def infobox_value(c: Column) -> Column:
    """A wikitext value as a plain string: without markup, a link by its target, no trailing "(format)", tags or punctuation, in lower case."""
    bare = F.split_part(F.regexp_replace(c, r"\[\[|\]\]|\{\{|\}\}|'{2,}", ""), F.lit("|"), F.lit(1))
    bare = F.regexp_replace(bare, r"(?i)\s*\((?:radio\s+)?format\)\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", ""), r"\s+", " ")
    return F.lower(F.regexp_replace(bare, "^[ .,;]+|[ .,;]+$", ""))


def bar_offset(at: Column, grid: Column, bar: Column) -> Column:
    """How far a time lies from the nearest bar line."""
    rest = F.pmod(at - grid, bar)
    return F.least(rest, bar - rest)


def snapped(at: Column, grid: Column, bar: Column) -> Column:
    """The nearest bar line."""
    return F.bround(grid + F.bround((at - grid) / bar) * bar).cast("long")


# The shortest and longest loop, in milliseconds.
SHORTEST_LOOP, LONGEST_LOOP = 3000, 10000


def suggested_window(start: Column, end: Column, grid: Column, bar: Column, plateau: Column) -> tuple[Column, Column]:
    """A section's window by the rules, or nulls: from a bar line, as many whole bars as fit into the section, the plateau (null: none) and the longest loop; too short a loop grows to the next multiple of bars if the section has room."""
    first = F.greatest(F.lit(0), snapped(start, grid, bar))
    bars = F.floor(F.least(end - first, F.coalesce(plateau.cast("long"), end - first), F.lit(LONGEST_LOOP)) / bar)
    length = F.bround(bars * bar).cast("long")
    needed = F.ceil(F.lit(SHORTEST_LOOP) / F.floor(bar))
    grown = F.when(first + needed * bar <= end, F.bround(needed * bar).cast("long"))
    found = F.when((bars >= 1) & (length >= SHORTEST_LOOP), length).when(bars >= 1, grown)
    return F.when(found.isNotNull(), first), first + found

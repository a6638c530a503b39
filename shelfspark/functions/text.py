"""Text, code, date and similarity expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate an expression once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(c, body) -> Column:
    """``body`` of a value mentioned several times: a column's name stands as it is, an expression
    is evaluated once, not once for every mention."""
    return body(F.col(c)) if isinstance(c, str) else let(c, body)


def fixed_map(table: dict) -> Column:
    """A map of fixed texts, sent to the planner as two texts and folded there: written entry by
    entry, a long table is thousands of expressions in every place that mentions it."""
    keys, values = ("\0".join(part) for part in (table.keys(), table.values()))
    return F.map_from_arrays(F.split(F.lit(keys), "\0"), F.split(F.lit(values), "\0"))


def text_or_empty(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def blank(c) -> Column:
    """NULL or nothing but white space."""
    return F.trim(text_or_empty(c)) == ""


def filled(c) -> Column:
    return ~blank(c)


def none_if_empty(c) -> Column:
    return once(c, lambda c: F.when(c != "", c))


def extract(c, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL instead of '' when nothing matched."""
    return none_if_empty(F.regexp_extract(col(c), pattern, group))


def contains_any(c, words) -> Column:
    """The text contains at least one of the words (one alternation, no join)."""
    quoted = "|".join("\\Q" + w + "\\E" for w in words)
    return F.coalesce(col(c).rlike(quoted), F.lit(False))


def strip_chars(c, chars: str) -> Column:
    return F.trim(col(c), F.lit(chars))


# --- accents -----------------------------------------------------------------

# Blocks whose compatibility decomposition the folding covers.
_BLOCKS = ((0x00A0, 0x024F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x209F),
           (0x2100, 0x218F), (0x2460, 0x24FF), (0x3200, 0x33FF), (0xFB00, 0xFB06), (0xFF01, 0xFF5E))
_MARKS = "".join(chr(c) for c in range(0x0300, 0x0370))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their one-letter bases, multi-letter expansions), by rule."""
    source, target, longer = [], [], []
    for low, high in _BLOCKS:
        for point in range(low, high + 1):
            char = chr(point)
            plain = "".join(c for c in unicodedata.normalize("NFKD", char)
                            if not unicodedata.combining(c))
            if plain == char:
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            elif plain.strip():
                longer.append((char, plain))
    return "".join(source), "".join(target), tuple(longer)


def _class(points) -> str:
    """A character class of the given code points, written as ranges."""
    ranges: list[list[int]] = []
    for point in sorted(points):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def strip_accents(c) -> Column:
    """Compatibility-decompose and drop the combining marks.

    ASCII values (as many bytes as characters) pass unchanged, others are translated
    letter by letter.  Characters expanding to several (ligatures, fractions, roman
    numerals, units) are looked for only where a short class finds anything beyond
    Latin letters; of those found, each distinct one is replaced once.
    """
    source, target, longer = _decompositions()
    points = [ord(char) for char, _ in longer]
    wide = fixed_map(dict(longer))
    maybe = _class({p for p in points if p < 0x180} | set(range(0x180, 0x110000)))

    def stripped(c):
        plain = F.translate(c, source + _MARKS, target)
        found = F.array_distinct(F.regexp_extract_all(plain, F.lit(_class(points)), F.lit(0)))
        expanded = F.aggregate(found, plain, lambda text, x: F.replace(text, x, wide[x]))
        return F.when(F.octet_length(c) == F.char_length(c), c).when(c.rlike(maybe), expanded).otherwise(plain)
    return once(c, stripped)


def fold_text(c, punct: str = "space") -> Column:
    """Accent-free lower case.  ``punct='space'`` turns everything else into one
    blank (``l'été`` -> ``l ete``); ``punct='drop'`` deletes it (``lete``)."""
    lowered = F.lower(strip_accents(text_or_empty(c)))
    if punct == "space":
        return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))
    if punct == "drop":
        # the runs that stay, put together: looking for the letters that go is slow where they are rare
        return F.trim(F.array_join(F.regexp_extract_all(lowered, F.lit("[a-z0-9 ]+"), F.lit(0)), ""))
    raise ValueError("punct is 'space' or 'drop'")


def fold_key(c) -> Column:
    """Accent-free lower case with white space collapsed; punctuation stays."""
    lowered = F.lower(strip_accents(text_or_empty(c)))
    return F.trim(F.regexp_replace(lowered, "(?U)\\s+", " "))


# --- identifiers ---------------------------------------------------------------

def clean_code(c) -> Column:
    return F.regexp_replace(text_or_empty(c), "[^0-9Xx]", "")


def isbn10_to_ean13(c) -> Column:
    """978 + the nine digits + the weighted modulo-10 check digit."""
    base = F.concat(F.lit("978"), F.substring(F.upper(F.trim(col(c))), 1, 9))
    total = None
    for i in range(12):
        digit = (F.ascii(F.substring(base, i + 1, 1)) - 48) * (1 if i % 2 == 0 else 3)
        total = digit if total is None else total + digit
    check = F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))
    return F.concat(base, check.cast("string"))


def choose_identifier(ean, isbn, barcode) -> Column:
    """Valid EAN-13, else ISBN-13, else converted ISBN-10, else the raw EAN,
    else ``CB:`` + barcode."""
    return once(clean_code(ean), lambda e: once(clean_code(isbn), lambda i: once(barcode, lambda b: choose_code(e, i, b))))


def choose_code(e: Column, i: Column, barcode: Column) -> Column:
    """The identifier of codes that are clean already."""
    return F.coalesce(
        F.when(e.rlike("^[0-9]{13}$"), e),
        F.when(i.rlike("^[0-9]{13}$"), i),
        F.when(i.rlike("^[0-9]{9}[0-9Xx]$"), isbn10_to_ean13(i)),
        F.when(e != "", e),
        F.when(filled(barcode), F.concat(F.lit("CB:"), barcode)),
    )


def has_ean(c) -> Column:
    return ~F.coalesce(col(c).startswith("CB:"), F.lit(False))


def valid_ean(c) -> Column:
    """Exactly thirteen digits, else NULL (a float's ``.0`` tail is dropped)."""
    code = F.regexp_replace(F.trim(col(c)), "\\.0$", "")
    return F.when(code.rlike("^[0-9]{13}$"), code)


def safe_int(c) -> Column:
    """Whole number, floats truncated; blank or unreadable gives NULL."""
    return F.trim(col(c)).try_cast("double").try_cast("bigint")


def leading_int(c) -> Column:
    """``12a`` -> 12; no leading digit gives NULL."""
    return F.regexp_extract(col(c), "^\\s*(\\d+)", 1).try_cast("bigint")


# --- dates ---------------------------------------------------------------------

def fr_datetime(c) -> Column:
    """``dd/MM/yyyy HH:mm`` or ``dd/MM/yyyy`` to an ISO text, else NULL."""
    raw = F.trim(col(c))
    stamped = F.try_to_timestamp(raw, F.lit("dd/MM/yyyy HH:mm"))
    dated = F.try_to_timestamp(raw, F.lit("dd/MM/yyyy"))
    return F.coalesce(F.date_format(stamped, "yyyy-MM-dd HH:mm"),
                      F.date_format(dated, "yyyy-MM-dd"))


def pub_year(c, keep_raw: bool = False) -> Column:
    """Four-digit year in ``YYYY``, ``YYYY-MM-DD`` or ``DL 2026``."""
    year = extract(c, "((?:19|20)\\d{2})")
    return F.coalesce(year, none_if_empty(c)) if keep_raw else year


def yyyymmdd(c) -> Column:
    """``20260805...`` -> ``2026-08-05``; anything else NULL."""
    c = col(c)
    return F.when(c.rlike("^[0-9]{8}"),
                  F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2),
                              F.substring(c, 7, 2)))


def file_date(c) -> Column:
    """``YYYY-MM-DD`` found in a file name."""
    return extract(c, "(\\d{4}-\\d{2}-\\d{2})[^/]*$")


# --- names, marks, addresses ------------------------------------------------------

def shelf_zone(c) -> Column:
    """Leading letters of a shelfmark, upper case."""
    letters = F.regexp_extract(F.trim(text_or_empty(c)), "^([A-Za-z]+)", 1)
    return F.when(letters != "", F.upper(letters)).otherwise("(sans cote)")


def series_name(c) -> Column:
    """The part before ``/`` and ``[``."""
    return none_if_empty(F.trim(F.regexp_extract(col(c), "^([^/\\[]*)", 1)))


def series_key(c) -> Column:
    return strip_chars(F.lower(col(c)), " .")


def author_first(c, surname_only: bool = False) -> Column:
    """First of the ``;``-separated authors; also cut at ``,`` for keys."""
    stop = "^([^;,]*)" if surname_only else "^([^;]*)"
    return F.trim(F.regexp_extract(text_or_empty(c), stop, 1))


def title_author_key(title, author) -> Column:
    return F.concat(fold_text(title, "drop"), F.lit("|"),
                    fold_text(author_first(author, surname_only=True), "drop"))


def director_letters(c) -> Column:
    """Three letters of the first creator's surname (two allowed)."""
    first = F.regexp_extract(text_or_empty(c), "^([^;/]*)", 1)
    surname = F.regexp_extract(F.trim(first), "^([^,(]*)", 1)
    letters = F.regexp_replace(strip_accents(surname), "[^A-Za-z]", "")
    return F.when(F.length(letters) >= 2, F.upper(F.substring(letters, 1, 3)))


def canonical_url(c) -> Column:
    """Without query or fragment, ending in ``/``."""
    bare = F.regexp_extract(col(c), "^([^?#]*)", 1)
    return F.when(bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/")))


def slug_title(url, pattern: str = "/list-\\d+/([^/?]+)") -> Column:
    """Readable title from the last part of a list address."""
    words = F.replace(F.regexp_extract(col(url), pattern, 1), F.lit("-"), F.lit(" "))
    return none_if_empty(F.concat(F.upper(F.substring(words, 1, 1)),
                                  F.lower(F.substring(words, 2, 1 << 20))))


def clean_pegi(c) -> Column:
    return extract(c, "(\\d+)")


def word_present(word: str, c) -> Column:
    """Whole-word match; accented letters count as letters."""
    return col(c).rlike("(?U)\\b\\Q" + word.strip() + "\\E\\b")


# --- similarity ----------------------------------------------------------------------

def tokens(c, punct: str) -> Column:
    """Distinct words of the folded text."""
    words = F.split(fold_text(c, punct), " +")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard_of(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def overlap_of(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / longest)


def token_jaccard(a, b) -> Column:
    """Common words over all words (punctuation deleted before splitting)."""
    return jaccard_of(tokens(a, "drop"), tokens(b, "drop"))


def token_overlap_max(a, b) -> Column:
    """Common words over the longer word count (punctuation as blanks)."""
    return overlap_of(tokens(a, "space"), tokens(b, "space"))

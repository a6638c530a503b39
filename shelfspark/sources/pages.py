"""Parsing of stored web pages: links, codes, titles, prices, candidates."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import col, extract, filled, fixed_map, let, none_if_empty, once, text_or_empty
from shelfspark.functions.volumes import extract_series, extract_volume


def unescape_html(c) -> Column:
    """Named and numeric character references decoded."""
    common = fixed_map({n: chr(p) for n, p in name2codepoint.items()})
    rare = fixed_map({n[:-1]: p for n, p in html5.items() if n.endswith(";") and n[:-1] not in name2codepoint})

    def decode(piece):
        name = F.regexp_extract(piece, "^(#?\\w+);", 1)
        decimal = F.regexp_extract(piece, "^#(\\d{1,7});", 1).try_cast("int")
        hexa = F.conv(none_if_empty(F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]{1,6});", 1)), 16, 10).try_cast("int")
        char = F.coalesce(F.try_element_at(common, name), F.try_element_at(rare, name), _char(decimal), _char(hexa))
        tail = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when((name != "") & char.isNotNull(), F.concat(char, tail)).otherwise(
            F.concat(F.lit("&"), piece))

    def decoded(c):
        text = let(F.split(c, "&"), lambda pieces: F.concat(
            F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode), "")))
        return F.when(c.contains("&"), text).otherwise(c)
    return once(c, decoded)


def _char(code: Column) -> Column:
    """Character of a code point (two UTF-8 bytes and more included)."""
    low = F.when(code.between(1, 127), F.char(code))
    two = F.unhex(F.concat(F.hex((F.lit(0xC0) + F.shiftright(code, 6)).cast("bigint")),
                           F.hex((F.lit(0x80) + code.bitwiseAND(63)).cast("bigint"))))
    three = F.unhex(F.concat(
        F.hex((F.lit(0xE0) + F.shiftright(code, 12)).cast("bigint")),
        F.hex((F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(63)).cast("bigint")),
        F.hex((F.lit(0x80) + code.bitwiseAND(63)).cast("bigint"))))
    four = F.unhex(F.concat(
        F.hex((F.lit(0xF0) + F.shiftright(code, 18)).cast("bigint")),
        F.hex((F.lit(0x80) + F.shiftright(code, 12).bitwiseAND(63)).cast("bigint")),
        F.hex((F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(63)).cast("bigint")),
        F.hex((F.lit(0x80) + code.bitwiseAND(63)).cast("bigint"))))
    return F.coalesce(low, F.when(code.between(128, 2047), F.decode(two, "UTF-8")),
                      F.when(code.between(2048, 0xFFFF) & ~code.between(0xD800, 0xDFFF), F.decode(three, "UTF-8")),
                      F.when(code.between(0x10000, 0x10FFFF), F.decode(four, "UTF-8")))


def plain_text(c) -> Column:
    """Text of a fragment: tags out, references decoded, blanks collapsed."""
    bare = F.regexp_replace(col(c), "<[^>]*>", "")
    return F.trim(F.regexp_replace(unescape_html(bare), "(?U)\\s+", " "))


def absolute_url(href: Column, base: Column) -> Column:
    """Absolute address without its fragment."""
    bare = F.regexp_extract(href, "^([^#]*)", 1)
    root = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return _without_dots(
            F.when(bare.rlike("^(?i)https?://"), bare)
            .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), bare))
            .when(bare.startswith("/"), F.concat(root, bare))
            .when(bare.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), bare))
            .otherwise(F.concat(folder, bare)))


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` steps of the path resolved; the query part is left alone."""
    root = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    path = F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)
    steps = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "/\\.{1,2}$", "$0/"), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, step: (
        F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done).otherwise(F.concat(done, F.array(step)))))
    rest = F.substring(url, F.length(root) + F.length(path) + 1, F.length(url))
    return F.when(path.rlike("/\\.{1,2}(/|$)"), F.concat(root, F.lit("/"), F.array_join(walked, "/"), rest)).otherwise(url)


def extract_links(pages: DataFrame, key, url, html, label_length: int = 70) -> DataFrame:
    """Distinct (page, absolute address, label) of the anchors; mail, script and
    in-page links are left out."""
    # one regular expression pass gives both parts of every anchor
    anchors = F.regexp_extract_all(F.col(html), F.lit("(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)[^>]*>.*?</a>"), 0)
    rows = pages.select(key, F.col(url).alias("_base"), F.explode(anchors).alias("_a"))
    href = F.regexp_extract("_a", "(?is)^<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", 1)
    href = F.trim(F.regexp_replace(href, "^[\"']|[\"']$", ""))
    label = F.substring(plain_text(F.regexp_extract("_a", "(?is)^<a\\s(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(.*)</a>$", 1)), 1, label_length)
    usable = (F.col("_h") != "") & ~F.lower("_h").rlike("^(mailto:|javascript:|#)")
    return (rows.withColumn("_h", href).where(usable)
            .select(key, absolute_url(F.col("_h"), F.col("_base")).alias("link"), label.alias("label")).distinct())


# Classes of links and the address patterns, in order.
LINK_CLASSES = (
    ("SELECTIONS", r"/list-\d+/"),
    ("FICHES", r"/livre/\d{9,13}"),
    ("RAYONS", r"/ssh-\d+|/rayon"),
    ("RECHERCHES", r"listeliv|recherche|search"),
)


def classify_links(links: DataFrame, link="link", classes=LINK_CLASSES) -> DataFrame:
    """Class of each link by address pattern, AUTRES otherwise."""
    chain = None
    for name, pattern in classes:
        test = F.col(link).rlike(pattern)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return links.withColumn("link_class", chain.otherwise("AUTRES"))


def product_codes(html, most: int | None = None, pattern: str = r"/livre/(\d{9,13})") -> Column:
    """Distinct codes in order of appearance, at most ``most`` where the feature
    looks at the first few only."""
    codes = F.array_distinct(F.regexp_extract_all(col(html), F.lit(pattern), 1))
    return F.slice(codes, 1, most) if most else codes


def extract_product_codes(pages: DataFrame, key, html, most=None, pattern=r"/livre/(\d{9,13})") -> DataFrame:
    return pages.select(key, F.posexplode(product_codes(html, most, pattern)).alias("place", "code"))


def page_title(html) -> Column:
    return plain_text(F.regexp_extract(col(html), "(?is)<title[^>]*>(.*?)</title>", 1))


def parse_product_title(pages: DataFrame, html, site: str) -> DataFrame:
    """``[SERIES Tome N |] TITLE - AUTHOR - PUBLISHER - SUPPORT - <site>``."""
    body = F.trim(F.regexp_replace(page_title(html), "\\s*-\\s*\\Q" + site + "\\E\\s*$", ""))
    parts = F.filter(F.transform(F.split(body, " - "), lambda p: F.trim(p)), lambda p: p != "")
    out = pages.withColumn("_t", page_title(html)).withColumn("_p", parts)
    name = F.get("_p", F.lit(0))
    series = F.trim(F.regexp_extract(name, r"(?i)^(.*?)\s+Tome\s+(\d+)\s*$", 1))
    return (out.where(F.col("_t").contains(site) & (F.size("_p") > 0))
            .select(*pages.columns, name.alias("title"), F.get("_p", F.lit(1)).alias("author"),
                    F.get("_p", F.lit(2)).alias("publisher"), F.get("_p", F.lit(3)).alias("support"),
                    none_if_empty(series).alias("series"),
                    extract(name, r"(?i)^(.*?)\s+Tome\s+(\d+)\s*$", 2).alias("volume")))


def parse_result_title(pages: DataFrame, html, site: str) -> DataFrame:
    """``SERIES Tome N : TITLE : AUTHOR- categories | <site>``."""
    body = F.trim(F.get(F.split(page_title(html), "\\|"), F.lit(0)))
    parts = F.filter(F.transform(F.split(body, " : "), lambda p: F.trim(p)), lambda p: p != "")
    out = pages.withColumn("_t", page_title(html)).withColumn("_p", parts)
    first, second, third = (F.get("_p", F.lit(i)) for i in range(3))
    pattern = r"(?i)^(.*?)\s+Tome\s+(\d+)\s*$"
    numbered = first.rlike(pattern) & (F.size("_p") >= 2)
    series = F.when(numbered, F.trim(F.regexp_extract(first, pattern, 1)))
    title = (F.when(numbered & (F.size("_p") == 2), series).when(F.size("_p") >= 2, second).otherwise(first))
    author = F.when(numbered & (F.size("_p") == 2), second).otherwise(third)
    author = F.rtrim(F.regexp_extract(author, r"^(.*?)(?:\s*-\s*(?:Livres?|Romans?|BD|Mangas?|CD|DVD)\b.*)?$", 1))
    author = F.regexp_replace(author, "[- ]+$", "")
    return (out.where(F.col("_t").contains(site) & (F.size("_p") > 0))
            .select(*pages.columns, title.alias("title"), series.alias("series"),
                    F.when(numbered, F.regexp_extract(first, pattern, 2)).alias("volume"),
                    none_if_empty(author).alias("author")))


def extract_price(html) -> Column:
    """First price form found, in order of trust."""
    found = [F.replace(F.regexp_extract(col(html), p, 1), F.lit(","), F.lit(".")).try_cast("double")
             for p in V.PRICE_PATTERNS]
    return F.coalesce(*found)


def _labelled(html: Column, words) -> Column:
    """Value following a label in the page, tags between them skipped."""
    names = "|".join(words)
    return none_if_empty(F.trim(F.regexp_extract(
        html, f"(?isU)(?:{names})[^<:]*(?::\\s*|\\s*(?:</?[^>]+>\\s*)+:?\\s*(?:<[^>]+>\\s*)*)([^<]+)", 1)))


def _marked(html: Column, prop: str) -> Column:
    """Text of the element carrying the item property."""
    return none_if_empty(F.trim(F.regexp_extract(html, f'(?is)itemprop="{prop}"[^>]*>\\s*(?:<[^>]+>\\s*)*([^<]+)', 1)))


def parse_candidate_page(pages: DataFrame, html, source, labels=None) -> DataFrame:
    """A product page as a candidate record, by one table of labels.

    Item properties are read first, then ``label: value`` in lists, tables and
    definition lists; type, audience, genre, series and volume follow by rule."""
    labels = labels or V.LABELS
    h = F.col(html)
    heading = none_if_empty(plain_text(F.regexp_extract(h, "(?is)<h1[^>]*>(.*?)</h1>", 1)))
    props = {"author": "author", "publisher": "publisher", "date": "datePublished",
             "collection": "isPartOf", "age": "typicalAgeRange"}
    raw = pages.withColumn("title", F.coalesce(_marked(h, "name"), heading, none_if_empty(page_title(html))))
    for name, words in labels.items():
        if name != "title":
            found = [_marked(h, props[name])] if name in props else []
            raw = raw.withColumn(f"_{name}", unescape_html(F.coalesce(*found, _labelled(h, words))))
    described = F.coalesce(_marked(h, "description"), F.lit(""))
    nothing = F.lit("")
    out = (raw.where(filled("title")).withColumn("abstract", unescape_html(described))
           .withColumn("author", text_or_empty("_author")).withColumn("illustrator", text_or_empty("_illustrator"))
           .withColumn("publisher", text_or_empty("_publisher"))
           .withColumn("year", F.regexp_extract(text_or_empty("_date"), "\\d{4}", 0))
           .withColumn("collection", text_or_empty("_collection")))
    out = out.withColumn("audience", R.detect_audience(nothing, "title", "collection", "publisher", "_age"))
    out = out.withColumn("type", R.detect_type("title", "collection", "abstract", "_genre", nothing,
                                               "publisher", "audience"))
    out = (out.withColumn("genre", R.score_genres("title", "collection", "abstract", "_genre", "type"))
           .withColumn("volume", extract_volume("_volume", "title"))
           .withColumn("pegi", R.detect_pegi("type", "audience", F.regexp_replace(h, "<[^>]*>", " "))))
    return (out.withColumn("series", extract_series(F.col("title"), nothing, F.col("collection"), F.col("volume")))
            .withColumn("source", F.lit(source) if isinstance(source, str) else source)
            .withColumn("state", F.lit("trouvé"))
            .drop(*[f"_{n}" for n in labels]))

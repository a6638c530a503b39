"""News feeds, library responses and book JSON held as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import contains_any, extract, filled, none_if_empty, pub_year, text_or_empty
from shelfspark.functions.volumes import extract_series, extract_volume
from shelfspark.session import materialise
from shelfspark.sources.pages import unescape_html

RSS = "channel struct<item: array<struct<title: string, link: string, description: string>>>"
MARCXML = ("datafield array<struct<_tag: string, subfield: array<struct<_code: string, _VALUE: string>>>>, "
           "controlfield array<struct<_tag: string, _VALUE: string>>")
VOLUMES = ("items array<struct<volumeInfo: struct<title: string, subtitle: string, authors: array<string>, "
           "publisher: string, publishedDate: string, description: string, categories: array<string>, "
           "maturityRating: string, imageLinks: struct<extraLarge: string, large: string, medium: string, "
           "thumbnail: string>>>>")
BIBKEYS = ("map<string, struct<title: string, authors: array<struct<name: string>>, "
           "publishers: array<struct<name: string>>, publish_date: string, "
           "subjects: array<struct<name: string>>>>")


def read_once(read: DataFrame, response: str) -> DataFrame:
    """What was read of the responses, stored without them: every mention of a value, filters
    included, would read the whole response again."""
    return materialise(read.drop(response), "read")


def read_feed(responses: DataFrame, xml: str, reviews_only: bool = False) -> DataFrame:
    """Items of stored RSS responses; ``reviews_only`` keeps book links."""
    parsed = F.from_xml(F.col(xml), RSS)
    rows = (responses.withColumn("_i", F.explode(parsed["channel"]["item"]))
            .select(*[c for c in responses.columns if c != xml], "_i.*"))
    text = unescape_html(text_or_empty("description"))
    author = F.rtrim(F.regexp_replace(F.trim(F.regexp_extract(text, "Auteurs?\\s*:\\s*([^<]+)", 1)), ";+$", ""))
    out = rows.where(filled("title")).select(
        *[c for c in responses.columns if c != xml], F.trim("title").alias("title"),
        F.trim(text_or_empty("link")).alias("link"), none_if_empty(author).alias("author"),
        none_if_empty(F.trim(F.regexp_extract(text, "[EÉ]diteur\\s*:\\s*([^<]+)", 1))).alias("publisher"),
        extract(text, "Date de parution\\s*:\\s*([0-9/]+)").alias("published"))
    return out.where(F.col("link").rlike("/livres?/")) if reviews_only else out


def short_abstract(c: Column, most: int = 1000) -> Column:
    """The display form of a long abstract; the records keep it whole."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def _marc_values(fields: Column, code: str, *tags) -> Column:
    subs = F.flatten(F.transform(F.filter(fields, lambda f: f["_tag"].isin(*tags)), lambda f: f["subfield"]))
    texts = F.transform(F.filter(subs, lambda s: s["_code"] == code), lambda s: F.trim(s["_VALUE"]))
    return F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")


def parse_marcxml(responses: DataFrame, xml: str) -> DataFrame:
    """First record of each stored MarcXchange response as a candidate.

    The record element is cut out of its envelope and namespace prefixes are
    dropped before the XML is read."""
    record = F.regexp_extract(F.col(xml), "(?s)<(?:\\w+:)?record[\\s>].*?</(?:\\w+:)?record>", 0)
    inner = F.regexp_extract(F.col(xml), "(?s)<(?:\\w+:)?recordData[^>]*>\\s*(.*?)\\s*</(?:\\w+:)?recordData>", 1)
    record = F.coalesce(none_if_empty(inner), record)
    bare = F.regexp_replace(F.regexp_replace(record, "(</?)\\w+:", "$1"), "\\sxmlns(:\\w+)?=\"[^\"]*\"", "")
    out = read_once(responses.withColumn("_f", F.from_xml(bare, MARCXML)["datafield"]), xml)

    def first(code, *tags):
        """First value of the tags, each tag tried in turn."""
        return F.coalesce(*[F.get(_marc_values(F.col("_f"), code, t), F.lit(0)) for t in tags])

    a, e = first("a", "200"), first("e", "200")
    name, forename = first("a", "700"), first("b", "700")
    subjects = F.concat(*[_marc_values(F.col("_f"), "a", t) for t in V.SUBJECT_TAGS])
    audience = F.lower(text_or_empty(first("a", "521")))
    return (out.where(F.col("_f").isNotNull())
            .select(*[c for c in responses.columns if c != xml],
                    F.when(e.isNotNull() & a.isNotNull(), F.concat(a, F.lit(" : "), e)).otherwise(a).alias("title"),
                    F.coalesce(first("f", "200"),
                               F.when(name.isNotNull(), F.concat_ws(" ", forename, name))).alias("author"),
                    first("c", "210", "214").alias("publisher"),
                    pub_year(first("d", "210", "214")).alias("year"),
                    first("a", "330").alias("abstract"),
                    none_if_empty(F.array_join(subjects, ", ")).alias("keywords"),
                    first("a", "676").alias("dewey"),
                    F.when(contains_any(audience, ("jeun", "enfant", "junior", "kid", "young", "child")), "Jeune")
                    .when(contains_any(audience, ("ado", "teen")), "Adolescent")
                    .when(contains_any(audience, ("adult", "mature")), "Adulte").alias("audience")))


def parse_volumes_json(responses: DataFrame, body: str) -> DataFrame:
    """First volume of ``items[].volumeInfo`` responses."""
    info = F.get(F.from_json(F.col(body), VOLUMES)["items"], F.lit(0))["volumeInfo"]
    out = read_once(responses.withColumn("_v", info), body).where(F.col("_v").isNotNull())
    lowered = F.transform(F.coalesce("_v.categories", F.array().cast("array<string>")), lambda c: F.lower(c))
    youth = F.exists(lowered, lambda c: contains_any(c, ("juvenile", "children", "young adult", "jeunesse")))
    genres = F.filter(F.transform(lowered, lambda c: R.first_contained(c, V.JSON_GENRES)), lambda g: g.isNotNull())
    image = F.coalesce("_v.imageLinks.extraLarge", "_v.imageLinks.large", "_v.imageLinks.medium",
                       "_v.imageLinks.thumbnail")
    return out.select(
        *[c for c in responses.columns if c != body],
        F.concat_ws(" : ", "_v.title", none_if_empty("_v.subtitle")).alias("title"),
        none_if_empty(F.array_join("_v.authors", ", ")).alias("author"),
        F.col("_v.publisher").alias("publisher"), pub_year("_v.publishedDate").alias("year"),
        F.col("_v.description").alias("abstract"), F.get(genres, F.lit(0)).alias("genre"),
        F.when(youth, "Jeune").when(F.col("_v.maturityRating") == "MATURE", "Adulte").alias("audience"),
        F.replace(F.replace(image, F.lit("&edge=curl"), F.lit("")), F.lit("http://"), F.lit("https://")).alias("image"))


def parse_bibkeys_json(responses: DataFrame, body: str, isbn: str) -> DataFrame:
    """``{"ISBN:x": {...}}`` responses as full candidates."""
    book = F.try_element_at(F.from_json(F.col(body), BIBKEYS), F.concat(F.lit("ISBN:"), F.col(isbn)))
    out = read_once(responses.withColumn("_b", book), body).where(filled("_b.title"))
    authors = F.array_join(F.transform("_b.authors", lambda a: a["name"]), " / ")
    subjects = F.array_join(F.transform("_b.subjects", lambda s: s["name"]), " ")
    nothing = F.lit("")
    out = (out.withColumn("title", F.col("_b.title")).withColumn("author", text_or_empty(authors))
           .withColumn("publisher", text_or_empty(F.get("_b.publishers", F.lit(0))["name"]))
           .withColumn("year", F.substring(text_or_empty("_b.publish_date"), -4, 4))
           .withColumn("_s", text_or_empty(subjects)))
    out = out.withColumn("audience", R.detect_audience(nothing, "title", nothing, "publisher", nothing))
    out = out.withColumn("type", R.detect_type("title", nothing, nothing, "_s", nothing, "publisher", "audience"))
    out = (out.withColumn("genre", R.score_genres("title", nothing, nothing, "_s", "type"))
           .withColumn("volume", extract_volume(nothing, "title")))
    return (out.withColumn("series", extract_series(F.col("title"), nothing, nothing, F.col("volume")))
            .withColumn("pegi", R.detect_pegi("type", "audience", nothing)).drop("_b", "_s"))

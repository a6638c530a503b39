"""ISO 2709 records: read, cut into fields, turned into titles and copies.

A record stays one row from file to title: fields and subfields are nested
arrays, so reading a title needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions.text import choose_code, clean_code, none_if_empty
from shelfspark.session import materialise
from shelfspark.sources.files import file_order

FIELD_END, SUBFIELD, RECORD_END = "\x1e", "\x1f", "\x1d"


def read_marc(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Records of .mrc files; Spark splits the files at the record end.

    The text reader hands on the bytes between record ends as they are; they stay bytes until a
    field has been cut out by the directory, which counts bytes.  ``encoding`` is that of the
    values; without one they are UTF-8, and bytes that are not become U+FFFD."""
    lines = spark.read.option("lineSep", RECORD_END).text(path)
    raw = lines.select(file_order().alias("record_id"), F.col("_metadata.file_name").alias("file_name"), F.col("value"))
    return parse_marc(raw, "value", encoding)


def parse_marc(df: DataFrame, raw: str, encoding: str | None = None) -> DataFrame:
    """Adds ``fields``: array<struct<tag, sub: array<struct<code, val>>>> in
    directory order.  Filler between records is skipped; a record whose leader
    has no readable length and base address is dropped."""
    # trimming, unlike a regular expression, does not decode
    df = df.withColumn("_bytes", F.ltrim(F.col(raw), F.lit("\n\r ")).cast("binary"))
    leader = F.make_valid_utf8(F.substring("_bytes", F.lit(1), F.lit(17)).cast("string"))
    df = df.where(leader.rlike("^[0-9]{5}.{7}[0-9]{5}$")).withColumn(
        "_base", F.substring("_bytes", F.lit(13), F.lit(5)).cast("string").try_cast("int"))
    directory = F.make_valid_utf8(F.substring("_bytes", F.lit(25), F.col("_base") - 25).cast("string"))
    entries = F.regexp_extract_all(directory, F.lit("(...\\d{9})"), 1)

    # the directory gives tag, length (terminator included) and start of each field, in bytes
    def field(entry):
        start = F.col("_base") + F.substring(entry, 8, 5).cast("int")
        content = F.substring(F.col("_bytes"), start + 1, F.substring(entry, 4, 4).cast("int"))
        text = F.decode(content, encoding) if encoding else F.make_valid_utf8(content.cast("string"))
        return F.struct(F.substring(entry, 1, 3).alias("tag"), _subfields(F.rtrim(text, F.lit(FIELD_END))).alias("sub"))
    return df.withColumn("fields", F.transform(entries, field)).drop("_bytes", "_base", *([raw] if raw == "value" else []))


def _subfields(content: Column) -> Column:
    pieces = F.split(F.coalesce(content, F.lit("")), SUBFIELD)
    pieces = F.filter(pieces, lambda p, i: (i > 0) & (p != ""))     # the indicators come first
    return F.transform(pieces, lambda p: F.struct(
        F.substring(p, 1, 1).alias("code"), F.substring(p, 2, 1 << 30).alias("val")))


def marc_fields(records: DataFrame, key="record_id") -> DataFrame:
    """One row per field: record, place, tag, subfields."""
    return (records.select(key, F.posexplode("fields").alias("pos", "f"))
            .select(key, "pos", F.col("f.tag").alias("tag"), F.col("f.sub").alias("sub")))


# --- reading values --------------------------------------------------------------------------

def _tagged(*tags) -> Column:
    return F.filter("fields", lambda f: f["tag"].isin(*tags))


def _values(code: str, *tags) -> Column:
    subs = F.flatten(F.transform(_tagged(*tags), lambda f: f["sub"]))
    return F.transform(F.filter(subs, lambda s: s["code"] == code), lambda s: s["val"])


def last_value(code, *tags) -> Column:
    return F.try_element_at(_values(code, *tags), F.lit(-1))


def first_value(code, *tags) -> Column:
    return F.get(F.filter(_values(code, *tags), lambda v: v != ""), F.lit(0))


def with_values(records: DataFrame, last: tuple, first: tuple) -> DataFrame:
    """Adds ``_last`` and ``_first``: from tag and code to the last value of the fields with a tag of
    ``last``, and to the first that is not empty of those with a tag of ``first``.  Fields are walked
    once, not once for every value wanted.  Tag 214 counts as 210, which it replaces in newer
    records, for first values."""
    def subfields(tags, tag_of):
        return F.flatten(F.transform(_tagged(*tags), lambda f: F.transform(f["sub"], lambda s: F.struct(
            F.concat(tag_of(f["tag"]), s["code"]).alias("key"), s["val"].alias("val")))))
    given = F.filter(subfields(first, lambda tag: F.when(tag == "214", "210").otherwise(tag)), lambda s: s["val"] != "")
    return (records.withColumn("_last", F.map_from_entries(subfields(last, lambda tag: tag)))   # of equal keys the last one stays
            .withColumn("_first", F.map_from_entries(F.reverse(given))))


def last_of(code: str, tag: str) -> Column:
    return F.try_element_at("_last", F.lit(tag + code))


def first_of(code: str, tag: str) -> Column:
    return F.try_element_at("_first", F.lit(tag + code))


def _in_field(field: Column, code: str) -> Column:
    """Last value of a code within one field."""
    hits = F.filter(field["sub"], lambda s: s["code"] == code)
    return F.try_element_at(hits, F.lit(-1))["val"]


def contributors() -> Column:
    people = F.transform(_tagged("700", "701", "702"), lambda f: F.struct(
        _in_field(f, "4").alias("role"), _in_field(f, "a").alias("name"), _in_field(f, "b").alias("forename")))
    return F.filter(people, lambda p: F.coalesce(p["name"], F.lit("")) != "")


def _site_fields(site: str) -> Column:
    """The site's copy fields, each as a map from code to its last value: walked once for all codes."""
    return F.filter(F.transform(_tagged("995"), lambda f: F.map_from_entries(f["sub"])), lambda m: m["a"] == site)


def local_copies(site: str) -> Column:
    """The site's copies as they are written."""
    return F.transform(_site_fields(site), lambda m: F.struct(
        m["f"].alias("barcode"), m["k"].alias("shelfmark"), m["l"].alias("audience"),
        m["v"].alias("status"), m["w"].alias("support"), m["1"].alias("entered")))


def _first_of(array: Column, name: str) -> Column:
    """First value that is not empty, of the structs' field or the maps' key."""
    return F.get(F.filter(F.transform(array, lambda x: x[name]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))


def marc_to_titles(records: DataFrame, site: str, subject_scheme: str, key="record_id") -> DataFrame:
    """One row per record: identifiers, title, people, publisher, series, type,
    category, genre, subjects, game figures.

    Written once: filters and joins on a value would be pushed below and cut the
    record again for every mention of a field behind that value."""
    subject_fields = F.filter(_tagged("686"), lambda f: _in_field(f, "2") == subject_scheme)
    classed = F.filter(_tagged("676"), lambda f: F.coalesce(_in_field(f, "a"), F.lit("")) != "")
    images = F.filter(_tagged("856"), lambda f: F.exists(
        f["sub"], lambda s: (s["code"] == "2") & (s["val"] == "Image")))
    image_urls = F.flatten(F.transform(images, lambda f: F.transform(
        F.filter(f["sub"], lambda s: s["code"] == "u"), lambda s: s["val"])))
    games = F.transform(_tagged("686"), lambda f: F.struct(
        _in_field(f, "a").alias("code"), _in_field(f, "l").alias("label"), _in_field(f, "2").alias("scheme")))
    cut = with_values(records, ("073", "010", "200", "461", "410"), ("210", "214", "215", "333")).select(
        key, contributors().alias("people"), _site_fields(site).alias("copies"),
        F.filter(F.transform(subject_fields, lambda f: _in_field(f, "l")),
                 lambda s: F.coalesce(s, F.lit("")) != "").alias("subjects"),
        games.alias("games"),
        clean_code(last_of("a", "073")).alias("_ean"), clean_code(last_of("a", "010")).alias("_isbn"),
        last_of("a", "200").alias("main_title"), last_of("h", "200").alias("part"),
        last_of("i", "200").alias("part_title"), last_of("e", "200").alias("subtitle"),
        first_of("c", "210").alias("publisher"), first_of("d", "210").alias("published"),
        F.array_join(_values("a", "330"), " ").alias("abstract"),
        first_of("a", "215").alias("physical"), first_of("a", "333").alias("age"),
        F.get(classed, F.lit(0)).alias("class"),
        F.array_join(_values("a", "606"), " | ").alias("keywords"),
        F.try_element_at(image_urls, F.lit(-1)).alias("image"),
        last_of("t", "461").alias("linked"), last_of("v", "461").alias("linked_volume"),
        last_of("d", "461").alias("periodical"),
        last_of("t", "410").alias("in_collection"), last_of("v", "410").alias("in_collection_volume"))
    series = R.series_by_precedence("main_title", "part", "linked", "linked_volume", "in_collection",
                                    "in_collection_volume", F.coalesce(R.is_comic_subject("subjects"), F.lit(False)))
    # each value mentioned several times is a column first.  Only an empty audience is empty once
    # normalised, so the first other one is taken before that
    titles = (cut.withColumn("_s", series)
            .withColumn("audience", _first_of(F.col("copies"), "l")).withColumn("support", _first_of(F.col("copies"), "w"))
            .withColumn("_barcode", _first_of(F.col("copies"), "f"))
            .withColumn("audience", R.normalise_audience("audience"))
            .select(
                key,
                choose_code(F.col("_ean"), F.col("_isbn"), F.col("_barcode")).alias("identifier"),
                R.document_type("periodical", "support").alias("kind"),
                F.coalesce(none_if_empty("part_title"), F.col("main_title")).alias("title"), "subtitle",
                F.col("_s.series").alias("series"), F.col("_s.volume").alias("volume"),
                R.resolve_author("people").alias("author"),
                R.role_holder("people", "440").alias("illustrator"),
                R.role_holder("people", "730").alias("translator"),
                "publisher", "published", none_if_empty("abstract").alias("abstract"), "image", "audience",
                R.derive_category("subjects", "audience").alias("category"),
                R.derive_genre("subjects").alias("genre"),
                F.when(F.col("class").isNotNull(), _in_field(F.col("class"), "a")).alias("dewey"),
                F.when(F.col("class").isNotNull(), _in_field(F.col("class"), "l")).alias("dewey_label"),
                none_if_empty("keywords").alias("keywords"), "physical", "age",
                R.game_value("games", "players_age").alias("players_age"),
                R.game_value("games", "players_min", whole=True).alias("players_min"),
                R.game_value("games", "players_max", whole=True).alias("players_max"),
                R.game_value("games", "duration").alias("duration")))
    return materialise(titles, "titles")


def marc_to_copies(records: DataFrame, site: str, key="record_id") -> DataFrame:
    """One row per copy of the site, with the identifier of its title; written once, like titles.

    Audiences are normalised in the copies' own rows.  An outer explode keeps records without a copy until
    after it: of the other one Spark infers a filter on the array, which cuts the record again."""
    cut = records.select(key, local_copies(site).alias("copies"),
                         clean_code(last_value("a", "073")).alias("_ean"), clean_code(last_value("a", "010")).alias("_isbn"))
    cut = cut.withColumn("_barcode", _first_of(F.col("copies"), "barcode"))
    copies = (cut.withColumn("identifier", choose_code(F.col("_ean"), F.col("_isbn"), F.col("_barcode")))
              .select(key, "identifier", F.posexplode_outer("copies").alias("copy_pos", "_c"))
              .where(F.col("copy_pos").isNotNull())
              .select(key, "identifier", "copy_pos", "_c.*")
              .withColumn("audience", R.normalise_audience("audience")))
    return materialise(copies, "copies")

"""Composite jobs: the operators put together as the weekly work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import filled, has_ean, pub_year, shelf_zone, yyyymmdd
from shelfspark.operators import audit, filters, footfall, holdings, matching, merging, selection
from shelfspark.operators import stocktake, suggestions, weeding
from shelfspark.operators.keyed import first_per_key, last_per_key
from shelfspark.session import materialise
from shelfspark.sinks import exports
from shelfspark.sources import marc, pages

# How a catalogue import treats the columns of a known title.
NEW_WINS = ("title", "series", "volume", "publisher", "published")
OLD_WINS = ("abstract", "image", "category", "genre", "audience", "illustrator", "translator", "dewey",
            "dewey_label", "keywords", "physical", "age", "players_age", "players_min", "players_max", "duration")
FROZEN = ("author", "kind")


def catalogue_import(records: DataFrame, titles: DataFrame, copies: DataFrame, site: str,
                     subject_scheme: str) -> dict[str, DataFrame]:
    """Parsed records merged into the catalogue.

    First record per identifier wins within the file; series and publishers
    take their majority spelling over both tables; the three merge policies
    apply; audience, category and genre are then harmonised within series.
    Each step reads its input several times, so its result is written to the
    shared folder before the next one."""
    incoming = marc.marc_to_titles(records, site, subject_scheme).where(F.col("identifier").isNotNull())
    incoming = materialise(first_per_key(incoming, ["identifier"], ["record_id"]), "incoming")
    merged_forms = {}
    for column in ("series", "publisher"):
        merged_forms[column] = materialise(audit.majority_form(titles, incoming, column), "forms")
        incoming = materialise(audit.apply_majority(incoming, merged_forms[column], column), "incoming")
    merged = materialise(merging.coalesce_merge(titles, incoming, "identifier", NEW_WINS, OLD_WINS, FROZEN), "merged")
    for column in ("audience", "category", "genre"):
        merged = materialise(audit.harmonise_by_group(merged, "series", column).drop("changed"), "merged")
    merged = audit.apply_majority(merged, merged_forms["publisher"], "publisher")

    found = marc.marc_to_copies(records, site).withColumn("barcode", F.trim("barcode"))
    found = found.where(filled("barcode") & F.col("identifier").isNotNull())
    found = found.withColumn("entered", yyyymmdd("entered"))
    found = last_per_key(found, ["barcode"], ["record_id", "copy_pos"]).drop("record_id", "copy_pos")
    columns = [c for c in found.columns if c != "barcode"]
    return {"titles": merged, "copies": exports.upserted(copies, found, "barcode", columns)}


def loans_import(rows: DataFrame, titles: DataFrame, exported: str) -> dict[str, DataFrame]:
    """Loan figures of a per-title export: updated titles, snapshot, report."""
    usable = first_per_key(rows.where(F.col("ean").isNotNull()), ["ean"], ["pos"])
    figures = [c for c in ("total", "current_year", "n1", "n2", "n3", "functional", "last_loan") if c in rows.columns]
    new = usable.select(F.col("ean").alias("identifier"), F.struct(*figures).alias("_f"))
    joined = titles.join(new, "identifier", "left")
    for c in figures:
        old = F.col(c) if c in titles.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("_f").isNotNull(), F.col("_f")[c]).otherwise(old))
    snapshot = (usable.join(titles.select(F.col("identifier").alias("ean")), "ean", "left_semi")
                .select(F.col("ean").alias("identifier"), F.lit(exported).alias("exported"), "total"))
    return {"titles": joined.drop("_f"), "snapshot": snapshot,
            "report": audit.import_report(rows, "raw_code", "ean", "pos", titles, "identifier")}


def copy_loans_import(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Loan figures of a per-copy export put on the copies; of repeated codes the last row counts."""
    new = last_per_key(rows, ["barcode"], ["pos"]).drop("pos")
    return exports.upserted(copies, new.join(copies.select("barcode"), "barcode", "left_semi"), "barcode",
                            ["loans", "last_loan_year"])


def footfall_import(spark: SparkSession, rows: DataFrame, hourly_table: str, daily_table: str) -> None:
    """Hourly and daily series of a counter export, replacing what they cover."""
    hours = footfall.hourly(rows, "ts", "entries").withColumn("month", F.substring("day", 1, 7))
    days = footfall.daily(rows, "ts", "entries").withColumn("month", F.substring("day", 1, 7))
    exports.upsert(spark, hourly_table, hours, ["day", "hour"], ["all_entries", "open_entries"], "month")
    exports.upsert(spark, daily_table, days, ["day"], ["all_entries", "open_entries"], "month")


def enrichment(titles: DataFrame, cands: DataFrame, when: str, n: int | None = None,
               corrections: DataFrame | None = None) -> DataFrame:
    """Candidates of many sources fused into the titles that wait for it."""
    waiting = filters.pending_enrichment(titles, "identifier", "enriched_on", "kind", "series")
    if n:
        waiting = waiting.orderBy("identifier").limit(n)
    mine = cands.join(waiting.select("identifier"), "identifier", "left_semi")
    asked = merging.early_stop_prefix(mine, "identifier", "title", "priority",
                                      [f for f in V.STOP_FIELDS if f != "illustrator"], optional="illustrator")
    # read by the vote, the fusion and each fallback: written once
    asked = materialise(asked, "asked")
    voted = merging.title_vote(asked, "identifier", "title", "priority").select(
        "identifier", F.col("title").alias("_title"))
    fused = merging.fuse_records(asked, "identifier", "priority", "source", V.KEY_FIELDS, V.FILL_FIELDS)
    fused = materialise(fused.join(voted, "identifier").withColumn("title", F.col("_title")).drop("_title"), "fused")
    done = merging.fallback_cascade(fused, asked, "identifier", "priority", corrections)
    done = done.withColumn("genre", R.canonical_genre("genre")["value"])
    return merging.apply_enrichment(
        titles, done, "identifier",
        {"category": "type", "genre": "genre", "audience": "audience", "pegi": "pegi",
         "illustrator": "illustrator", "collection": "collection", "abstract": "abstract",
         "series": "series", "volume": "volume"}, when, {"serie": "series", "tome": "volume"})


def acquisition_signals(titles: DataFrame, copies: DataFrame, today_year: int) -> dict[str, DataFrame]:
    """The nine questions asked before buying."""
    return {
        "top_creators": holdings.top_creators(titles, "author", "identifier", "loans"),
        "single_copy_hot": holdings.single_copy_hot(
            titles, copies.select("identifier", F.col("loans").alias("copy_loans")), "identifier", "copy_loans"),
        "genre_rotation": holdings.rotation(titles, ["genre", "audience"], "identifier", "loans", 3, True, k=30),
        "category_rotation": holdings.rotation(titles, ["category"], "identifier", "loans"),
        "audience_rotation": holdings.rotation(titles, ["audience"], "identifier", "loans"),
        "recent_low_use": holdings.recent_low_use(titles.where(F.col("kind") == "LIVRE"), "published", "loans",
                                                  today_year - 2, 3, "identifier"),
        "series_gaps": holdings.series_gaps(titles, "series", "volume", "loans", k=25),
        "age_profile": holdings.age_profile(titles, "published", "loans"),
        "smallest_classes": holdings.smallest_classes(titles.where(F.col("kind") == "LIVRE"), "dewey", "loans"),
    }


def followed_lists(lists: DataFrame, year: int, week: int) -> DataFrame:
    """The booksellers' lists (name, url) to be read in a week: without stale ones, a window of each
    family, newest lists first.  ``list_rank`` is their order, ``place`` that within the family."""
    text = F.concat_ws(" ", "name", "url")
    dated = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("\\b(20\\d{2})\\b"), 1), lambda y: y.cast("int")))
    kept = (lists.where(~R.stale_selection("name", "url", year))
            .withColumn("family", selection.list_family("name")).withColumn("_year", F.coalesce(dated, F.lit(year)))
            .withColumn("_number", F.coalesce(F.regexp_extract("url", "list-(\\d+)", 1).try_cast("bigint"), F.lit(0))))
    windows = selection.rotating_quota(kept, "family", [F.col("_year").desc(), F.col("_number").desc(), "name"], week,
                                       {"youth": V.YOUTH_QUOTA, "prize": V.PRIZE_QUOTA}, V.LISTS_PER_PASS, "other")
    # youth, prizes, others; at most LISTS_PER_PASS rows are numbered
    before = F.when(F.col("family") == "youth", 0).when(F.col("family") == "prize", 1).otherwise(2)
    return (windows.withColumn("list_rank", F.row_number().over(Window.orderBy(before, "slot")))
            .select("list_rank", "family", F.col("slot").alias("place"), "name", "url"))


def watch_lists(list_pages: DataFrame, product_pages: DataFrame, holdings_codes: DataFrame,
                stored: DataFrame, site: str, source: str) -> DataFrame:
    """Products of followed lists that are neither held nor suggested, as
    suggestion rows.  ``list_pages``: list_rank, name, html."""
    codes = (pages.extract_product_codes(list_pages, "list_rank", "html")
             .join(list_pages.select("list_rank", "name"), "list_rank"))
    credited = selection.first_origin(codes, "code", "list_rank", "place")
    fresh = matching.absent_by_id(credited, "code", (holdings_codes, "identifier"), (stored, "isbn"))
    read = pages.parse_product_title(product_pages, "html", site)
    feed = (fresh.join(read.drop("html"), "code")
            .withColumn("motive", F.concat(
                F.lit("Sélection de libraires : "), F.col("name"),
                F.when(filled("series"), F.concat(F.lit(" — série "), F.col("series"), F.when(filled("volume"), F.concat(
                    F.lit(" t."), F.col("volume"))).otherwise(""))).otherwise("")))
            .withColumnRenamed("code", "isbn"))
    return suggestions.suggestion_rows(feed, stored, "title", "isbn", source)


def weeding_lists(titles: DataFrame, copies: DataFrame, year: int) -> DataFrame:
    mine = titles.select("identifier", "title", "author", "publisher", "published", "dewey", "category",
                         "audience", "kind")
    joined = copies.drop("audience").join(mine, "identifier")
    return weeding.weeding_candidates(joined, "identifier", "kind", "category", "audience", "dewey", "published",
                                      "loans", "last_loan_year", year)


def stocktake_report(copies: DataFrame, scans: DataFrame) -> dict[str, DataFrame]:
    stock = copies.where(F.col("barcode").isNotNull()).withColumn("zone", shelf_zone("shelfmark")) \
        .withColumnRenamed("barcode", "code")
    return {"missing": stocktake.stock_missing(stock, scans, "code", "zone"),
            "scanned": stocktake.known_scans(stock, scans, "code"),
            "unknown": stocktake.unknown_codes(scans, stock, "code"),
            "progress": stocktake.zone_progress(stock, scans, "code", "zone")}


def quality_audit(titles: DataFrame, copies: DataFrame, days: DataFrame, hours: DataFrame) -> dict[str, DataFrame]:
    films = copies.drop("audience").join(
        titles.where(F.col("kind") == "DVD").select("identifier", "publisher", "author", "audience"), "identifier")
    return {
        "row_counts": audit.row_counts({"titles": titles, "copies": copies}),
        "fill_rate": audit.fill_rate(titles),
        "values": audit.value_inventory(titles, ["category", "genre", "audience"]),
        "scorecard": audit.scorecard(titles, {
            "books without category": (F.col("kind") == "LIVRE") & ~filled("category"),
            "without series": ~filled("series"), "without EAN": ~has_ean("identifier")}),
        "days": footfall.footfall_profile(days),
        "reconciliation": footfall.day_reconciliation(days, hours),
        "films": weeding.film_audit(films, "shelfmark", "publisher", "author", "audience"),
    }


def display_feed(titles: DataFrame, copies: DataFrame, statuses: DataFrame, today: str,
                 cover_pattern: str) -> DataFrame:
    """Slides of the titles entered in the last months that have a valid cover.
    ``cover_pattern`` is the fallback address with ``{}`` for the identifier."""
    newest = selection.latest_copy(copies, "identifier", "entered", "barcode").select(
        "identifier", "shelfmark", "support", "entered")
    recent = filters.recent_items(titles.where(F.col("kind") == "LIVRE").join(newest, "identifier"), "entered", today)
    recent = recent.where(~F.coalesce(F.col("shelfmark").startswith("JV"), F.lit(False)))
    before, after = cover_pattern.split("{}")
    choices = F.array(F.col("image"), F.concat(F.lit(before), F.col("identifier"), F.lit(after)))
    covers = suggestions.first_valid_cover(recent, "identifier", choices, statuses)
    return exports.slides(recent.join(covers, "identifier").withColumn("year", pub_year("published", keep_raw=True)))

"""Orders within a budget: the youth order in four phases, and its supplement of new comics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import author_first, col, contains_any, fold_text, leading_int, text_or_empty, token_jaccard
from shelfspark.operators import matching, selection
from shelfspark.operators.keyed import first_per_key
from shelfspark.session import materialise, spread

AHEAD = 6               # volumes looked for behind the last one held
SERIES_LIKE, TITLE_LIKE = 0.6, 0.5
# what a suggestion's motive or source says when it is for the young
YOUTH_WORDS = ("jeunesse", "ado", "enfant", "album", "bd", "manga", "première lecture", "premiere lecture", "kibookin")
YOUTH_LISTS = r"(?i)jeunesse|enfant|\bado"
OPEN_STATUSES = ("à étudier", "à commander")
SHAPE = ["isbn", "title", "author", "publisher", "series", "volume", "support", "price", "category", "motive",
         "origin", "phase", "first", "second", "slot", "chain", "step"]
KEYS = ("by_isbn", "by_volume", "by_title")


def _number(c) -> Column:
    return leading_int(col(c).cast("string"))


def _in_scope() -> Column:
    return F.col("audience").isin(*V.ORDER_AUDIENCES) & F.col("category").isin(*V.ORDER_CATEGORIES)


def with_keys(titles: DataFrame) -> DataFrame:
    """Titles with the keys of what is held, and the folded name and number of their series.  Texts
    are folded once, dealt over all cores.  Volumes held count for the series in scope only."""
    theirs = matching.book_keys("identifier", F.when(_in_scope(), F.col("series")), "volume", "title", author_first("author"))
    return materialise(spread(titles).select("*", fold_text("series", "drop").alias("series_key"), _number("volume").alias("number"),
                                             *[c.alias(k) for k, c in theirs.items()]), "held")


def held_series(titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Youth series of the collection (see ``with_keys``): (series_key, series, category, loans, volumes, highest), and
    the numbers held (series_key, number).  Loans of rows without a number count for the series."""
    mine = titles.where(_in_scope() & (F.col("series_key") != ""))
    by_number = (mine.groupBy("series_key", "number")
                 .agg(F.sum(F.coalesce("loans", F.lit(0))).alias("loans"), F.min("series").alias("series"), F.min("category").alias("category")))
    series = by_number.groupBy("series_key").agg(
        F.min("series").alias("series"), F.min("category").alias("category"), F.sum("loans").alias("loans"),
        F.count("number").alias("volumes"), F.max("number").alias("highest"))
    return series, by_number.where(F.col("number").isNotNull()).select("series_key", "number")


def _of_series(offers: DataFrame, series: DataFrame) -> DataFrame:
    """Numbered offers with every held series whose name is similar enough: series_key, number,
    facts of the series as _-columns, and the offer."""
    on_sale = offers.withColumn("number", _number("volume")).where(F.col("number").isNotNull() & F.col("series").isNotNull())
    alike = matching.similar_texts(series, "series", on_sale, "series", SERIES_LIKE).select("left_text", "right_text")
    facts = series.select("series_key", *[F.col(c).alias(f"_{c}") for c in ("series", "category", "loans", "volumes", "highest")])
    return (on_sale.join(alike, on_sale["series"] == alike["right_text"]).drop("right_text")
            .join(facts, F.col("left_text") == F.col("_series")).drop("left_text"))


def _shaped(df: DataFrame, phase: int, origin: str) -> DataFrame:
    """One shape for all phases; what a phase does not have is NULL."""
    df = df.withColumn("phase", F.lit(phase)).withColumn("origin", F.lit(origin))
    kinds = {"first": "string", "second": "bigint", "slot": "string", "chain": "string", "step": "bigint"}
    for name in ("first", "second", "slot", "chain", "step"):
        df = df.withColumn(name, F.col(name).cast(kinds[name]) if name in df.columns else F.lit(None).cast(kinds[name]))
    return df.select(*SHAPE, *KEYS)


def missing_phase(of_series: DataFrame, held: DataFrame) -> DataFrame:
    """Offers of numbers that a series of two volumes or more lacks below its highest.  An offer is
    in a gap if its number is not held: one equi-join, and no number is generated."""
    wanted = of_series.where((F.col("_volumes") >= 2) & F.col("number").between(1, F.col("_highest")))
    return _shaped(wanted.join(held, ["series_key", "number"], "left_anti")
                   .withColumn("first", _by_loans()).withColumn("second", F.col("number"))
                   .withColumn("slot", F.concat_ws("#", F.lit("1"), "series_key", "number"))
                   .withColumn("category", F.col("_category"))
                   .withColumn("motive", F.concat(F.lit("Série « "), "_series", F.lit(" » ("), "_loans", F.lit(" prêts) : tome "), "number", F.lit(" absent du fonds"))),
                   1, "Tome manquant")


def _by_loans() -> Column:
    """Sorts by loans, highest first, then by series, as one text."""
    return F.concat(F.lpad((F.lit(10 ** 15) - F.col("_loans")).cast("string"), 16, "0"), F.lit(" "), F.col("series_key"))


def suggested_phase(suggestions: DataFrame, offers: DataFrame, distinct: DataFrame) -> DataFrame:
    """Offers answering open suggestions for the young, newest first: by code where one is given,
    else by similar title; the title must be alike, and a missing price is the suggestion's.

    Suggestions that say the same are one question, and those by title are put to the ``distinct``
    offers, so that repeats on both sides do not multiply."""
    said = F.lower(F.concat_ws(" ", text_or_empty("motive"), text_or_empty("source")))
    asked = suggestions.where(F.col("status").isin(*OPEN_STATUSES) & contains_any(said, YOUTH_WORDS)).select(
        F.col("title").alias("_title"), F.col("isbn").alias("_isbn"), F.col("price").alias("_price"),
        F.substring(text_or_empty("motive"), 1, 250).alias("_motive"), F.col("added").alias("_added")).distinct()
    asked = materialise(asked, "asked")
    coded = F.coalesce(F.col("_isbn").rlike("^[0-9]{9,13}$"), F.lit(False))
    by_code = asked.where(coded).join(offers, F.col("_isbn") == F.col("isbn")).where(token_jaccard("title", "_title") >= TITLE_LIKE)
    searched = asked.where(~coded)
    alike = matching.similar_texts(searched, "_title", distinct, "title", TITLE_LIKE)
    by_title = (searched.join(alike, F.col("_title") == F.col("left_text"))
                .join(distinct, F.col("right_text") == F.col("title")).drop("left_text", "right_text"))
    both = by_code.withColumn("score", F.lit(1.0)).unionByName(by_title)
    slot = F.concat_ws("#", F.lit("2"), F.coalesce("_added", F.lit("")), F.coalesce("_title", F.lit("")), F.coalesce("_isbn", F.lit("")))
    newest = F.translate(F.coalesce("_added", F.lit("")), "0123456789", "9876543210")
    return _shaped(both.withColumn("price", F.coalesce("price", "_price")).withColumn("slot", slot)
                   .withColumn("first", F.concat_ws("#", newest, F.coalesce("_title", F.lit("")), F.coalesce("_isbn", F.lit(""))))
                   .withColumn("second", F.round((1 - F.col("score")) * 10 ** 6))
                   .withColumn("category", F.lit("(veille)")).withColumn("motive", F.col("_motive")),
                   2, "Suggestion veille")


def listed_phase(lists: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers named in booksellers' lists for the young (list_rank, name, place, isbn), in their order."""
    young = lists.where(F.col("name").rlike(YOUTH_LISTS)).select("list_rank", "name", "place", F.col("isbn").alias("_isbn"))
    return _shaped(young.join(offers, F.col("_isbn") == F.col("isbn"))
                   .withColumn("first", F.lpad(F.col("list_rank").cast("string"), 10, "0")).withColumn("second", F.col("place"))
                   .withColumn("category", F.lit("(sélection)")).withColumn("motive", F.substring("name", 1, 250)),
                   3, "Sélection libraires")


def following_phase(of_series: DataFrame) -> DataFrame:
    """Offers of the volumes behind the last one of lent series with three volumes or more.  They
    form a chain: once a volume is not accepted, the later ones of its series are not asked for."""
    step = F.col("number") - F.col("_highest")
    wanted = of_series.where((F.col("_volumes") >= 3) & (F.col("_loans") > 0)).withColumn("step", step).where(F.col("step").between(1, AHEAD))
    return _shaped(wanted.withColumn("first", _by_loans()).withColumn("second", F.col("number")).withColumn("chain", F.col("series_key"))
                   .withColumn("slot", F.concat_ws("#", F.lit("4"), "series_key", "number"))
                   .withColumn("category", F.col("_category"))
                   .withColumn("motive", F.concat(F.lit("Suite de « "), "_series", F.lit(" » ("), "_loans", F.lit(" prêts), dernier tome en fonds : "), "_highest")),
                   4, "Tome suivant")


def fresh_offers(offers: DataFrame, titles: DataFrame) -> DataFrame:
    """Offers with an acceptable title and support whose code, volume or title and author the
    collection does not hold (see ``with_keys``), with these keys.  That is a matter of the offer
    alone, so it is settled before offers meet the questions that they may answer."""
    offers = first_per_key(offers.where(F.col("isbn").isNotNull()), ["isbn"], ["title", "series", "volume", "price"])
    mine = matching.book_keys("isbn", "series", "volume", "title", "author")
    keyed = materialise(spread(offers).select("*", (~R.title_excluded("title") & ~R.support_excluded("support")).alias("_fit"),
                                              *[c.alias(k) for k, c in mine.items()]), "offers").where("_fit").drop("_fit")
    for k in KEYS:
        keyed = keyed.join(titles.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return materialise(keyed, "fresh")


def one_of_equals(offers: DataFrame) -> DataFrame:
    """Of fresh offers of the same volume, title, author and price the one with the smallest code.

    Only the first of them can be taken as the answer to a question: what refuses it, the price or
    the key of something taken before, refuses the others; once it is taken the question is
    answered.  Its own code is taken only along with its other keys, so offers that have none of
    them are all kept."""
    apart = F.when(F.col("by_volume").isNull() & F.col("by_title").isNull(), F.col("isbn"))
    return materialise(first_per_key(offers.withColumn("_apart", apart), ["title", "series", "volume", "price", "by_volume", "by_title", "_apart"],
                                     ["isbn"]).drop("_apart"), "distinct")


def order_builder(titles: DataFrame, offers: DataFrame, suggestions: DataFrame, lists: DataFrame, budget: float) -> DataFrame:
    """The basket: missing volumes, suggestions, booksellers' lists, following volumes.

    ``titles``: identifier, title, author, series, volume, category, audience, loans.  ``offers``:
    isbn, title, author, publisher, series, volume, support, price.  ``suggestions``: title, isbn,
    price, motive, source, status, added.  ``lists``: list_rank, name, place, isbn.

    Of the offers for one question the first accepted is taken, in the order of their codes."""
    titles = with_keys(titles)
    series, held = (materialise(df, "series") for df in held_series(titles))
    fresh = fresh_offers(offers, titles)
    distinct = one_of_equals(fresh)
    of_series = materialise(_of_series(distinct, series), "of-series")
    cands = missing_phase(of_series, held)
    for part in (suggested_phase(suggestions, fresh, distinct), listed_phase(lists, fresh), following_phase(of_series)):
        cands = cands.unionByName(part)
    cands = materialise(cands.where(R.price_acceptable("price", "origin")), "candidates")
    basket = selection.budget_select(cands.withColumn("pool", F.lit("order")), "pool", "price", ["phase", "first", "second", "isbn"], budget,
                                     keys=KEYS, stop_share=V.STOP_SHARE, slot="slot", chain="chain", step="step")
    return basket.select("isbn", "title", "author", "publisher", "series", "volume", "price", "category", "origin", "phase", "motive")


def comic_supplement(titles: DataFrame, offers: DataFrame, shelves: DataFrame, excluded: DataFrame, budget: float) -> DataFrame:
    """New comics for the young from a bookseller's shelves, until 99 % of the budget are spent.

    ``shelves``: shelf_rank, name, youth (its comics are for the young without a test), place, isbn.
    ``excluded``: isbn of orders under way and of books to be catalogued.  Manga and comics
    publishers are left out, prices above the comics' cap refused."""
    mine = shelves.select("shelf_rank", "name", "youth", "place", F.col("isbn").alias("_isbn"))
    offered = fresh_offers(offers, with_keys(titles))
    found = mine.join(offered, F.col("_isbn") == F.col("isbn")).where(
        ~R.comic_excluded("publisher", "title") & (F.col("youth") | R.youth_comic("publisher", "title", as_written=True))
        & (F.col("price") <= V.PRICE_CAP_COMIC))
    found = matching.absent_by_id(found, "isbn", (excluded, "isbn"))
    cands = _shaped(found.withColumn("first", F.lpad(F.col("shelf_rank").cast("string"), 10, "0")).withColumn("second", F.col("place"))
                    .withColumn("category", F.lit("BD"))
                    .withColumn("motive", F.concat(F.lit("Nouveautés BD jeunesse ("), "name", F.lit(")"))), 1, "BD nouveauté")
    cands = materialise(cands.where(R.price_acceptable("price", "origin")).withColumn("pool", F.lit("supplement")), "candidates")
    basket = selection.budget_select(cands, "pool", "price", ["first", "second", "isbn"], budget, keys=KEYS, stop_share=V.STOP_SHARE_SUPPLEMENT)
    return basket.select("isbn", "title", "author", "publisher", "series", "volume", "price", "category", "origin", "motive")

"""Merging versions of a record, and building one record from many sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import blank, col, extract, filled, none_if_empty, strip_chars, text_or_empty
from shelfspark.functions.volumes import clean_title
from shelfspark.operators.keyed import top_per_key


def coalesce_merge(old: DataFrame, new: DataFrame, keys, new_wins=(), old_wins=(), frozen=()) -> DataFrame:
    """Full outer merge with three column policies.

    new_wins: the new value where set; old_wins: the old value where set;
    frozen: the old row's value (even NULL), the new one only for new rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, keys, "full")
    out = [*keys]
    out += [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in new_wins]
    out += [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in old_wins]
    out += [F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in frozen]
    origin = (F.when(F.col("o._old").isNull(), "inserted")
              .when(F.col("n._new").isNull(), "kept").otherwise("updated"))
    return both.select(*out, origin.alias("merge_action"))


def carry_over_status(new: DataFrame, old: DataFrame, key, status, default) -> DataFrame:
    """Full replacement that keeps the status set by people."""
    kept = old.select(key, F.col(status).alias("_status"))
    return (new.join(kept, key, "left")
            .withColumn(status, F.coalesce("_status", F.lit(default))).drop("_status"))


# --- several sources for one record -------------------------------------------------------

def vote_key(title) -> Column:
    """Lower case without punctuation (letters of any alphabet are kept)."""
    return F.trim(F.regexp_replace(F.lower(col(title)), "(?U)[^\\w\\s]", ""))


def title_quality(title) -> Column:
    """-10 for a leading number and dash, -0.01 per character."""
    return (F.when(col(title).rlike("^\\d{1,3}\\s*[-–]"), -10.0).otherwise(0.0)
            - F.length(col(title)) * 0.01)


def title_vote(cands: DataFrame, key, title, priority) -> DataFrame:
    """Winning title per key: frequency of the folded title, then quality of its
    best spelling, then source priority.

    Three partial aggregations; the candidates of a key are never gathered."""
    titled = cands.where(filled(title)).withColumn("_k", vote_key(title))
    forms = (titled.groupBy(key, "_k", title)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(priority).alias("_p"))
             .withColumn("_q", title_quality(title)))
    order = F.struct("_q", (-F.col("_p")).alias("_p"), F.col(title).alias("_t"))
    groups = (forms.groupBy(key, "_k")
              .agg(F.sum("_n").alias("votes"), F.min("_p").alias("_first"),
                   F.max(order).alias("_best")))
    final = F.struct("votes", F.col("_best._q").alias("q"), (-F.col("_first")).alias("f"),
                     F.col("_best._t").alias("t"))
    return (groups.groupBy(key).agg(F.max(final).alias("_w"))
            .select(key, F.col("_w.t").alias("title"), F.col("_w.votes").alias("votes")))


def early_stop_prefix(cands: DataFrame, key, title, priority, fields, optional=None,
                      patience: int = 4) -> DataFrame:
    """Only the sources asked before the search could stop.

    The search stops at the first rank where two sources agree on the title,
    every field has a value, and the optional one is filled or ``patience``
    sources have answered.  Each condition holds from some rank on, so the stop
    is the greatest of their first ranks: a few minima per key."""
    asked = cands.where(filled(title))
    seconds = (top_per_key(asked.withColumn("_k", vote_key(title)).select(key, "_k", priority),
                           [key, "_k"], [priority], 2, rank="_r")
               .where(F.col("_r") == 2).groupBy(key).agg(F.min(priority).alias("_agree")))
    late = (top_per_key(asked.select(key, priority), [key], [priority], patience, rank="_r")
            .where(F.col("_r") == patience).select(key, F.col(priority).alias("_late")))
    firsts = asked.groupBy(key).agg(*[
        F.min(F.when(filled(F.col(f).cast("string")), F.col(priority))).alias(f"_f{i}")
        for i, f in enumerate(fields)], *([
            F.min(F.when(filled(F.col(optional).cast("string")), F.col(priority))).alias("_opt")]
            if optional else []))
    stops = firsts.join(seconds, key, "left").join(late, key, "left")
    needed = [F.col("_agree"), *[F.col(f"_f{i}") for i in range(len(fields))]]
    if optional:
        needed.append(F.least("_opt", "_late"))
    complete = F.lit(True)
    for c in needed:
        complete = complete & c.isNotNull()
    stop = F.when(complete, F.greatest(*needed) if len(needed) > 1 else needed[0])
    return (asked.join(stops.select(key, stop.alias("_stop")), key, "left")
            .where(F.col("_stop").isNull() | (F.col(priority) <= F.col("_stop"))).drop("_stop"))


def fuse_records(cands: DataFrame, key, priority, source, key_fields, fill_fields) -> DataFrame:
    """One record per key: the candidate with most key fields leads, the others
    fill its empty fields in that order.  ``sources`` says ``A`` or ``A +n``.

    One minimum per field over (missing key fields, priority); nothing is
    collected, so a key with many candidates is reduced on the map side."""
    complete = sum((filled(F.col(f).cast("string")).cast("int") for f in key_fields), F.lit(0))
    order = F.struct((-complete).alias("miss"), F.col(priority).alias("prio"))
    ranked = cands.withColumn("_o", order)
    picks = [F.min(F.struct("_o", F.col(source).alias("source"))).alias("_lead")]
    for f in dict.fromkeys([*key_fields, *fill_fields]):
        has = filled(F.col(f).cast("string"))
        picks.append(F.min(F.when(has, F.struct("_o", F.col(f).alias("value"),
                                                F.col(source).alias("source")))).alias(f"_{f}"))
    fused = ranked.groupBy(key).agg(*picks)
    fields = list(dict.fromkeys([*key_fields, *fill_fields]))
    helpers = F.array_remove(F.array_distinct(F.array_compact(
        F.array(*[F.col(f"_{f}.source") for f in fill_fields]))), F.col("_lead.source"))
    label = F.when(F.size(helpers) == 0, F.col("_lead.source")).otherwise(
        F.concat("_lead.source", F.lit(" +"), F.size(helpers).cast("string")))
    return fused.select(key, *[F.col(f"_{f}.value").alias(f) for f in fields], label.alias("sources"))


def _first_guess(cands: DataFrame, key, order, name: str, guess: Column) -> DataFrame:
    """First non-empty guess per key over its candidates, in order."""
    return (cands.withColumn("_g", none_if_empty(guess)).where(F.col("_g").isNotNull())
            .groupBy(key).agg(F.min(F.struct(order, F.col("_g").alias("g"))).alias("_m"))
            .select(key, F.col("_m.g").alias(name)))


AGE_IN_TEXT = r"(?iU)(\d+)\s*[àa]\s*\d+\s*ans?|dès\s*(\d+)\s*ans?|à partir de\s*(\d+)"


def fallback_cascade(fused: DataFrame, cands: DataFrame, key, priority,
                     corrections: DataFrame | None = None) -> DataFrame:
    """Fill audience, type, genre, rating, year of fused records.

    Audience: own fields, then any candidate's texts, then the type, then
    ``Jeunesse``.  Type: own fields, candidates, then the audience, then
    ``Roman jeunesse``.  Genre: candidates, then the default of the type.
    Manual corrections win over everything.  The candidates are reduced to one
    guess per key before each join."""
    fields = ["title", "collection", "abstract", "publisher"]
    texts = F.concat_ws(" ", *[text_or_empty(f) for f in fields])
    stated = F.regexp_extract(texts, AGE_IN_TEXT, 0)
    order = F.struct((-sum((filled(F.col(f).cast("string")).cast("int") for f in V.KEY_FIELDS),
                           F.lit(0))).alias("miss"), F.col(priority).alias("prio"))
    # candidates are looked at in the order of the fusion: completest first
    cands = cands.withColumn("_ord", order)
    order = F.col("_ord")
    nothing = F.lit("")

    out = fused
    title, collection = F.col("title"), F.lower(text_or_empty("collection"))
    out = out.join(_first_guess(cands, key, order, "_aud", R.detect_audience(
        nothing, "title", F.lower(text_or_empty("collection")), "publisher", stated)), key, "left")
    by_type = (F.when(F.col("type") == "Manga", "Ado (12+)")
               .when(F.col("type").isin("Album", "Première lecture"), "Dès 6 ans")
               .when(F.col("type") == "Roman ado / YA", "Ado (12+)")
               .when(F.col("type") == "Documentaire", "8-12 ans"))
    out = out.withColumn("audience", F.coalesce(
        none_if_empty(text_or_empty("audience")),
        none_if_empty(R.detect_audience(nothing, title, collection, "publisher", nothing)),
        "_aud", by_type, F.lit("Jeunesse"))).drop("_aud")

    out = out.join(_first_guess(
        cands.drop("audience").join(out.select(key, "audience"), key), key, order, "_typ", R.detect_type(
            "title", "collection", "abstract", nothing, nothing, "publisher", "audience")), key, "left")
    by_audience = (F.when(F.col("audience") == "Dès 3 ans", "Album")
                   .when(F.col("audience") == "Dès 6 ans", "Première lecture")
                   .when(F.col("audience") == "Ado (12+)", "Roman ado / YA"))
    out = out.withColumn("type", F.coalesce(
        none_if_empty(text_or_empty("type")),
        none_if_empty(R.detect_type(title, collection, nothing, nothing, nothing, "publisher", "audience")),
        "_typ", by_audience, F.lit("Roman jeunesse"))).drop("_typ")

    out = out.join(_first_guess(
        cands.drop("type").join(out.select(key, "type"), key), key, order, "_gen",
        R.score_genres("title", "collection", "abstract", nothing, "type")), key, "left")
    out = out.withColumn("genre", F.coalesce(
        none_if_empty(text_or_empty("genre")), "_gen",
        R.lookup(F.col("type"), V.LAST_GENRE_OF_TYPE), F.lit(V.LAST_GENRE))).drop("_gen")

    series = F.regexp_replace(text_or_empty("series"), r"\s*\d{1,3}\s*$", "")
    series = strip_chars(series, " -–:,")
    series = F.trim(F.regexp_replace(series, r"\s*[-–,]\s*[Tt]ome\s*\d{1,3}.*$", ""))
    out = (out.withColumn("title", clean_title("title", "volume", "series"))
           .withColumn("series", F.when(F.length(series) > 2, series).otherwise(F.col("series")))
           .withColumn("pegi", F.coalesce(none_if_empty(text_or_empty("pegi")),
                                          R.detect_pegi("type", "audience", nothing)))
           .withColumn("year", F.coalesce(none_if_empty(text_or_empty("year")), F.lit("N/C")))
           .withColumn("publisher", F.when(filled("publisher"), R.publisher_canonical("publisher"))
                       .otherwise(F.col("publisher"))))
    if corrections is not None:
        manual = [c for c in corrections.columns if c != key]
        fixed = corrections.select(key, F.struct(*manual).alias("_c"))
        out = out.join(fixed, key, "left")
        for c in manual:
            out = out.withColumn(c, F.when(filled(F.col("_c")[c].cast("string")), F.col("_c")[c])
                                 .otherwise(F.col(c)))
        out = (out.withColumn("sources", F.when(F.col("_c").isNotNull(), F.concat(
            "sources", F.lit(" [corrigé]"))).otherwise(F.col("sources"))).drop("_c"))
    return out


def fill_missing_from_second(first: DataFrame, second: DataFrame, key, essentials, fields) -> DataFrame:
    """The second source is used only where at least two essentials are missing;
    set values are never overwritten."""
    other = second.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    lacking = sum((blank(F.col(f).cast("string")).cast("int") for f in essentials), F.lit(0))
    out = first.withColumn("_use", lacking >= 2).join(other, key, "left")
    for f in fields:
        own = F.when(filled(F.col(f).cast("string")), F.col(f))
        out = out.withColumn(f, F.coalesce(own, F.when(F.col("_use"), F.col(f"_{f}")), F.col(f)))
    return out.drop("_use", *[f"_{f}" for f in fields])


def apply_enrichment(titles: DataFrame, found: DataFrame, key, pairs: dict[str, str], when: str,
                     marked: dict[str, str] | None = None) -> DataFrame:
    """Fill empty fields of the catalogue from found records (never overwriting),
    mark series and volume we filled, apply the manga rule, stamp the date.

    ``pairs``: catalogue column -> found column; ``marked``: marker name -> column."""
    f = found.select(key, F.lit(True).alias("_hit"), *[F.col(v).alias(f"_{k}") for k, v in pairs.items()])
    out = titles.join(f, key, "left")
    if marked:
        out = out.withColumn("to_verify", F.coalesce(
            F.col("to_verify") if "to_verify" in titles.columns else F.lit(None).cast("string"),
            R.provenance_marker(**{n: (F.col(c), F.col(f"_{c}")) for n, c in marked.items()})))
    for k in pairs:
        out = out.withColumn(k, F.coalesce(F.col(k), none_if_empty(F.col(f"_{k}"))))
    if {"category", "pegi", "audience"} <= set(pairs):
        rated = (F.col("_category") == "Manga") & filled("_pegi")
        out = out.withColumn("audience", F.when(rated, R.manga_audience("_pegi", "audience"))
                             .otherwise(R.normalise_audience("audience")))
    return (out.withColumn("enriched_on", F.when(F.col("_hit"), F.lit(when))
                           .otherwise(F.col("enriched_on") if "enriched_on" in titles.columns
                                      else F.lit(None).cast("string")))
            .drop("_hit", *[f"_{k}" for k in pairs]))

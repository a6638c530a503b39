"""Purchase suggestions: from feeds to decided rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions.text import contains_any, filled, fold_text, none_if_empty, text_or_empty
from shelfspark.operators.keyed import first_per_key


def suggestion_rows(feed: DataFrame, existing: DataFrame, title, position, source: str,
                    requester: str = "veille automatique") -> DataFrame:
    """Feed items not yet suggested (nor repeated in the batch) as complete rows.

    ``feed`` may carry author, publisher, isbn, motive, category, audience,
    genre, published; whatever is missing gets its explicit default."""
    have = set(feed.columns)

    def field(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    keyed = feed.where(filled(title)).withColumn("_t", fold_text(title))
    fresh = keyed.join(existing.where(filled(title)).select(fold_text(title).alias("_t")).distinct(),
                       "_t", "left_anti")
    once = first_per_key(fresh, ["_t"], [position])
    youth = any(w in source.lower() for w in V.YOUTH_SOURCE_WORDS)
    published = field("published")
    motive = F.coalesce(none_if_empty(field("motive")), F.when(
        filled(published), F.concat(F.lit(V.DEFAULT_MOTIVE + " (date de parution : "), published, F.lit(")")))
        .otherwise(F.lit(V.DEFAULT_MOTIVE)))
    genre = F.when(filled(field("genre")), R.canonical_genre(field("genre"))["value"])
    return once.select(
        F.col(title).alias("title"), F.lit(requester).alias("requester"), field("author").alias("author"),
        field("publisher").alias("publisher"), field("isbn").alias("isbn"), motive.alias("motive"),
        F.lit(source).alias("source"),
        F.coalesce(none_if_empty(field("category")), F.lit(V.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(none_if_empty(R.normalise_audience(field("audience"))),
                   F.lit("Jeunesse" if youth else V.DEFAULT_AUDIENCE)).alias("audience"),
        F.coalesce(genre, F.lit(V.DEFAULT_GENRE)).alias("genre"),
        F.lit(V.SUGGESTION_STATUSES[0]).alias("status"))


def classify_suggestions(df: DataFrame, title, motive, source) -> DataFrame:
    """Fill empty category, audience and genre; set values stay."""
    c = R.classify_suggestion(title, motive, source)
    out = df.withColumn("_c", c)
    for name in ("category", "audience", "genre"):
        own = F.when(filled(name), F.col(name)) if name in df.columns else F.lit(None).cast("string")
        out = out.withColumn(name, F.coalesce(own, F.col("_c")[name]))
    return out.drop("_c")


# Allowed changes of a suggestion's status.
TRANSITIONS = {
    "à étudier": ("à commander", "acquise", "écartée"),
    "à commander": ("à étudier", "acquise", "écartée"),
    "acquise": ("à étudier", "à commander"),
    "écartée": ("à étudier",),
}


def latest_status(actions: DataFrame, key, action, at, tie) -> DataFrame:
    """Last action per key; a partial aggregation, no window."""
    last = F.max(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(action).alias("action")))
    return (actions.groupBy(key).agg(last.alias("_l"))
            .select(key, F.col("_l.action").alias("status"), F.col("_l.at").alias("since")))


def allowed_actions(actions: DataFrame, states: DataFrame, key, wanted="action") -> DataFrame:
    """Actions the key's present status permits (a new key starts at the first)."""
    joined = actions.join(states.select(key, F.col("status").alias("_now")), key, "left")
    now = F.coalesce("_now", F.lit(V.SUGGESTION_STATUSES[0]))
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items()
                             for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    permitted = F.array_contains(F.try_element_at(allowed, now), F.col(wanted))
    return joined.where(F.coalesce(permitted, F.lit(False))).drop("_now")


def dedup_suggestions(batch: DataFrame, stored: DataFrame, title, position) -> DataFrame:
    """Titles of a batch not stored yet, each once."""
    keyed = batch.where(filled(title)).withColumn("title_key", fold_text(title))
    fresh = keyed.join(stored.select("title_key"), "title_key", "left_anti")
    return first_per_key(fresh, ["title_key"], [position])


def next_batch(pending: DataFrame, tried: DataFrame, key, n: int = 200) -> DataFrame:
    """The next n keys of a campaign, each key once."""
    return pending.join(tried.select(key), key, "left_anti").orderBy(key).limit(n)


def feed_freshness(state: DataFrame, incoming: DataFrame, feed="feed", date="file_date") -> DataFrame:
    """Per feed: first, older, same or newer than the last import."""
    before = state.select(feed, F.col(date).alias("previous"))
    joined = incoming.join(before, feed, "left")
    return joined.withColumn("freshness", F.when(F.col(date).isNull(), "undated")
                             .when(F.col("previous").isNull(), "first")
                             .when(F.col(date) < F.col("previous"), "older")
                             .when(F.col(date) == F.col("previous"), "same").otherwise("newer"))


def first_valid_cover(items: DataFrame, key, candidates, statuses: DataFrame, url="url",
                      content_type="content_type", size="size") -> DataFrame:
    """First address, in order, known to be an image of at least 1000 bytes
    (size unknown counts as large enough); items without one are dropped."""
    good = statuses.where(F.col(content_type).startswith("image/")
                          & (F.col(size).isNull() | (F.col(size) >= 1000))).select(url).distinct()
    tried = items.select(key, F.posexplode(candidates).alias("rank", url)).where(filled(url))
    return (tried.join(good, url, "left_semi").groupBy(key)
            .agg(F.min(F.struct("rank", url)).alias("_b")).select(key, F.col(f"_b.{url}").alias("cover")))

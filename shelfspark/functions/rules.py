"""Decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import vocab as V
from shelfspark.functions.text import (
    blank, col, contains_any, director_letters, filled, fold_key, fold_text, let,
    none_if_empty, once, series_name, strip_accents, text_or_empty,
)
from shelfspark.functions.words import first_rank, listed


def lookup(key: Column, table: dict) -> Column:
    """Exact match in a fixed table, else NULL."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def first_contained(text: Column, table) -> Column:
    """Value of the first key (in table order) the text contains, else NULL."""
    items = list(table.items() if isinstance(table, dict) else table)
    return _ranked(text, [(k, i) for i, (k, _) in enumerate(items)], [v for _, v in items])


def first_group(text: Column, groups) -> Column:
    """Name of the first (name, words) group with a word in the text, else NULL."""
    groups = list(groups)
    return _ranked(text, [(w, i) for i, (_, words) in enumerate(groups) for w in words], [name for name, _ in groups])


def _ranked(text: Column, ranked: list, values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), first_rank(text, ranked))


def folded_table(table: dict) -> list:
    import unicodedata

    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s)
                       if not unicodedata.combining(c))
    return [(fold(k), v) for k, v in table.items()]


# --- audience --------------------------------------------------------------------

def age_in_audience(c) -> Column:
    """The audience value is really an age."""
    key = fold_key(c)
    return key.rlike(V.AGE_PATTERN) & lookup(key, V.AUDIENCE_FORMS).isNull()


def normalise_audience(c) -> Column:
    """One of the four canonical audiences; ages mean Jeunesse; an unknown
    value stays as it is.  A value written like a form of the table, but for
    capitals, needs no folding."""
    def known(c):
        return F.when(blank(c), c).otherwise(F.coalesce(lookup(F.lower(c), V.AUDIENCE_FORMS), once(fold_key(c), lambda key: F.coalesce(
            lookup(key, V.AUDIENCE_FORMS), F.when(key.rlike(V.AGE_PATTERN), F.lit("Jeunesse")))), c))
    return once(c, known)


def move_age_then_normalise(df, audience: str, age: str):
    """Copy a stray age to the age column if that is empty, then normalise."""
    moved = F.when(age_in_audience(audience) & blank(age), F.trim(F.col(audience)))
    return (df.withColumn(age, F.coalesce(moved, F.col(age)))
            .withColumn(audience, normalise_audience(audience)))


def manga_audience(pegi, audience) -> Column:
    """Mangas: the rating decides; no readable rating leaves the audience."""
    rating = F.regexp_extract(text_or_empty(pegi), "\\d+", 0).try_cast("int")
    return (F.when(rating >= V.MANGA_ADULT_AGE, F.lit("Adulte"))
            .when(rating.isNotNull(), F.lit("Jeunesse"))
            .otherwise(normalise_audience(audience)))


def age_statement(c) -> Column:
    """Audience read from an age statement by the ordered ladder; '' if none."""
    def ladder(c):
        lowered = F.lower(c)
        chain = F.when(c == "", F.lit(""))
        for pattern, value in V.AGE_LADDER:
            chain = chain.when(lowered.rlike("(?U)" + pattern), F.lit(value))
        return chain.when(c.rlike("\\d"), c).otherwise(F.lit(""))
    return let(F.trim(text_or_empty(c)), ladder)


def detect_audience(code, title, collection, publisher, age) -> Column:
    """Age statement, else coded value, else collection, publisher, words."""
    plain_collection = strip_accents(F.lower(text_or_empty(collection)))
    plain_publisher = strip_accents(F.lower(text_or_empty(publisher)))
    words = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(collection)))
    return F.coalesce(
        none_if_empty(age_statement(age)),
        lookup(F.lower(text_or_empty(code)), V.AUDIENCE_CODES),
        first_contained(plain_collection, folded_table(V.AUDIENCE_OF_COLLECTION)),
        first_contained(plain_publisher, folded_table(V.AUDIENCE_OF_PUBLISHER)),
        first_group(words, [(value, group) for group, value in V.AUDIENCE_WORDS]),
        F.lit(""))


# --- type, rating, genre --------------------------------------------------------------

def detect_type(title, collection, abstract, genre, support, publisher, audience) -> Column:
    """Publisher, else collection, else nine ordered word groups, else the support."""
    audience, support = text_or_empty(audience), F.lower(text_or_empty(support))
    plain_collection = strip_accents(F.lower(text_or_empty(collection)))
    plain_publisher = strip_accents(F.lower(text_or_empty(publisher)))
    words = F.lower(F.concat_ws(" ", *[text_or_empty(x) for x in (
        title, collection, abstract, genre, support)]))
    teen = audience.isin("Ado (12+)", "Ado", "Dès 12 ans")
    named = let(first_group(words, V.TYPE_WORDS), lambda n: F.when(
        (n == "Roman jeunesse") & teen, F.lit("Roman ado / YA")).otherwise(n))
    return F.coalesce(
        first_contained(plain_publisher, folded_table(V.TYPE_OF_PUBLISHER)),
        first_contained(plain_collection, folded_table(V.TYPE_OF_COLLECTION)),
        named,
        F.when(support.contains("texte"),
               F.when(audience.isin("Ado (12+)", "Ado"), F.lit("Roman ado / YA"))
               .otherwise(F.lit("Roman jeunesse"))),
        F.lit(""))


def detect_pegi(kind, audience, text) -> Column:
    """Rating of mangas and comics: stated, else from the audience, else 12 for
    mangas."""
    kind, audience = text_or_empty(kind), text_or_empty(audience)
    stated = none_if_empty(F.regexp_extract(text_or_empty(text), "(?i)PEGI\\s*(\\d+)", 1))
    return F.when(~kind.isin("Manga", "BD"), F.lit("")).otherwise(F.coalesce(
        stated,
        F.when(audience.isin("Ado (12+)", "Dès 12 ans", "12-16 ans"), F.lit("12")),
        F.when(audience.isin("Ado", "Ado / YA") | audience.rlike("(?U)\\b(16|17|18)\\b"),
               F.lit("16")),
        F.when(audience.isin("Jeunesse", "Dès 6 ans", "6-8 ans", "8-12 ans"), F.lit("7")),
        F.when(kind == "Manga", F.lit("12")),
        F.lit("")))


def genre_words_found(c) -> Column:
    """Distinct genre words present in the text as whole words."""
    return listed(F.lower(text_or_empty(c)), [w.strip() for _, words in V.GENRE_WORDS for w in words], whole=True)


def rank_genres(in_title: Column, anywhere: Column) -> Column:
    """3 points per word in the title, 1 per word elsewhere; the two best
    genres, ties in table order, joined by ' / '; NULL when none scores."""
    names = F.array(*[F.lit(name) for name, _ in V.GENRE_WORDS])
    of_word: dict[str, list[int]] = {}
    for rank, (_, words) in enumerate(V.GENRE_WORDS):
        for w in dict.fromkeys(x.strip() for x in words):
            of_word.setdefault(w, []).append(rank)
    table = F.create_map(*[x for w, ranks in of_word.items() for x in (F.lit(w), F.array(*map(F.lit, ranks)))])

    def points(words):
        return F.flatten(F.transform(words, lambda w: table[w]))

    def ranked(titled, others):
        both = F.concat(titled, titled, titled, others)
        scores = F.transform(F.array_distinct(both), lambda g: F.struct(
            F.size(F.filter(both, lambda x: x == g)).alias("score"), (-g).alias("rank")))
        best = F.slice(F.sort_array(scores, False), 1, 2)
        return none_if_empty(F.array_join(F.transform(best, lambda s: F.get(names, -s["rank"])), " / "))

    def given(titled, found):
        return let(points(titled), lambda a: let(points(F.array_except(found, titled)), lambda b: ranked(a, b)))
    # most texts hold no such word
    return let(in_title, lambda titled: let(anywhere, lambda found: F.when(
        F.size(titled) + F.size(found) > 0, given(titled, found))))


def score_genres(title, collection, abstract, subjects, kind) -> Column:
    """Two best genres by weighted words, else the default of the type, else ''."""
    everything = F.concat_ws(" ", *[text_or_empty(x) for x in (
        title, collection, abstract, subjects)])
    ranked = rank_genres(genre_words_found(title), genre_words_found(everything))
    return F.coalesce(ranked, lookup(text_or_empty(kind), V.GENRE_OF_TYPE), F.lit(""))


def canonical_genre(c) -> Column:
    """struct(value, reason): pairs completed, synonyms replaced, doubles of the
    category column flagged but kept, repeats dropped in order."""
    c = col(c)
    parts = F.filter(F.transform(F.split(c, "/"), lambda p: F.trim(p)), lambda p: p != "")

    def step(part):
        key = fold_key(part)
        pair, synonym = lookup(key, V.GENRE_PAIRS), lookup(key, V.GENRE_SYNONYMS)
        double = key.isin(*V.CATEGORY_DOUBLES)
        new = F.when(double, part).otherwise(F.coalesce(pair, synonym, part))
        reason = (F.when(double, F.concat(F.lit("« "), part,
                                          F.lit(" » double la colonne categorie : à trancher")))
                  .when(pair.isNotNull(),
                        F.concat(F.lit("« "), part, F.lit(" » -> paire « "), pair, F.lit(" »")))
                  .when(synonym.isNotNull(),
                        F.concat(F.lit("« "), part, F.lit(" » -> « "), synonym, F.lit(" »"))))
        return F.struct(new.alias("new"), fold_key(new).alias("key"), reason.alias("reason"))

    steps = F.transform(parts, step)
    start = F.struct(F.array().cast("array<string>").alias("keys"),
                     F.array().cast("array<string>").alias("kept"),
                     F.array().cast("array<string>").alias("reasons"))

    def merge(acc, s):
        seen = F.array_contains(acc["keys"], s["key"])
        said = F.filter(F.array(s["reason"], F.when(seen, F.lit("doublon retiré"))),
                        lambda r: r.isNotNull())
        return F.struct(
            F.when(seen, acc["keys"]).otherwise(F.array_append(acc["keys"], s["key"])).alias("keys"),
            F.when(seen, acc["kept"]).otherwise(F.array_append(acc["kept"], s["new"])).alias("kept"),
            F.concat(acc["reasons"], said).alias("reasons"))

    done = F.aggregate(steps, start, merge)
    return F.when(blank(c), F.struct(c.alias("value"), F.lit("").alias("reason"))).otherwise(
        F.struct(F.array_join(done["kept"], " / ").alias("value"),
                 F.array_join(F.array_distinct(done["reasons"]), " ; ").alias("reason")))


# --- series or collection ---------------------------------------------------------------

def is_collection(c) -> Column:
    """Looks like a publisher's collection rather than a series."""
    c = text_or_empty(c)
    key = fold_text(c, "space")
    named = (key.isin(*V.KNOWN_COLLECTIONS)
             | key.rlike("|".join(V.COLLECTION_PATTERNS))
             | key.rlike("^(" + "|".join(V.COLLECTION_FIRST_WORDS) + ")( |$)"))
    return c.contains("(") | ((key != "") & named)


def series_or_collection(series, volume) -> Column:
    """struct(ok, reason)."""
    series = text_or_empty(series)

    def verdict(ok, name):
        return F.struct(F.lit(ok).alias("ok"), F.lit(V.SERIES_VERDICTS[name]).alias("reason"))

    return (F.when(series == "", verdict(False, "empty"))
            .when(series.contains("("), verdict(False, "authority"))
            .when(is_collection(series) & (text_or_empty(volume) != ""), verdict(False, "numbered"))
            .when(is_collection(series), verdict(False, "collection"))
            .otherwise(verdict(True, "series")))


# --- catalogue record rules -----------------------------------------------------------------

def derive_category(subjects, audience) -> Column:
    """First mapped subject; novels depend on the audience."""
    subjects, audience = col(subjects), text_or_empty(audience)
    mapped = F.filter(F.transform(subjects, lambda s: lookup(s, V.CATEGORY_OF_SUBJECT)),
                      lambda v: v.isNotNull())
    novel = (F.when(audience == "Adulte", F.lit(None).cast("string"))
             .when(audience.isin("Ado (12+)", "Adolescent"), F.lit("Roman ado / YA"))
             .otherwise(F.lit("Roman jeunesse")))
    return (F.when(F.array_contains(subjects, V.NOVELS_SUBJECT), novel)
            .otherwise(F.get(mapped, F.lit(0))))


def derive_genre(subjects) -> Column:
    """At most two distinct mapped genres in subject order."""
    mapped = F.filter(F.transform(col(subjects), lambda s: lookup(s, V.GENRE_OF_SUBJECT)),
                      lambda v: v.isNotNull())
    return none_if_empty(F.array_join(F.slice(F.array_distinct(mapped), 1, 2), " / "))


def game_value(fields, name: str, whole: bool = False) -> Column:
    """Last labelled value among array<struct<code,label,scheme>> fields; the
    labels exclude each other in table order."""
    fields = col(fields)
    order = [n for n, _, _ in V.GAME_LABELS]

    def label_of(x):
        chain = None
        for wanted, scheme, text in V.GAME_LABELS:
            test = (text_or_empty(x["scheme"]).contains(scheme)
                    | text_or_empty(x["label"]).contains(text))
            chain = F.when(test, wanted) if chain is None else chain.when(test, wanted)
        return chain

    assert name in order
    mine = F.filter(fields, lambda x: label_of(x) == name)
    if whole:
        values = F.filter(F.transform(mine, lambda x: F.trim(x["code"]).try_cast("int")),
                          lambda v: v.isNotNull())
    else:
        values = F.transform(mine, lambda x: F.coalesce(none_if_empty(x["label"]), x["code"]))
    return F.try_element_at(values, F.lit(-1))


def role_holder(contributors, role: str) -> Column:
    """First contributor with the role, of array<struct<role,name>>."""
    return F.get(F.filter(col(contributors), lambda p: p["role"] == role), F.lit(0))["name"]


def resolve_author(contributors, display: bool = False) -> Column:
    """Role 070, else the first without a role (any first one for display)."""
    people = col(contributors)
    spare = people if display else F.filter(people, lambda p: p["role"].isNull())
    return F.coalesce(role_holder(people, "070"), F.get(spare, F.lit(0))["name"])


def is_comic_subject(subjects) -> Column:
    return F.exists(col(subjects), lambda s: F.lower(s).rlike("bande|manga|comic|^\\s*bd\\s*$"))


def series_by_precedence(title, part, linked, linked_volume, collection, collection_volume,
                         comic) -> Column:
    """struct(series, volume): numbered part, linked series (with or without a
    volume), collection of a comic."""
    def pair(series, volume):
        return F.struct(series.alias("series"), volume.alias("volume"))
    nothing = F.lit(None).cast("string")
    return (F.when(filled(part), pair(col(title), col(part)))
            .when(filled(linked) & filled(linked_volume),
                  pair(series_name(linked), col(linked_volume)))
            .when(filled(linked), pair(series_name(linked), nothing))
            .when(filled(collection) & col(comic),
                  pair(series_name(collection), col(collection_volume)))
            .otherwise(pair(nothing, nothing)))


def document_type(periodical_date, support) -> Column:
    chain = F.when(filled(periodical_date), F.lit("REVUE"))
    for supports, kind in V.SUPPORT_TYPES:
        chain = chain.when(col(support).isin(*supports), F.lit(kind))
    return chain.otherwise(F.lit("AUTRE"))


def publisher_canonical(c) -> Column:
    """Trimmed of ``.,;``; exact form, else the first contained form, else kept."""
    bare = F.trim(F.trim(col(c)), F.lit(".,;"))
    lowered = F.lower(bare)
    return F.coalesce(lookup(lowered, V.PUBLISHER_FORMS),
                      first_contained(lowered, V.PUBLISHER_FORMS), bare)


# --- suggestions --------------------------------------------------------------------------------

def classify_suggestion(title, motive, source) -> Column:
    """struct(category, audience, genre) by words; explicit defaults at the end."""
    words = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(motive)))
    by_source = F.when(contains_any(F.lower(text_or_empty(source)), V.YOUTH_SOURCE_WORDS),
                       F.lit("Jeunesse"))
    return F.struct(
        F.coalesce(first_group(words, V.SUGGESTION_CATEGORY_WORDS),
                   F.lit(V.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(first_group(words, V.SUGGESTION_AUDIENCE_WORDS), by_source,
                   F.lit(V.DEFAULT_AUDIENCE)).alias("audience"),
        F.coalesce(first_group(words, V.SUGGESTION_GENRE_WORDS),
                   F.lit(V.DEFAULT_GENRE)).alias("genre"))


def match_confidence(title_score, author_score, author, found) -> Column:
    t, a = col(title_score), F.coalesce(col(author_score), F.lit(0.0))
    return (F.when((t >= 0.8) & ((a >= 0.4) | blank(author)), F.lit("élevée"))
            .when(t >= 0.5, F.lit("moyenne"))
            .when(filled(found), F.lit("faible"))
            .otherwise(F.lit("—")))


def provenance_marker(**pairs) -> Column:
    """Names of the fields found while the record had none, ``a,b`` or NULL.
    Each keyword is field=(current column, found column)."""
    marks = [F.when(blank(old) & filled(new), F.lit(name)) for name, (old, new) in pairs.items()]
    return none_if_empty(F.array_join(F.array_compact(F.array(*marks)), ","))


def category_hint(classification, audience) -> Column:
    """Kind of document a source priority is chosen by."""
    c = F.lower(text_or_empty(classification))
    teen = text_or_empty(audience).isin("Adolescent", "Ado (12+)")
    return (F.when(c.contains("manga"), F.lit("manga"))
            .when(c.contains("bande dessinée") | c.contains("bd"), F.lit("bd"))
            .when(c.contains("documentaire"), F.lit("documentaire"))
            .when(c.contains("roman"), F.when(teen, F.lit("roman_ado"))
                  .otherwise(F.lit("roman_jeunesse"))))


def source_priority(kind, source, preferred: dict, order: list) -> Column:
    """Rank of a source: those preferred for the kind first, then the usual order."""
    rank = lookup(col(source), {name: i for i, name in enumerate(order)})
    ahead = F.lit(False)
    for name, sources in preferred.items():
        ahead = ahead | F.coalesce((col(kind) == name) & col(source).isin(*sources), F.lit(False))
    return F.when(ahead, rank).otherwise(rank + len(order))


def support_excluded(c) -> Column:
    return contains_any(F.lower(text_or_empty(c)), V.EXCLUDED_SUPPORTS)


def title_excluded(c) -> Column:
    plain = F.lower(strip_accents(text_or_empty(c)))
    return contains_any(plain, V.EXCLUDED_TITLE_WORDS) | plain.rlike(V.BUNDLE_PATTERN)


def price_acceptable(price, origin) -> Column:
    cap = F.when(text_or_empty(origin).startswith("Tome"), V.PRICE_CAP_VOLUME).otherwise(V.PRICE_CAP)
    return F.coalesce((col(price) > 0) & (col(price) <= cap), F.lit(False))


def comic_excluded(publisher, title) -> Column:
    p = F.lower(strip_accents(text_or_empty(publisher)))
    t = F.lower(strip_accents(text_or_empty(title)))
    return (contains_any(p, V.EXCLUDED_COMIC_PUBLISHERS) | contains_any(p, V.EXCLUDED_COMIC_WORDS)
            | contains_any(t, V.EXCLUDED_COMIC_WORDS))


def youth_comic(publisher, title, as_written: bool = False) -> Column:
    """Specialised publisher, else a detected youth or teen audience.

    The detection says ``Ado (12+)``; it is normalised first so that teens
    match.  ``as_written=True`` keeps the unnormalised comparison.
    """
    p = F.lower(strip_accents(text_or_empty(publisher)))
    found = detect_audience(F.lit(""), title, F.lit(""), publisher, F.lit(""))
    audience = found if as_written else normalise_audience(found)
    return contains_any(p, V.YOUTH_COMIC_PUBLISHERS) | audience.isin("Jeunesse", "Adolescent")


def stale_selection(name, url, year: int) -> Column:
    """A dated list is stale: back-to-school lists from a past year, others
    more than two years old; an undated one never."""
    text = F.concat_ws(" ", text_or_empty(name), text_or_empty(url))
    newest = F.array_max(F.transform(
        F.regexp_extract_all(text, F.lit("\\b(20\\d{2})\\b"), 1), lambda y: y.cast("int")))
    back_to_school = F.lower(text).rlike("rentree|rentrée")
    limit = F.when(back_to_school, F.lit(year)).otherwise(F.lit(year - 2))
    return F.coalesce(newest < limit, F.lit(False))


# --- weeding and shelfmarks ------------------------------------------------------------------------

def dewey_number(c) -> Column:
    return F.rpad(F.regexp_extract(F.trim(text_or_empty(c)), "^(\\d{1,3})", 1), 3, "0").try_cast("int")


def weeding_rule(dewey) -> Column:
    """struct(age, idle, label) of the classification band; NULL without one."""
    digits = F.regexp_extract(F.trim(text_or_empty(dewey)), "^(\\d{1,3})", 1)
    number = dewey_number(dewey)
    chain = None
    for low, high, age, idle, label in V.DEWEY_BANDS:
        value = F.struct(F.lit(age).alias("age"), F.lit(idle).alias("idle"),
                         F.lit(label).alias("label"))
        test = (digits != "") & (number >= low) & (number < high)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def weeding_class(dewey, category, audience, age, loans, last_loan_year, year: int) -> Column:
    """struct(class, rule) of the first weeding rule a copy falls under, else NULL."""
    category, audience = text_or_empty(category), text_or_empty(audience)
    idle = F.lit(year) - col(last_loan_year)
    never = (F.coalesce(col(loans), F.lit(0)) == 0) & col(last_loan_year).isNull()
    documentary = (category == "Documentaire") | (
        filled(dewey) & ~category.isin("BD", "Manga", "Album"))

    def hit(name, label):
        return F.struct(F.lit(V.WEEDING_CLASSES[name]).alias("class"),
                        (F.lit(label) if isinstance(label, str) else label).alias("rule"))

    comic, youth = category.isin(*V.COMIC_CATEGORIES), category.isin(*V.YOUTH_CATEGORIES)
    return let(weeding_rule(dewey), lambda rule: (
        F.when(documentary & filled(dewey) & (col(age) >= rule["age"])
               & (never | (idle >= rule["idle"])), hit("documentary", rule["label"]))
        .when(comic & never & (col(age) >= 10),
              hit("comic_never", "BD/manga : jamais prêté et > 10 ans"))
        .when(comic & (idle >= 10), hit("comic_idle", "BD/manga : sans prêt depuis 10 ans"))
        .when(~comic & youth & (idle >= 5), hit("youth_idle", "Jeunesse : sans prêt depuis 5 ans"))
        .when(~comic & ~youth & (audience == "Adulte") & ~documentary & (idle >= 5),
              hit("adult_idle", "Roman adulte : sans prêt depuis 5 ans (classiques à conserver !)"))))


def film_anomalies(shelfmark, publisher, creators, audience) -> Column:
    """Names of the shelfmark anomalies of a film copy, an empty array if none."""
    mark = F.trim(text_or_empty(shelfmark))
    prefix = F.upper(F.regexp_extract(mark, "(?U)^(FJ|F)\\s+([A-Za-z]{2,3})\\b", 1))
    letters = F.upper(F.regexp_extract(mark, "(?U)^(FJ|F)\\s+([A-Za-z]{2,3})\\b", 2))
    conform = mark.rlike("^(J\\s+)?\\d") | mark.rlike("(?U)^B\\s+[A-Za-z]{2,4}\\b") | mark.rlike("(?iU)^JV\\b")
    people = F.lower(strip_accents(F.concat_ws(" ", text_or_empty(publisher), text_or_empty(creators))))
    studio = people.rlike("disney|pixar")
    studio_mark = (prefix == "FJ") & (letters == "DIS")
    expected = director_letters(creators)
    audience = text_or_empty(audience)
    checked = (mark != "") & ~conform & (prefix != "")
    plain = checked & ~studio & ~studio_mark
    flags = F.array(
        F.when(mark == "", "cote_absente"),
        F.when((mark != "") & ~conform & (prefix == ""), "cote_non_conforme"),
        F.when(checked & (((prefix == "F") & (audience == "Jeunesse"))
                          | ((prefix == "FJ") & (audience == "Adulte"))), "public_incoherent"),
        F.when(checked & studio & ~studio_mark, "disney_mal_cote"),
        F.when(checked & ~studio & studio_mark, "fjdis_pas_disney"),
        F.when(plain & expected.isNull(), "sans_realisateur"),
        F.when(plain & (letters != expected), "lettres_discordantes"))
    return F.array_compact(flags)


# --- periods, classes, opening hours ------------------------------------------------------------------

def period_bucket(year) -> Column:
    """Six publication periods; the year is compared as text."""
    year = col(year).cast("string")
    chain = None
    for start, label in V.PERIODS:
        chain = F.when(year >= start, label) if chain is None else chain.when(year >= start, label)
    return chain.otherwise(V.OLDEST_PERIOD)


def dewey_class(c) -> Column:
    return F.concat(F.substring(col(c), 1, 1), F.lit("00"))


def is_open(ts) -> Column:
    """Open to the public at the moment, by the fixed opening rules."""
    ts = col(ts)
    month, weekday = F.month(ts), F.weekday(ts)
    clock = F.date_format(ts, "HH:mm")
    test = F.lit(False)
    for first, last, days, opens, closes, public in V.OPENING_RULES:
        if public:
            test = test | (month.between(first, last) & weekday.isin(*days)
                           & (clock >= opens) & (clock < closes))
    return test

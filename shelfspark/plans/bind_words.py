"""Rules about words, on texts put together from table values and every word that a rule knows.

The SQL holds the rule itself, written out from the fixed word tables; the texts it reads are built
alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import vocab as V
from shelfspark.functions import volumes as N
from shelfspark.operators import audit
from shelfspark.operators.suggestions import classify_suggestions as classify
from shelfspark.plans import jobs
from shelfspark.plans.registry import query
from shelfspark.session import spread


def literal(v) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'"


class Built:
    """A text expression on both sides: ``spark``, made when a session is there, and ``sql``."""

    def __init__(self, make, sql: str):
        self.make, self.sql = make, sql

    @property
    def spark(self):
        return self.make()

    def __add__(self, other: Built) -> Built:
        return Built(lambda: F.concat(self.spark, other.spark), f"({self.sql} || {other.sql})")

    def when(self, column: str, modulus: int, rest: int) -> Built:
        """This text where column % modulus = rest, else an empty one."""
        return Built(lambda: F.when(F.col(column) % modulus == rest, self.spark).otherwise(""), f"(case when {column} % {modulus} = {rest} then {self.sql} else '' end)")


def of(column: str) -> Built:
    return Built(lambda: F.col(column).cast("string"), f"{column}::varchar")


def said(text: str) -> Built:
    return Built(lambda: F.lit(text), literal(text))


def nth(words, key: str, factor: int = 1) -> Built:
    """The word at place key * factor, counted round the list."""
    words = list(words)

    def make():
        place = F.pmod(F.col(key) * factor, F.lit(len(words))).cast("int")
        return F.get(F.array(*map(F.lit, words)), place)
    return Built(make, f"[{', '.join(map(literal, words))}][{key} * {factor} % {len(words)} + 1]")


def one_of(key: str, *forms: Built) -> Built:
    def make():
        chain = F.when(F.col(key) % len(forms) == 0, forms[0].spark)
        for i, form in enumerate(forms[1:], 1):
            chain = chain.when(F.col(key) % len(forms) == i, form.spark)
        return chain
    cases = " ".join(f"when {key} % {len(forms)} = {i} then {form.sql}" for i, form in enumerate(forms))
    return Built(make, f"(case {cases} end)")


def holds(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {literal(w)})" for w in words) + ")"


def first_key(text: str, table) -> str:
    return "case " + " ".join(f"when contains({text}, {literal(k)}) then {literal(v)}" for k, v in table) + " end"


def first_group(text: str, groups) -> str:
    return "case " + " ".join(f"when {holds(text, words)} then {literal(name)}" for name, words in groups) + " end"


def exact(text: str, table: dict) -> str:
    return "case " + " ".join(f"when {text} = {literal(k)} then {literal(v)}" for k, v in table.items()) + " end"


def folded(c: str) -> str:
    return f"lower(strip_accents({c}))"


# --- audience, type, rating ------------------------------------------------------------------------

KEY = "o_orderkey"
AUDIENCE = {
    "code": nth(["j", "Y", "a", "B", "c", "d", "z"], KEY).when(KEY, 7, 1),
    "title": said("Récit ") + nth([w for words, _ in V.AUDIENCE_WORDS for w in words] + ["du monde"] * 9, KEY) + said(" ") + of("o_orderpriority"),
    "collection": nth([k.title() for k in V.AUDIENCE_OF_COLLECTION], KEY, 3).when(KEY, 7, 2),
    "publisher": (said("Éditions ") + nth([k.upper() for k in V.AUDIENCE_OF_PUBLISHER], KEY, 5)).when(KEY, 7, 3),
    "age": (nth(["", "dès ", "à partir de ", "lycée, "], KEY, 11) + of("age") + nth([" ans", " à 13 ans", "", "-12"], KEY, 3)).when(KEY, 7, 0),
}


def audience_sql(code: str, title: str, collection: str, publisher: str, age: str) -> str:
    ladder = " ".join(f"when regexp_matches(lower(trim({age})), {literal(p)}) then {literal(v)}" for p, v in V.AGE_LADDER)
    words = f"lower({title} || ' ' || {collection})"
    return (f"coalesce(case when trim({age}) = '' then null {ladder} when regexp_matches(trim({age}), '\\d') then trim({age}) end,"
            f" {exact(f'lower({code})', V.AUDIENCE_CODES)}, {first_key(folded(collection), R.folded_table(V.AUDIENCE_OF_COLLECTION))},"
            f" {first_key(folded(publisher), R.folded_table(V.AUDIENCE_OF_PUBLISHER))}, {first_group(words, [(v, g) for g, v in V.AUDIENCE_WORDS])}, '')")


@query("detect_audience", f"""
with o as (select *, o_orderkey // 7 % 18 as age from orders),
 x as (select o_orderkey, {', '.join(f'{b.sql} as {n}' for n, b in AUDIENCE.items() if n != 'age')}, {AUDIENCE['age'].sql} as stated from o)
select o_orderkey, {audience_sql('code', 'title', 'collection', 'publisher', 'stated')} as audience from x""")
def detect_audience(t):
    df = t.orders.withColumn("age", (F.floor(F.col(KEY) / 7) % 18))
    return df.select(KEY, R.detect_audience(*[b.spark for b in AUDIENCE.values()]).alias("audience"))


TYPED = {
    "title": said("Un ") + nth([w for _, words in V.TYPE_WORDS for w in words][::2] + ["texte"] * 7, KEY),
    "collection": nth([k.upper() for k in V.TYPE_OF_COLLECTION], KEY, 3).when(KEY, 5, 1),
    "abstract": (said("avec ") + nth([w for _, words in V.TYPE_WORDS for w in words][1::2], KEY, 7)).when(KEY, 3, 0),
    "support": nth(["Texte imprimé", "DVD", "texte", ""], KEY),
    "publisher": (nth([k.title() for k in V.TYPE_OF_PUBLISHER], KEY, 5) + said(" SA")).when(KEY, 6, 2),
    "audience": nth(["Ado (12+)", "Ado", "Dès 12 ans", "Jeunesse", ""], KEY, 2),
}


@query("detect_type", f"""
with x as (select o_orderkey, {', '.join(f'{b.sql} as {n}' for n, b in TYPED.items())} from orders),
 y as (select *, {first_group("lower(title || ' ' || collection || ' ' || abstract || '  ' || support)", V.TYPE_WORDS)} as named from x)
select o_orderkey, coalesce({first_key(folded('publisher'), R.folded_table(V.TYPE_OF_PUBLISHER))}, {first_key(folded('collection'), R.folded_table(V.TYPE_OF_COLLECTION))},
  case when named = 'Roman jeunesse' and audience in ('Ado (12+)', 'Ado', 'Dès 12 ans') then 'Roman ado / YA' else named end,
  case when contains(lower(support), 'texte') then case when audience in ('Ado (12+)', 'Ado') then 'Roman ado / YA' else 'Roman jeunesse' end end, '') as type from y""")
def detect_type(t):
    b = {n: x.spark for n, x in TYPED.items()}
    found = R.detect_type(b["title"], b["collection"], b["abstract"], F.lit(""), b["support"], b["publisher"], b["audience"])
    return t.orders.select(KEY, found.alias("type"))


RATED = {
    "kind": nth(["Manga", "BD", "Album", "Manga", "BD"], "p_partkey"),
    "audience": nth(["Ado (12+)", "Dès 12 ans", "12-16 ans", "Ado", "Ado / YA", "Jeunesse", "Dès 6 ans", "6-8 ans", "8-12 ans", "16 ans", "dès 17", "Adulte", ""], "p_partkey", 3),
    "text": one_of("p_size", of("p_name"), said("noté pegi ") + of("p_size"), of("p_name"), said("PEGI") + of("p_size") + said(" ; ") + of("p_name")),
}


@query("detect_pegi", f"""
with x as (select p_partkey, {', '.join(f'{b.sql} as {n}' for n, b in RATED.items())} from part)
select p_partkey, case when kind not in ('Manga', 'BD') then '' when regexp_matches(text, '(?i)PEGI\\s*\\d+') then regexp_extract(text, '(?i)PEGI\\s*(\\d+)', 1)
  when audience in ('Ado (12+)', 'Dès 12 ans', '12-16 ans') then '12' when audience in ('Ado', 'Ado / YA') or regexp_matches(audience, '\\b(16|17|18)\\b') then '16'
  when audience in ('Jeunesse', 'Dès 6 ans', '6-8 ans', '8-12 ans') then '7' when kind = 'Manga' then '12' else '' end as pegi from x""")
def detect_pegi(t):
    return t.part.select("p_partkey", R.detect_pegi(*[b.spark for b in RATED.values()]).alias("pegi"))


# --- publishers, subjects, suggestions -------------------------------------------------------------

_FORMS = list(V.PUBLISHER_FORMS)
PUBLISHER = one_of("p_size", nth([k.title() for k in _FORMS], "p_partkey") + said("."), said("Groupe ") + nth(_FORMS, "p_partkey") + said(" & fils ;"),
                   said(" ") + of("p_brand") + said(" "), nth([k.upper() for k in _FORMS], "p_partkey"))


@query("publisher_canonical", f"""
with x as (select p_partkey, trim(trim({PUBLISHER.sql}), '.,;') as bare from part)
select p_partkey, coalesce({exact('lower(bare)', V.PUBLISHER_FORMS)}, {first_key('lower(bare)', V.PUBLISHER_FORMS.items())}, bare) as publisher from x""")
def publisher_canonical(t):
    return t.part.select("p_partkey", R.publisher_canonical(PUBLISHER.spark).alias("publisher"))


_SUBJECTS = list(dict.fromkeys([*V.CATEGORY_OF_SUBJECT, *V.GENRE_OF_SUBJECT, V.NOVELS_SUBJECT, "Mer", "Romans graphiques"]))
FIRST, SECOND = nth(_SUBJECTS, KEY), nth(_SUBJECTS, KEY, 7)
READERS = nth(["Adulte", "Adolescent", "Jeunesse", "Ado (12+)"], KEY, 3)
COMIC = "regexp_matches(lower({0}), 'bande|manga|comic|^\\s*bd\\s*$')"


@query("subject_rules", f"""
with x as (select o_orderkey, {FIRST.sql} as a, {SECOND.sql} as b, {READERS.sql} as reader from orders),
 g as (select *, {exact('a', V.GENRE_OF_SUBJECT)} as ga, {exact('b', V.GENRE_OF_SUBJECT)} as gb from x)
select o_orderkey, case when {literal(V.NOVELS_SUBJECT)} in (a, b) then case when reader = 'Adulte' then null when reader in ('Ado (12+)', 'Adolescent') then 'Roman ado / YA'
   else 'Roman jeunesse' end else coalesce({exact('a', V.CATEGORY_OF_SUBJECT)}, {exact('b', V.CATEGORY_OF_SUBJECT)}) end as category,
  case when ga is not null and gb is not null and ga <> gb then ga || ' / ' || gb else coalesce(ga, gb) end as genre,
  {COMIC.format('a')} or {COMIC.format('b')} as comic from g""")
def subject_rules(t):
    df = t.orders.select(KEY, F.array(FIRST.spark, SECOND.spark).alias("s"), READERS.spark.alias("a"))
    return df.select(KEY, R.derive_category("s", "a").alias("category"), R.derive_genre("s").alias("genre"), R.is_comic_subject("s").alias("comic"))


_KNOWN = [w for groups in (V.SUGGESTION_CATEGORY_WORDS, V.SUGGESTION_AUDIENCE_WORDS, V.SUGGESTION_GENRE_WORDS) for _, words in groups for w in words]
SUGGESTED = {"t": said("Le ") + nth(_KNOWN + ["x"] * 5, KEY) + said(" ") + of("o_orderpriority"), "m": nth([w.upper() for w in _KNOWN], KEY, 3).when(KEY, 3, 0),
             "s": nth(["Ricochet", "La lettre", "Veille JEUNESSE", ""], KEY, 5)}
_TEXT = "lower(t || ' ' || m)"


@query("classify_suggestions", f"""
with x as (select o_orderkey, {', '.join(f'{b.sql} as {n}' for n, b in SUGGESTED.items())} from orders)
select o_orderkey, case when o_orderkey % 7 = 0 then 'Fixed' else coalesce({first_group(_TEXT, V.SUGGESTION_CATEGORY_WORDS)}, {literal(V.DEFAULT_CATEGORY)}) end as category,
  coalesce({first_group(_TEXT, V.SUGGESTION_AUDIENCE_WORDS)}, case when {holds('lower(s)', V.YOUTH_SOURCE_WORDS)} then 'Jeunesse' end, {literal(V.DEFAULT_AUDIENCE)}) as audience,
  coalesce({first_group(_TEXT, V.SUGGESTION_GENRE_WORDS)}, {literal(V.DEFAULT_GENRE)}) as genre from x""")
def classify_suggestions(t):
    df = t.orders.select(KEY, *[b.spark.alias(n) for n, b in SUGGESTED.items()], F.when(F.col(KEY) % 7 == 0, "Fixed").otherwise("").alias("category"))
    return classify(df, "t", "m", "s").drop("t", "m", "s")


# --- what orders and lists leave out ---------------------------------------------------------------

_HOUSES = [*V.YOUTH_COMIC_PUBLISHERS, *V.EXCLUDED_COMIC_PUBLISHERS, *V.AUDIENCE_OF_PUBLISHER, "inconnu"]
HOUSE = nth([h.title() for h in _HOUSES], "p_partkey")
COMIC_TITLE = said("Le ") + nth([*V.EXCLUDED_COMIC_WORDS, *[w for words, _ in V.AUDIENCE_WORDS for w in words], "vent", "chat", "jeu"], "p_partkey", 5) + said(" de ") + of("p_name")
YOUNG = ["Jeunesse", "Ado (12+)", "Dès 3 ans", "Dès 6 ans", "8-12 ans"]


@query("youth_comics", f"""
with x as (select p_partkey, {HOUSE.sql} as house, {COMIC_TITLE.sql} as title from part)
select p_partkey, {holds(folded('house'), V.YOUTH_COMIC_PUBLISHERS)} or {audience_sql("''", 'title', "''", 'house', "''")} in ({', '.join(map(literal, YOUNG))}) as youth,
  {holds(folded('house'), [*V.EXCLUDED_COMIC_PUBLISHERS, *V.EXCLUDED_COMIC_WORDS])} or {holds(folded('title'), V.EXCLUDED_COMIC_WORDS)} as excluded from x""")
def youth_comics(t):
    return t.part.select("p_partkey", R.youth_comic(HOUSE.spark, COMIC_TITLE.spark).alias("youth"), R.comic_excluded(HOUSE.spark, COMIC_TITLE.spark).alias("excluded"))


ORDERED = {"title": of("p_name") + said(" ") + nth([w.upper() for w in V.EXCLUDED_TITLE_WORDS] + ["rouge", "paquet", "intérieur", "exquis"] * 5, "p_partkey"),
           "lot": one_of("p_size", said(""), said(" 10 ex"), said(" 3ex."), said(" 12 exemplaires"), said("")),
           "support": nth([w.title() for w in V.EXCLUDED_SUPPORTS] + ["Poche", "Broché", "Relié"] * 3, "p_partkey", 7),
           "origin": nth(["Tome manquant", "Suggestion veille"], "p_partkey")}


@query("order_exclusions", f"""
with x as (select p_partkey, {', '.join(f'{b.sql} as {n}' for n, b in ORDERED.items())}, case when p_size % 9 <> 0 then p_retailprice - 940 end as price from part)
select p_partkey, {holds(folded('title || lot'), V.EXCLUDED_TITLE_WORDS)} or regexp_matches({folded('title || lot')}, {literal(V.BUNDLE_PATTERN)}) as title,
  {holds('lower(support)', V.EXCLUDED_SUPPORTS)} as support, coalesce(price > 0 and price <= case when origin = 'Tome manquant' then 28 else 40 end, false) as price from x""")
def order_exclusions(t):
    b = {n: x.spark for n, x in ORDERED.items()}
    price = F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice") - 940)
    return t.part.select("p_partkey", R.title_excluded(F.concat(b["title"], b["lot"])).alias("title"), R.support_excluded(b["support"]).alias("support"),
                         R.price_acceptable(price, b["origin"]).alias("price"))


LISTED = {"name": one_of(KEY, said("Rentrée littéraire ") + of("year"), said("Prix ") + of("year") + said(" et ") + of("before"), said("Coups de coeur"), said("La RENTREE ") + of("before"), said("Lot 12") + of("year")),
          "url": one_of("year", said(""), said("/list-3/rentree-") + of("year") + said("/"), said("/list-4/") + of("before"))}


@query("stale_selections", f"""
with o as (select o_orderkey, (2018 + o_orderkey // 5 % 10)::int as year, (2017 + o_orderkey // 5 % 10)::int as before from orders),
 x as (select o_orderkey, {LISTED['name'].sql} || ' ' || {LISTED['url'].sql} as text from o),
 y as (select *, list_max([y::int for y in regexp_extract_all(text, '\\b(20\\d{{2}})\\b', 1)]) as newest from x)
select o_orderkey, coalesce(newest < case when regexp_matches(lower(text), 'rentree|rentrée') then 2026 else 2024 end, false) as stale from y""")
def stale_selections(t):
    df = t.orders.withColumn("year", (2018 + F.floor(F.col(KEY) / 5) % 10).cast("int")).withColumn("before", F.col("year") - 1)
    return df.select(KEY, R.stale_selection(LISTED["name"].spark, LISTED["url"].spark, 2026).alias("stale"))


# --- genres, collections ---------------------------------------------------------------------------

_GENRES = [*[g.title() for g in V.GENRE_PAIRS], *V.GENRE_SYNONYMS, *[g.upper() for g in V.CATEGORY_DOUBLES], "Amour / Romance", "Humour", "Récits  de vie", "Poésie"]
GENRE = one_of(KEY, nth(_GENRES, KEY) + said("/") + nth(_GENRES, KEY, 3), nth(_GENRES, KEY), nth(_GENRES, KEY) + said(" / ") + nth(_GENRES, KEY, 5), said(" ") + nth(_GENRES, KEY, 7) + said(" "), said(""))


def _key(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g'))"


def _genre_sql() -> str:
    """Parts in order, each with its replacement and reason; repeats by folded replacement go."""
    return f"""
x as (select o_orderkey, {GENRE.sql} as current from orders),
q as (select *, list_filter(list_transform(string_split(current, '/'), lambda y: trim(y)), lambda y: y <> '') as parts from x),
p as (select o_orderkey, current, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from q),
k as (select *, {_key('part')} as key from p),
m as (select *, {exact('key', V.GENRE_PAIRS)} as pair, {exact('key', V.GENRE_SYNONYMS)} as synonym, key in ({', '.join(map(literal, V.CATEGORY_DOUBLES))}) as twice from k),
n as (select *, case when twice then part else coalesce(pair, synonym, part) end as new,
   case when twice then '« ' || part || ' » double la colonne categorie : à trancher' when pair is not null then '« ' || part || ' » -> paire « ' || pair || ' »'
        when synonym is not null then '« ' || part || ' » -> « ' || synonym || ' »' end as reason from m),
s as (select *, row_number() over (partition by o_orderkey, {_key('new')} order by i) > 1 as seen from n),
r as (select o_orderkey, 2 * i as spot, reason from s where reason is not null union all select o_orderkey, 2 * i + 1, 'doublon retiré' from s where seen),
d as (select o_orderkey, reason, min(spot) as spot from r group by 1, 2),
g as (select x.o_orderkey, x.current, case when trim(x.current) = '' then x.current else coalesce(v.value, '') end as value, coalesce(w.reason, '') as reason from x
  left join (select o_orderkey, string_agg(new, ' / ' order by i) as value from s where not seen group by 1) v using (o_orderkey)
  left join (select o_orderkey, string_agg(reason, ' ; ' order by spot) as reason from d group by 1) w using (o_orderkey))"""


@query("genre_rule", f"with {_genre_sql()} select o_orderkey, value, reason from g")
def genre_rule(t):
    return t.orders.select(KEY, R.canonical_genre(GENRE.spark).alias("g")).select(KEY, "g.value", "g.reason")


@query("mapping_sheet", f"""with {_genre_sql()}
select current, count(*) as n, value as proposed, case when value = current then '' else 'OUI' end as changed, reason from g where trim(current) <> '' group by current, value, reason""")
def mapping_sheet(t):
    return audit.mapping_sheet(t.orders.select(GENRE.spark.alias("genre")), "genre", R.canonical_genre)


_NAMES = [*[c.title() for c in V.KNOWN_COLLECTIONS], *[w + " junior" for w in V.COLLECTION_FIRST_WORDS], "Collection dirigée par X", "Les Albums", "Fantasy", "10-18", "Éd. de la Loupe"]
NAMED = one_of(KEY, nth(_NAMES, "seventh"), of("o_orderpriority"), nth(_NAMES, "seventh", 3) + said(" (Paris"), said("Thorgal ") + of(KEY), said(" ") + of(KEY) + said(" "), nth(_NAMES, "seventh", 5), said(""))
VOLUME = Built(lambda: F.when(F.col(KEY) % 3 == 0, F.col(KEY).cast("string")), "(case when o_orderkey % 3 = 0 then o_orderkey::varchar end)")
_PLAIN = "trim(regexp_replace(lower(strip_accents(series)), '[^a-z0-9]+', ' ', 'g'))"


@query("collection_rule", f"""
with o as (select *, o_orderkey // 7 as seventh from orders), x as (select o_orderkey, {NAMED.sql} as series, {VOLUME.sql} as volume from o),
 y as (select *, {_PLAIN} as key from x),
 z as (select *, key <> '' and (key in ({', '.join(map(literal, V.KNOWN_COLLECTIONS))}) or regexp_matches(key, {literal('|'.join(V.COLLECTION_PATTERNS))})
   or regexp_matches(key, '^({'|'.join(V.COLLECTION_FIRST_WORDS)})( |$)')) as named from y),
 w as (select *, case when series = '' then 'empty' when contains(series, '(') then 'authority' when named and volume is not null then 'numbered' when named then 'collection' else 'series' end as verdict from z)
select o_orderkey, verdict = 'series' as ok, {exact('verdict', V.SERIES_VERDICTS)} as reason from w""")
def collection_rule(t):
    df = t.orders.withColumn("seventh", F.floor(F.col(KEY) / 7))
    return df.select(KEY, R.series_or_collection(NAMED.spark, VOLUME.spark).alias("v")).select(KEY, "v.ok", "v.reason")


# --- titles ----------------------------------------------------------------------------------------

NAME, SIZE = of("p_name"), of("p_size")
TITLE = one_of("p_partkey", NAME + said(" - Tome ") + SIZE + said(" - Le grand ") + of("p_type"), NAME + said(" ") + SIZE, NAME + said(" T.") + SIZE, NAME + said(", tome ") + SIZE,
               NAME + said(" #") + SIZE, NAME, NAME + said(" vol.") + SIZE)


@query("title_parts", """
select p_partkey, case when p_partkey % 7 = 5 then '' else p_size::varchar end as volume, case when p_partkey % 7 in (5, 6) then '' else p_name end as series,
  case p_partkey % 7 when 0 then 'Le grand ' || p_type when 6 then p_name || ' vol.' || p_size else p_name end as cleaned from part""")
def title_parts(t):
    """Seven ways to write a volume into a title."""
    df = spread(t.part).select("p_partkey", TITLE.spark.alias("t")).withColumn("volume", N.extract_volume(F.lit(""), "t"))
    df = df.withColumn("series", N.extract_series("t", F.lit(""), F.lit(""), "volume"))
    return df.select("p_partkey", "volume", "series", N.clean_title("t", "volume", "series").alias("cleaned"))


STRICT = one_of("p_partkey", NAME + said(", tome ") + SIZE, NAME + said(" ") + SIZE, NAME + said(" - T.") + SIZE, NAME + said(" vol. ") + SIZE,
                NAME + said(" : tome n° ") + SIZE, said("1,2,3... ") + NAME, NAME + said(" volume ") + SIZE + said("b, suite"))


@query("strict_series", """
select p_partkey, case when p_size % 5 = 0 then 'Kept' when p_partkey % 7 not in (1, 5) then p_name end as series,
  case when p_size % 5 <> 0 and p_partkey % 7 not in (1, 5) then p_size::varchar end as volume from part""")
def strict_series(t):
    df = spread(t.part).select("p_partkey", STRICT.spark.alias("t"), F.when(F.col("p_size") % 5 == 0, "Kept").alias("series"), F.lit(None).cast("string").alias("volume"))
    return N.with_strict_series(df, "t", "series", "volume").drop("t")


# --- lists followed in a week ----------------------------------------------------------------------

CALLED = nth([w.title() for w in (*V.YOUTH_LIST_WORDS, *V.PRIZE_LIST_WORDS)] + ["Romans", "Polars", "Voyages", "Rentrée littéraire"] * 6, KEY)
DATED = {"name": CALLED + said(" ") + one_of(KEY, of("year"), said("des libraires"), of("year")), "url": said("https://x/list-") + of(KEY) + one_of("year", said("/rentree-2026"), said("/"), said("/a"))}


@query("followed_lists", f"""
with o as (select o_orderkey, (2020 + o_orderkey // 3 % 8)::int as year from orders),
 x as (select {DATED['name'].sql} as name, {DATED['url'].sql} as url, o_orderkey as number from o),
 y as (select *, list_max([y::int for y in regexp_extract_all(name || ' ' || url, '\\b(20\\d{{2}})\\b', 1)]) as newest,
   case when {holds('lower(name)', V.YOUTH_LIST_WORDS)} then 'youth' when {holds('lower(name)', V.PRIZE_LIST_WORDS)} then 'prize' else 'other' end as family from x),
 k as (select * from y where not coalesce(newest < case when regexp_matches(lower(name || ' ' || url), 'rentree|rentrée') then 2026 else 2024 end, false)),
 r as (select *, row_number() over (partition by family order by coalesce(newest, 2026) desc, number desc, name) as place, count(*) over (partition by family) as n from k),
 q as (select family, n, case family when 'youth' then {V.YOUTH_QUOTA} when 'prize' then {V.PRIZE_QUOTA} end as q from r group by all),
 z as (select family, n, coalesce(q, greatest({V.LISTS_PER_PASS} - (select coalesce(sum(least(q, 2 * n)), 0) from q where family <> 'other'), 0))::bigint as size from q),
 s as (select *, (31 * size) % n as start from z),
 w as (select r.family, (place - 1 + turn * s.n - start)::bigint as slot, name, url from r join s using (family), (values (0), (1)) v(turn)
   where place - 1 + turn * s.n - start >= 0 and place - 1 + turn * s.n - start < size)
select row_number() over (order by case family when 'youth' then 0 when 'prize' then 1 else 2 end, slot) as list_rank, family, slot as place, name, url from w""")
def followed_lists(t):
    """A list per order, named with every word that decides its family, dated or not."""
    df = t.orders.withColumn("year", (2020 + F.floor(F.col(KEY) / 3) % 8).cast("int"))
    return jobs.followed_lists(df.select(DATED["name"].spark.alias("name"), DATED["url"].spark.alias("url")), 2026, 31)

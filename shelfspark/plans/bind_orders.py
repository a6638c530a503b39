"""Fixture bindings of the orders: customers are a collection of series, parts are on offer."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import holdings
from shelfspark.plans import ordering
from shelfspark.plans.registry import query

# --- gaps as ranges --------------------------------------------------------------------------------

RANGES_SQL = """
with v as (select c_nationkey as series, case when c_acctbal >= 0 then floor(c_acctbal / 50)::bigint end as number, c_custkey % 7 as loans from customer),
known as (select series, sum(loans)::bigint as total_loans from v group by 1 having count(distinct number) >= 2),
held as (select distinct series, number from v where number >= 1 union select series, 0 from known),
nexts as (select series, number, lead(number) over (partition by series order by number) as next from held)
select series, number + 1 as low, next - 1 as high, total_loans from nexts join known using (series) where next > number + 1"""


@query("missing_ranges", RANGES_SQL)
def missing_ranges(t):
    """Customers as volumes numbered by balance; those in debt have no number, but loans."""
    rows = t.customer.select(F.col("c_nationkey").alias("series"), F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 50)).alias("volume"),
                             (F.col("c_custkey") % 7).alias("loans"))
    return holdings.missing_ranges(rows, "series", "volume", "loans")


# --- the order -------------------------------------------------------------------------------------

BUDGET = 9000.0
SEGMENTS = {"AUTOMOBILE": "BD", "BUILDING": "Manga", "FURNITURE": "Album", "HOUSEHOLD": "Roman jeunesse"}
LISTS = {"ECONOMY": "Sélection jeunesse", "LARGE": "Romans adultes", "MEDIUM": "Albums pour enfants", "PROMO": "Prix littéraires",
         "SMALL": "Lectures ado", "STANDARD": "Radio"}


def collection(t):
    """A title per customer: series by nation and market segment, volume by balance."""
    number = F.floor(F.col("c_acctbal") / 250)
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("977"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("identifier"),
        F.concat(F.lit("Saga "), "n_name", F.lit(" "), F.initcap("c_mktsegment")).alias("series"),
        F.when(number >= 0, number.cast("string")).alias("volume"), F.col("c_name").alias("title"), F.lit("Éve Martin ; X").alias("author"),
        F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in SEGMENTS.items()]).alias("category"),
        F.when(F.col("c_custkey") % 11 != 0, "Jeunesse").otherwise("Adulte").alias("audience"), (F.col("c_custkey") % 13).alias("loans"))


def offers(t):
    """A part is offered as a volume of a series whose name is more or less that of a held one."""
    segment = F.element_at(F.array(*[F.lit(s) for s in ("Automobile", "Building", "Furniture", "Household", "Machinery")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    lead = F.element_at(F.array(*[F.lit(s) for s in ("Saga ", "La saga : ", "La grande nouvelle saga ", "SÂGA ")]), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.join(t.nation, F.floor(F.col("p_partkey") / 5) % 25 == F.col("n_nationkey")).select(
        F.concat(F.lit("979"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbn"),
        F.concat_ws(" ", F.when(F.col("p_size") % 13 == 0, "Coffret"), "p_name", "p_brand").alias("title"), F.col("p_type").alias("author"), F.col("p_brand").alias("publisher"), F.concat(lead, "n_name", F.lit(" "), segment).alias("series"),
        F.col("p_size").cast("string").alias("volume"), F.when(F.col("p_size") % 17 == 0, "CD audio").otherwise("Poche").alias("support"),
        F.when(F.col("p_size") % 19 != 0, F.round((F.col("p_retailprice") - 840) / 4, 2)).alias("price"))


def suggestions(t):
    """Suppliers suggest parts: half by code, half by a shortened title."""
    given = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey"))
    return given.select(
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("title"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("979"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))).alias("isbn"),
        F.lit(12.5).alias("price"), F.when(F.col("s_suppkey") % 5 < 3, "Album repéré").otherwise("Essai").alias("motive"),
        F.when(F.col("s_suppkey") % 7 == 0, "Kibookin").otherwise("lettre").alias("source"),
        F.when(F.col("s_suppkey") % 4 == 0, "acquise").otherwise("à étudier").alias("status"),
        F.concat(F.lit("2026-01-"), F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0")).alias("added"))


def lists(t):
    name = F.coalesce(*[F.when(F.col("p_type") == k, v) for k, v in LISTS.items()])
    return t.part.select(F.length("p_type").alias("list_rank"), name.alias("name"), F.col("p_partkey").alias("place"),
                         F.concat(F.lit("979"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbn"), "p_size").where("p_size > 40").drop("p_size")


def _plain(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9 ]', '', 'g'))"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(string_split({_plain(c)}, ' '), lambda x: x <> ''))"


def _like(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def _case(c: str, values: dict[str, str]) -> str:
    return "case " + " ".join(f"when {c} = '{k}' then '{v}'" for k, v in values.items()) + " end"


def _cover(c: str) -> str:
    """What of a title, once plain, is left out of orders."""
    return (f"regexp_matches(lower(strip_accents({c})), 'coffret|integrale|presentoir|sabot|calendrier|agenda|puzzle|pack |marque-page|marque page|\\b\\d+\\s*ex\\b')")


TABLES_SQL = f"""
t as (select '977' || lpad(c_custkey::varchar, 10, '0') as identifier, 'Saga ' || n_name || ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as series,
    case when c_acctbal >= 0 then floor(c_acctbal / 250)::bigint end as number, c_name as title, {_case('c_mktsegment', SEGMENTS)} as category,
    c_custkey % 11 <> 0 as young, c_custkey % 13 as loans from customer join nation on c_nationkey = n_nationkey),
o as (select *, {_words('series')} as sw, {_words('title')} as tw, {_plain('series')} as skey from (select '979' || lpad(p_partkey::varchar, 10, '0') as isbn,
    case when p_size % 13 = 0 then 'Coffret ' else '' end || p_name || ' ' || p_brand as title, p_type as author, p_brand as publisher,
    ['Saga ', 'La saga : ', 'La grande nouvelle saga ', 'SÂGA '][p_size % 4 + 1] || n_name || ' ' ||
    ['Automobile', 'Building', 'Furniture', 'Household', 'Machinery'][p_partkey % 5 + 1] as series, p_size::bigint as number, p_size % 17 = 0 as audio,
    case when p_size % 19 <> 0 then round((p_retailprice - 840) / 4, 2) end as price from part join nation on p_partkey // 5 % 25 = n_nationkey)),
scope as (select *, {_plain('series')} as skey from t where young and category is not null),
stock as (select skey, min(series) as series, min(category) as category, sum(loans)::bigint as loans, count(distinct number) as volumes, max(number) as highest
    from scope group by 1),
alike as (select k.skey, s.series as offered from (select *, {_words('series')} as w from stock) k
    join (select distinct series, sw from o) s on {_like('k.w', 's.sw')} >= 0.6),
"""
ORDER_SQL = f"""
with recursive {TABLES_SQL}
os as (select o.* exclude (skey), s.skey, s.series as hseries, s.category, s.loans, s.volumes, s.highest from o join alike a on o.series = a.offered join stock s on s.skey = a.skey),
p1 as (select isbn, 1 as phase, lpad((1000000000000000 - loans)::varchar, 16, '0') || ' ' || skey as first, number as second, '1#' || skey || '#' || number as slot,
    null as chain, 1 as step, category, 'Tome manquant' as origin, 'Série « ' || hseries || ' » (' || loans || ' prêts) : tome ' || number || ' absent du fonds' as motive, price
    from os where volumes >= 2 and number between 1 and highest and not exists (select 1 from scope h where h.skey = os.skey and h.number = os.number)),
sg as (select case when s_suppkey % 3 = 0 then s_name else p_name || ' ' || p_brand || ' ' || p_type end as title,
    case when s_suppkey % 2 = 0 then '979' || lpad(p_partkey::varchar, 10, '0') end as code, case when s_suppkey % 5 < 3 then 'Album repéré' else 'Essai' end as motive,
    '2026-01-' || lpad((s_suppkey % 28 + 1)::varchar, 2, '0') as added
    from supplier join part on s_suppkey = p_partkey where s_suppkey % 4 <> 0 and (s_suppkey % 5 < 3 or s_suppkey % 7 = 0)),
sx as (select *, {_words('title')} as w from sg),
p2 as (select isbn, 2 as phase, translate(added, '0123456789', '9876543210') || '#' || sx.title || '#' || coalesce(code, '') as first,
    case when code is not null then 0 else round((1 - {_like('w', 'tw')}) * 1000000)::bigint end as second, '2#' || added || '#' || sx.title || '#' || coalesce(code, '') as slot,
    null as chain, 1 as step, '(veille)' as category, 'Suggestion veille' as origin, motive, coalesce(price, 12.5) as price
    from sx join o on (code is null or code = isbn) and {_like('w', 'tw')} >= 0.5),
p3 as (select isbn, 3 as phase, lpad(length(p_type)::varchar, 10, '0') as first, p_partkey as second, null as slot, null as chain, 1 as step, '(sélection)' as category,
    'Sélection libraires' as origin, {_case('p_type', LISTS)} as motive, price from part join o on isbn = '979' || lpad(p_partkey::varchar, 10, '0')
    where p_size > 40 and p_type in ('ECONOMY', 'MEDIUM', 'SMALL')),
p4 as (select isbn, 4 as phase, lpad((1000000000000000 - loans)::varchar, 16, '0') || ' ' || skey as first, number as second, '4#' || skey || '#' || number as slot,
    skey as chain, number - highest as step, category, 'Tome suivant' as origin,
    'Suite de « ' || hseries || ' » (' || loans || ' prêts), dernier tome en fonds : ' || highest as motive, price
    from os where volumes >= 3 and loans > 0 and number between highest + 1 and highest + 6),
every as (from p1 union all by name from p2 union all by name from p3 union all by name from p4),
keyed as (select e.*, o.title, o.author, o.publisher, o.series, o.number, o.skey || '#' || o.number as by_volume,
    {_plain('o.title')} || '|' || {_plain("split_part(o.author, ',', 1)")} as by_title, round(e.price * 100)::bigint as cents
    from every e join o using (isbn) where e.price > 0 and e.price <= case when origin like 'Tome%' then 28 else 40 end and not audio and not {_cover('o.title')}
    and not exists (select 1 from scope h where h.skey = o.skey and h.number = o.number)),
c as (select *, row_number() over (order by phase, first, second, isbn) as n from keyed),
walk as (select 0::bigint as n, {int(BUDGET * 100)}::bigint as money, null::bigint as taken, []::varchar[] as owned, []::varchar[] as slots, []::varchar[] as steps
  union all select n, case when fits then money - cents else money end, case when fits then n end,
    case when fits then owned || ['i' || isbn, 'v' || by_volume, 't' || by_title] else owned end,
    case when fits and slot is not null then list_append(slots, slot) else slots end,
    case when fits and chain is not null then list_append(steps, chain || '@' || step) else steps end
  from (select c.*, w.money, w.owned, w.slots, w.steps, c.cents <= w.money and not list_contains(w.owned, 'i' || isbn) and not list_contains(w.owned, 'v' || by_volume)
      and not list_contains(w.owned, 't' || by_title) and (slot is null or not list_contains(w.slots, slot))
      and (chain is null or step = 1 or list_contains(w.steps, chain || '@' || (step - 1))) as fits
    from walk w join c on c.n = w.n + 1 where w.money > {int(BUDGET * 100) - int(round(BUDGET * 100 * 0.995))}))
select isbn, title, author, publisher, series, number::varchar as volume, price, category, origin, phase, motive from walk join c on c.n = walk.taken"""


@query("order_builder", ORDER_SQL)
def order_builder(t):
    """The youth order over all four phases."""
    return ordering.order_builder(collection(t), offers(t), suggestions(t), lists(t), BUDGET)


COMIC_BUDGET = 3000.0
PUBLISHERS = {"Brand#1": "Milan Jeunesse", "Brand#11": "Bayard", "Brand#12": "Kana", "Brand#13": "Marvel France", "Brand#21": "Glénat Jeunesse", "Brand#22": "Dupuis",
              "Brand#31": "Éditions Milan", "Brand#32": "Panini Manga", "Brand#41": "Jungle"}
COMIC_SQL = f"""
with recursive {TABLES_SQL}
made as (select isbn, title, author, case {' '.join(f"when publisher = '{k}' then '{v}'" for k, v in PUBLISHERS.items())} else publisher end as publisher,
    series, number, price, skey, audio from o),
shelf as (select 1 as shelf_rank, 'jeunesse' as name, true as youth, p_partkey as place, '979' || lpad(p_partkey::varchar, 10, '0') as isbn from part where p_type = 'SMALL'
    union all select 2, 'rayon BD', false, p_partkey, '979' || lpad(p_partkey::varchar, 10, '0') from part),
e as (select shelf_rank, name, place, made.* from shelf join made using (isbn)
    where not regexp_matches(lower(strip_accents(publisher)), 'kana|marvel|panini|manga|comics') and not regexp_matches(lower(strip_accents(title)), 'manga|comics|manhwa|webtoon')
    and (youth or regexp_matches(lower(strip_accents(publisher)), 'jungle|glenat jeunesse|bayard|milan|dupuis')) and price > 0 and price <= 30 and not audio and not {_cover('title')}
    and isbn not in (select '979' || lpad(s_suppkey::varchar, 10, '0') from supplier)
    and not exists (select 1 from scope h where h.skey = made.skey and h.number = made.number)),
c as (select *, skey || '#' || number as by_volume, {_plain('title')} || '|' || {_plain('author')} as by_title, round(price * 100)::bigint as cents,
    row_number() over (order by shelf_rank, place, isbn) as n from e),
walk as (select 0::bigint as n, {int(COMIC_BUDGET * 100)}::bigint as money, null::bigint as taken, []::varchar[] as owned
  union all select n, case when fits then money - cents else money end, case when fits then n end,
    case when fits then owned || ['i' || isbn, 'v' || by_volume, 't' || by_title] else owned end
  from (select c.*, w.money, w.owned, c.cents <= w.money and not list_contains(w.owned, 'i' || isbn) and not list_contains(w.owned, 'v' || by_volume)
      and not list_contains(w.owned, 't' || by_title) as fits from walk w join c on c.n = w.n + 1 where w.money > {int(COMIC_BUDGET * 100) - int(round(COMIC_BUDGET * 100 * 0.99))}))
select isbn, title, author, publisher, series, number::varchar as volume, price, 'BD' as category, 'BD nouveauté' as origin, 'Nouveautés BD jeunesse (' || name || ')' as motive
from walk join c on c.n = walk.taken"""


@query("comic_supplement", COMIC_SQL)
def comic_supplement(t):
    """Two shelves: one of comics for the young, and the general one, where that is tested."""
    named = F.coalesce(*[F.when(F.col("publisher") == k, v) for k, v in PUBLISHERS.items()], F.col("publisher"))
    code = F.concat(F.lit("979"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbn")
    def shelf(rank, name, youth):
        return F.lit(rank).alias("shelf_rank"), F.lit(name).alias("name"), F.lit(youth).alias("youth"), F.col("p_partkey").alias("place"), code
    shelves = t.part.where(F.col("p_type") == "SMALL").select(*shelf(1, "jeunesse", True)).unionByName(t.part.select(*shelf(2, "rayon BD", False)))
    ordered = t.supplier.select(F.concat(F.lit("979"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")).alias("isbn"))
    return ordering.comic_supplement(collection(t), offers(t).withColumn("publisher", named), shelves, ordered, COMIC_BUDGET)

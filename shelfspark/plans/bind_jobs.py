"""Fixture bindings of whole jobs: one query per output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import filters, footfall
from shelfspark.plans import jobs
from shelfspark.plans.bind_holdings import E_SQL, OPEN, counters
from shelfspark.plans.registry import query
from shelfspark.session import scratch

# --- counters ------------------------------------------------------------------------------------


@query("footfall_import", f"""
with {E_SQL}, h as (select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:00') as hour, sum(n)::bigint as all_entries,
  sum(case when {OPEN} then n end)::bigint as open_entries from e where n > 0 group by 1, 2)
select day, hour, all_entries, open_entries from h
union all select day, 'all', sum(all_entries)::bigint, sum(open_entries)::bigint from h group by day""")
def footfall_import(t):
    """Two exports, the second of which covers the first again; both series as stored."""
    hourly, daily = scratch(t.spark, "hourly"), scratch(t.spark, "daily")
    rows = counters(t).withColumnRenamed("n", "entries")
    jobs.footfall_import(t.spark, rows.where("event_id % 2 = 0"), hourly, daily)
    jobs.footfall_import(t.spark, rows, hourly, daily)
    columns = ["day", "hour", "all_entries", "open_entries"]
    return t.spark.read.parquet(hourly).select(columns).unionByName(
        t.spark.read.parquet(daily).withColumn("hour", F.lit("all")).select(columns))


# --- stock-take -----------------------------------------------------------------------------------

STOCK = """
k as (select 'B' || p_partkey as code, case when p_size % 7 = 0 then null else substr(p_name, 1, 1) || ' ' || p_brand end as mark from part where p_size % 11 <> 0),
stock as (select code, case when mark is null or not regexp_matches(mark, '^[A-Za-z]') then '(sans cote)' else upper(regexp_extract(mark, '^([A-Za-z]+)', 1)) end as zone from k),
scans as (select distinct 'B' || l_partkey as code from lineitem where l_suppkey % 20 = 3)"""


def stocktake_tables(t):
    mark = F.when(F.col("p_size") % 7 != 0, F.concat(F.substring("p_name", 1, 1), F.lit(" "), F.col("p_brand")))
    code = F.concat(F.lit("B"), F.col("p_partkey").cast("string"))
    copies = t.part.select(F.when(F.col("p_size") % 11 != 0, code).alias("barcode"), mark.alias("shelfmark"))
    scans = t.lineitem.where(F.col("l_suppkey") % 20 == 3).select(F.concat(F.lit("B"), F.col("l_partkey").cast("string")).alias("code"))
    return jobs.stocktake_report(copies, scans)


@query("stocktake_report_missing", f"""
with {STOCK} select code, zone from stock where code not in (select code from scans)
  and zone in (select zone from stock where code in (select code from scans))""")
def stocktake_report_missing(t):
    return stocktake_tables(t)["missing"].select("code", "zone")


@query("stocktake_report_scanned", f"with {STOCK} select code, zone from stock where code in (select code from scans)")
def stocktake_report_scanned(t):
    return stocktake_tables(t)["scanned"].select("code", "zone")


@query("stocktake_report_unknown", f"with {STOCK} select code from scans where code not in (select code from stock)")
def stocktake_report_unknown(t):
    return stocktake_tables(t)["unknown"]


@query("stocktake_report_progress", f"""
with {STOCK} select zone, count(*) as expected, count(scans.code) as seen, count(*) - count(scans.code) as missing,
  round(100.0 * count(scans.code) / count(*), 1)::double as percent from stock left join scans using (code) group by 1 having count(scans.code) > 0""")
def stocktake_report_progress(t):
    return stocktake_tables(t)["progress"]


# --- withdrawal -----------------------------------------------------------------------------------

WEEDED = """
t as (select p_partkey, p_size, case when p_type = 'PROMO' then 'DVD' else 'LIVRE' end as kind,
   case p_size % 9 when 0 then 'Documentaire' when 1 then 'BD' when 2 then 'Album' when 3 then 'Fonds local' when 4 then null when 5 then 'Roman jeunesse'
     when 6 then 'Roman ado / YA' when 7 then 'Première lecture' else 'Manga' end as category,
   case when p_size % 3 = 0 then lpad(((p_partkey * 13) % 1000)::varchar, 3, '0') || '.5' end as dewey,
   case when p_size % 2 = 0 then 'Adulte' else 'Jeunesse' end as audience, case when p_size % 10 <> 0 then 1985 + p_size % 40 end as published from part),
c as (select 'A' || l_orderkey || '-' || l_linenumber as barcode, t.*, case when l_returnflag <> 'N' then l_quantity::bigint end as loans,
   case when l_returnflag <> 'N' then year(l_shipdate) + 21 end as ly from lineitem join t on p_partkey = l_partkey),
b as (select *, count(*) over (partition by p_partkey) as copies, 2026 - ly as idle, 2026 - published as age, coalesce(loans, 0) = 0 and ly is null as never,
   coalesce(category, '') = 'Documentaire' or (dewey is not null and coalesce(category, '') not in ('BD', 'Manga', 'Album')) as doc,
   coalesce(category, '') in ('BD', 'Manga') as comic, coalesce(category, '') in ('Roman jeunesse', 'Album', 'Première lecture', 'Roman ado / YA') as youth,
   substr(dewey, 1, 3)::int as d from c where kind = 'LIVRE' and coalesce(category, '') <> 'Fonds local'),
r as (select *, case when d between 340 and 349 then 3 when d < 100 or d between 320 and 329 then 5 when d >= 700 and d not between 910 and 919 then 15 else 10 end as ra,
   case when d between 340 and 349 then 1 when d < 100 or d between 320 and 329 then 2 when d >= 700 and d not between 910 and 919 then 5 else 3 end as ri from b),
x as (select *, case when doc and dewey is not null and age >= ra and (never or coalesce(idle >= ri, false)) then 'Documentaires'
   when comic and never and age >= 10 then 'BD-manga jamais prêtées' when comic and idle >= 10 then 'BD-manga sans prêt 10 ans'
   when not comic and youth and idle >= 5 then 'Jeunesse sans prêt 5 ans'
   when not comic and not youth and audience = 'Adulte' and not doc and idle >= 5 then 'Romans adultes sans prêt 5 ans' end as class from r)"""


@query("weeding_lists", f"""
with {WEEDED} select barcode, class from x where class is not null
union all select barcode, 'Doublons dormants' from x where copies >= 3 and idle >= 3""")
def weeding_lists(t):
    """Titles of all kinds, categories and audiences; copies never lent have no loan figures at all."""
    size, text = F.col("p_size"), lambda c: F.col(c).cast("string")      # noqa: E731
    categories = ("Documentaire", "BD", "Album", "Fonds local", None, "Roman jeunesse", "Roman ado / YA", "Première lecture", "Manga")
    category = F.get(F.array(*[F.lit(c) for c in categories]), size % 9)
    titles = t.part.select(
        text("p_partkey").alias("identifier"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("publisher"),
        F.when(size % 10 != 0, (1985 + size % 40).cast("string")).alias("published"),
        F.when(size % 3 == 0, F.concat(F.lpad(((F.col("p_partkey") * 13) % 1000).cast("string"), 3, "0"), F.lit(".5"))).alias("dewey"),
        category.alias("category"), F.when(size % 2 == 0, "Adulte").otherwise("Jeunesse").alias("audience"),
        F.when(F.col("p_type") == "PROMO", "DVD").otherwise("LIVRE").alias("kind"))
    lent = F.col("l_returnflag") != "N"
    copies = t.lineitem.select(
        F.concat(F.lit("A"), text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("barcode"), text("l_partkey").alias("identifier"),
        F.lit("Adulte").alias("audience"), F.when(lent, F.col("l_quantity").cast("bigint")).alias("loans"),
        F.when(lent, F.year("l_shipdate") + 21).alias("last_loan_year"))
    return jobs.weeding_lists(titles, copies, 2026).select("barcode", "class")


# --- audit ----------------------------------------------------------------------------------------

def audited(t):
    size = F.col("p_size")
    titles = t.part.select(
        F.when(size % 6 == 0, F.concat(F.lit("CB:A"), F.col("p_partkey"))).otherwise(F.concat(F.lit("978"), F.col("p_partkey"))).alias("identifier"),
        F.when(size % 4 == 0, "DVD").otherwise("LIVRE").alias("kind"), F.when(size % 3 != 0, F.col("p_type")).alias("category"),
        F.when(size % 5 != 0, F.col("p_brand")).alias("genre"), F.when(size % 2 == 0, "Adulte").otherwise("Jeunesse").alias("audience"),
        F.when(size % 7 == 0, F.col("p_name")).alias("series"), F.col("p_type").alias("publisher"),
        F.when(size % 8 == 0, F.concat(F.lit("Jean "), F.col("p_name"))).alias("author"))
    copies = t.part.select(F.concat(F.lit("978"), F.col("p_partkey")).alias("identifier"), F.lit("Adulte").alias("audience"),
                           F.when(size % 16 != 4, F.lit("BD 12")).alias("shelfmark"))
    days = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("all_entries"))
    days = days.withColumn("open_entries", F.col("all_entries"))
    hours = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("10:00").alias("hour")).agg(
        F.sum(F.when(F.col("o_orderkey") % 97 != 0, 1).otherwise(2)).alias("all_entries"))
    return jobs.quality_audit(titles, copies, days, hours.withColumn("open_entries", F.col("all_entries")))


@query("quality_audit_rows", """
select 'titles' as "table", count(*) as rows, 8 as columns, 0 as empty from part
union all select 'copies', count(*), 3, 0 from part""")
def quality_audit_rows(t):
    return audited(t)["row_counts"]


@query("quality_audit_scorecard", """
select 'books without category' as label, count(*) filter (p_size % 4 <> 0 and p_size % 3 = 0) as n from part
union all select 'without series', count(*) filter (p_size % 7 <> 0) from part
union all select 'without EAN', count(*) filter (p_size % 6 = 0) from part""")
def quality_audit_scorecard(t):
    return audited(t)["scorecard"]


@query("quality_audit_values", """
select 'category' as "column", p_type as value, count(*) as n from part where p_size % 3 <> 0 group by 2
union all select 'genre', p_brand, count(*) from part where p_size % 5 <> 0 group by 2
union all select 'audience', case when p_size % 2 = 0 then 'Adulte' else 'Jeunesse' end, count(*) from part group by 2""")
def quality_audit_values(t):
    return audited(t)["values"]


@query("quality_audit_fill", """
with c as (select count(*) as all_rows, count(*) filter (p_size % 3 <> 0) as category, count(*) filter (p_size % 5 <> 0) as genre,
  count(*) filter (p_size % 7 = 0) as series, count(*) filter (p_size % 8 = 0) as author from part),
 f as (select unnest(['identifier', 'kind', 'category', 'genre', 'audience', 'series', 'publisher', 'author']) as "column",
  unnest([all_rows, all_rows, category, genre, all_rows, series, all_rows, author]) as filled, all_rows from c)
select "column", filled, round(100.0 * filled / all_rows, 1)::double as percent,
  case when filled = 0 then 'empty' when round(100.0 * filled / all_rows, 1) < 5 then 'rare' else '' end as flag from f""")
def quality_audit_fill(t):
    return audited(t)["fill_rate"]


@query("quality_audit_days", """
with d as (select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1)
select substr(day, 1, 4) as year, count(*) as days, sum(n)::bigint as entries, min(day) as first_day, max(day) as last_day,
  0::bigint as no_entries, sum((n > 3000)::int)::bigint as too_many, sum((isodow(day::date) = 7)::int)::bigint as sundays from d group by 1""")
def quality_audit_days(t):
    return audited(t)["days"]


@query("quality_audit_films", """
select '978' || p_partkey as identifier, 'cote_absente' as anomaly from part where p_size % 4 = 0 and p_size % 6 <> 0 and p_size % 16 = 4
union all select '978' || p_partkey, 'cote_non_conforme' from part where p_size % 4 = 0 and p_size % 6 <> 0 and p_size % 16 <> 4""")
def quality_audit_films(t):
    return audited(t)["films"].select("identifier", "anomaly")


# --- counter profile, look-ups, segments --------------------------------------------------------------

def issues(t, name):
    rows = counters(t).select(F.date_trunc("minute", "ts").alias("ts"), "n")
    return footfall.counter_issues(rows, "ts", "n")[name]


MINUTES = "e as (select date_trunc('minute', ts) as ts, round(value * 100)::bigint as n from events)"


@query("counter_duplicates", f"with {MINUTES} select ts, count(*) as readings from e group by 1 having count(*) > 1")
def counter_duplicates(t):
    return issues(t, "duplicates")


@query("counter_top_days", f"""
with {MINUTES} select strftime(ts, '%Y-%m-%d') as day, sum(n)::bigint as entries from e where n > 0 group by 1 order by entries desc, day limit 5""")
def counter_top_days(t):
    return issues(t, "top_days")


@query("counter_off_hours", f"""
with {MINUTES} select strftime(ts, '%H:00') as hour, sum(n)::bigint as entries, count(*) as readings from e where n > 0 and not {OPEN} group by 1""")
def counter_off_hours(t):
    return issues(t, "off_hours")


@query("title_answers", """
with k as (select p_partkey, p_name, p_size % 3 = 0 or p_name like 'blue%' as bare from part),
 a as (select unnest(['Blue Anvil', 'RÉD', 'zzz']) as term, unnest(['blue anvil', 'red', 'zzz']) as folded)
select term, case when count(p_partkey) = 0 then 'absent' when bool_or(not bare) then 'found' else 'found without EAN' end as state, count(p_partkey) as rows
from a left join k on contains(lower(p_name), folded) group by term""")
def title_answers(t):
    bare = (F.col("p_size") % 3 == 0) | F.col("p_name").startswith("blue")
    df = t.part.withColumn("code", F.when(bare, F.concat(F.lit("CB:"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")))
    df = df.withColumn("none", F.lit(None).cast("string"))
    first, *others = [filters.title_answer(df, term, "p_name", "none", "code") for term in ("Blue Anvil", "RÉD", "zzz")]
    for other in others:
        first = first.unionByName(other)
    return first


@query("all_segments", """
with k as (select p_partkey, case p_size % 4 when 0 then 'BD' when 1 then 'Manga' when 2 then 'BD' else 'Album' end as category,
  case p_size % 3 when 0 then 'bdj 1' when 1 then 'COM 2' else 'R RG' end as mark, case when p_size % 2 = 0 then 'Adulte' else 'Jeunesse' end as audience, p_size from part)
select p_partkey, 'bd_jeunesse' as segment from k where category = 'BD' and p_size % 3 = 0
union all select p_partkey, 'bd_adulte' from k where category = 'BD' and p_size % 3 <> 0
union all select p_partkey, 'comics' from k where category = 'BD' and p_size % 3 = 1
union all select p_partkey, 'roman_graphique' from k where category = 'BD' and p_size % 3 = 2
union all select p_partkey, 'manga_jeunesse' from k where category = 'Manga' and audience = 'Jeunesse'
union all select p_partkey, 'manga_adulte' from k where category = 'Manga' and audience = 'Adulte'""")
def all_segments(t):
    size = F.col("p_size")
    df = t.part.select(
        "p_partkey", F.get(F.array(*[F.lit(c) for c in ("BD", "Manga", "BD", "Album")]), size % 4).alias("category"),
        F.get(F.array(*[F.lit(c) for c in ("bdj 1", "COM 2", "R RG")]), size % 3).alias("mark"), F.when(size % 2 == 0, "Adulte").otherwise("Jeunesse").alias("audience"))
    names = F.array_compact(F.array(*[F.when(test, name) for name, test in filters.segments("category", "mark", "audience").items()]))
    return df.select("p_partkey", F.explode(names).alias("segment"))


@query("guarded_rows", """
select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 500""")
def guarded_rows(t):
    """The rows that a guarded statement with an order shows."""
    t.orders.createOrReplaceTempView("shelfspark_orders")
    return filters.guarded_query(t.spark, "select o_orderkey from shelfspark_orders order by o_totalprice desc, o_orderkey")[0]

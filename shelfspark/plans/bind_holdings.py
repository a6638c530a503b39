"""Fixture bindings: holdings, series, loans, audits, footfall.

The tables stand in for a collection: lineitem rows are volumes of a series
(the order), copies of a title, loans; orders and parts are titles; events are
counter rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions.text import filled
from shelfspark.operators import audit, filters, footfall, holdings
from shelfspark.plans.registry import query

def qty():
    return F.col("l_quantity").cast("bigint").alias("loans")


def volumes(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", qty())


@query("series_gaps", """
select l_orderkey, count(distinct l_linenumber) as volumes_held, max(l_linenumber)::bigint as highest,
       sum(l_quantity)::bigint as total_loans
from lineitem group by l_orderkey
having count(distinct l_linenumber) < max(l_linenumber) and max(l_linenumber) > 1 and sum(l_quantity) >= 5""")
def series_gaps(t):
    return holdings.series_gaps(volumes(t), "l_orderkey", "l_linenumber", "loans")


@query("series_gaps_top", """
select l_orderkey, count(distinct l_linenumber) as volumes_held, max(l_linenumber)::bigint as highest,
       sum(l_quantity)::bigint as total_loans
from lineitem group by l_orderkey
having count(distinct l_linenumber) < max(l_linenumber) and max(l_linenumber) > 1 and sum(l_quantity) >= 5
order by total_loans desc, l_orderkey limit 25""")
def series_gaps_top(t):
    return holdings.series_gaps(volumes(t), "l_orderkey", "l_linenumber", "loans", k=25)


@query("listed_volumes", """
with g as (
  select l_orderkey, count(distinct l_linenumber) as volumes_held, max(l_linenumber)::bigint as highest,
         sum(l_quantity)::bigint as total_loans
  from lineitem group by l_orderkey
  having count(distinct l_linenumber) < max(l_linenumber) and max(l_linenumber) > 1 and sum(l_quantity) >= 5)
select g.*, 0::bigint as part, v.volumes from g join (
  select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as volumes
  from (select distinct l_orderkey, l_linenumber from lineitem) group by l_orderkey) v using (l_orderkey)""")
def listed_volumes(t):
    return holdings.listed_volumes(volumes(t), "l_orderkey", "l_linenumber", "loans")


@query("series_gap_volumes", """
with g as (
  select l_orderkey from lineitem group by l_orderkey
  having count(distinct l_linenumber) < max(l_linenumber) and max(l_linenumber) > 1 and sum(l_quantity) >= 5)
select distinct l_orderkey, l_linenumber::varchar as volume from lineitem where l_orderkey in (select l_orderkey from g)""")
def series_gap_volumes(t):
    return holdings.series_gap_volumes(volumes(t), "l_orderkey", "l_linenumber", "loans")


@query("series_gaps_simple", """
select l_orderkey, count(*) as records, max(l_linenumber)::bigint as highest,
       (max(l_linenumber) - count(*))::bigint as gap
from lineitem group by l_orderkey having max(l_linenumber) > count(*) order by gap desc, l_orderkey limit 5""")
def series_gaps_simple(t):
    return holdings.series_gaps_simple(t.lineitem.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("missing_volumes", """
with held as (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by 1, 2),
     known as (select l_orderkey, count(*) as n, max(l_linenumber) as hi, sum(q)::bigint as total_loans
               from held group by 1 having count(*) >= 2),
     wanted as (select l_orderkey, total_loans, unnest(range(1, hi + 1))::bigint as missing from known)
select w.l_orderkey, w.missing, w.total_loans from wanted w
where not exists (select 1 from held h where h.l_orderkey = w.l_orderkey and h.l_linenumber = w.missing)""")
def missing_volumes(t):
    return holdings.missing_volumes(volumes(t), "l_orderkey", "l_linenumber", "loans")


@query("next_volumes", """
with held as (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by 1, 2),
     known as (select l_orderkey, max(l_linenumber)::bigint as highest, sum(q)::bigint as total_loans
               from held where l_linenumber <= 3 group by 1 having count(*) >= 2 and sum(q) > 0),
     steps as (select *, unnest(range(1, 7)) as step from known),
     offers as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'N'),
     found as (select s.*, o.l_orderkey is not null as ok from steps s
               left join offers o on o.l_orderkey = s.l_orderkey and o.l_linenumber = s.highest + s.step),
     gap as (select l_orderkey, coalesce(min(case when not ok then step end), 7) as g from found group by 1)
select f.l_orderkey, f.highest, (f.highest + f.step)::bigint as next_volume, f.total_loans
from found f join gap using (l_orderkey) where f.step < gap.g""")
def next_volumes(t):
    """The first three lines of an order are held; returned-as-new lines are on offer."""
    held = volumes(t).where(F.col("l_linenumber") <= 3)
    offers = t.lineitem.where(F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber")
    return holdings.next_volumes(held, offers, "l_orderkey", "l_linenumber", "loans", min_held=2)


@query("gap_diagnosis", """
with held as (select l_orderkey, l_linenumber, sum(case when l_linestatus = 'O' then 1 else 0 end) as s
              from lineitem group by 1, 2),
     g as (select l_orderkey, (max(l_linenumber) - count(*))::bigint as gaps, sum(s)::bigint as suspects
           from held group by 1 having max(l_linenumber) > count(*))
select *, case when suspects >= gaps then 'badly catalogued' when suspects > 0 then 'check'
          else 'truly absent' end as verdict from g""")
def gap_diagnosis(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_linestatus")
    return holdings.gap_diagnosis(df, "l_orderkey", "l_linenumber", F.col("l_linestatus") == "O")


@query("top_creators", """
select l_suppkey, count(distinct l_partkey) as titles, sum(l_quantity)::bigint as total_loans,
       round(sum(l_quantity) / count(distinct l_partkey), 1) as loans_per_title
from lineitem where l_quantity > 0 group by l_suppkey having sum(l_quantity) >= 15
order by total_loans desc, l_suppkey limit 25""")
def top_creators(t):
    return holdings.top_creators(t.lineitem.select("l_suppkey", "l_partkey", qty()), "l_suppkey", "l_partkey", "loans")


@query("single_copy_hot", """
select o_orderkey, o_orderpriority, copies, total_loans from orders join (
  select l_orderkey, count(*) as copies, sum(l_quantity)::bigint as total_loans from lineitem
  group by 1 having count(*) = 1 and sum(l_quantity) >= 12) on l_orderkey = o_orderkey""")
def single_copy_hot(t):
    titles = t.orders.select("o_orderkey", "o_orderpriority")
    copies = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), qty())
    return holdings.single_copy_hot(titles, copies, "o_orderkey", "loans", k=None)


def _part_loans(t):
    loans = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").cast("bigint").alias("loans"))
    return t.part.join(loans, "p_partkey", "left").withColumn("loans", F.coalesce("loans", F.lit(0)))


PART_LOANS = """pl as (select part.*, coalesce(q, 0)::bigint as loans from part left join (
  select l_partkey, sum(l_quantity) as q from lineitem group by 1) on l_partkey = p_partkey)"""


@query("rotation_brand_type", f"""
with {PART_LOANS}
select p_brand, p_type, count(distinct p_partkey) as titles, sum(loans)::bigint as total_loans,
       round(sum(loans)::double / count(distinct p_partkey), 1) as rotation
from pl where loans > 0 group by 1, 2 having count(distinct p_partkey) >= 3
order by rotation desc, p_brand, p_type limit 30""")
def rotation_brand_type(t):
    return holdings.rotation(_part_loans(t), ["p_brand", "p_type"], "p_partkey", "loans", 3, only_lent=True, k=30)


@query("rotation_segment", """
select c_mktsegment, count(distinct c_custkey) as titles, sum(n)::bigint as total_loans,
       round(sum(n)::double / count(distinct c_custkey), 1) as rotation
from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey
group by 1""")
def rotation_segment(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("loans"))
    df = t.customer.select("c_custkey", "c_mktsegment").join(n, "c_custkey")
    return holdings.rotation(df, ["c_mktsegment"], "c_custkey", "loans")


@query("rotation_rows", f"""
with {PART_LOANS}
select p_type, count(*) as titles, sum(loans)::bigint as total_loans,
       round(sum(loans)::double / count(*), 1) as rotation from pl group by 1""")
def rotation_rows(t):
    return holdings.rotation(_part_loans(t), ["p_type"], "p_partkey", "loans", by_rows=True)


@query("recent_low_use", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as published, o_totalprice from orders
where year(o_orderdate) >= 2000 and o_totalprice < 100000
order by published desc, o_totalprice, o_orderkey limit 30""")
def recent_low_use(t):
    df = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"), "o_totalprice")
    return holdings.recent_low_use(df, "published", "o_totalprice", 2000, 100000, "o_orderkey")


@query("never_lent", """
select o_orderkey from orders left join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1)
  on l_orderkey = o_orderkey where coalesce(q, 0) = 0""")
def never_lent(t):
    loans = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("loans"))
    df = t.orders.select("o_orderkey").join(loans, "o_orderkey", "left").fillna(0, ["loans"])
    return holdings.never_lent(df, "loans").select("o_orderkey")


@query("loans_below", f"with {PART_LOANS} select p_partkey, loans from pl where loans < 500")
def loans_below(t):
    return holdings.loans_below(_part_loans(t), "loans", 500).select("p_partkey", "loans")


@query("age_profile", """
with x as (select case when y >= '2023' then '2023-2026 (recent)' when y >= '2020' then '2020-2022'
  when y >= '2015' then '2015-2019' when y >= '2010' then '2010-2014' when y >= '2000' then '2000-2009'
  else 'avant 2000' end as period, o_orderkey from (select strftime(o_orderdate, '%Y') as y, o_orderkey from orders))
select period, count(*) as titles, sum(n)::bigint as total_loans, round(sum(n)::double / count(*), 1) as rotation
from x join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey group by 1""")
def age_profile(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("loans"))
    return holdings.age_profile(t.orders.select("o_orderkey", "o_orderdate").join(n, "o_orderkey"),
                                "o_orderdate", "loans")


@query("smallest_classes", f"""
with {PART_LOANS}
select substr(p_brand, 7, 1) || '00' as class, count(*) as titles, sum(loans)::bigint as total_loans
from pl group by 1 order by titles, class limit 10""")
def smallest_classes(t):
    df = _part_loans(t).withColumn("dewey", F.substring("p_brand", 7, 2))
    return holdings.smallest_classes(df, "dewey", "loans")


@query("top_series", """
select p_type, sum(p_size)::bigint as total_loans from part join lineitem on l_partkey = p_partkey
group by 1 order by total_loans desc, p_type limit 5""")
def top_series(t):
    view = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).join(
        t.part.select("p_partkey", "p_type", "p_size"), "p_partkey")
    return holdings.top_series(view, "p_type", "p_size")


@query("availability", """
select l_partkey, count(*) as copies, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as on_loan,
       (count(*) - sum(case when l_linestatus = 'O' then 1 else 0 end))::bigint as lendable
from lineitem group by 1""")
def availability(t):
    return holdings.availability(t.lineitem.select("l_partkey", "l_linestatus"), ["l_partkey"],
                                 F.col("l_linestatus") == "O")


@query("loan_delta", """
with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, sum(round(value * 100)::bigint)::bigint as total_loans
           from events group by 1, 2)
select *, (total_loans - lag(total_loans) over (partition by user_id order by day))::bigint as delta from d""")
def loan_delta(t):
    df = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                         F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return holdings.loan_delta(df, "user_id", "day", "v")


@query("holdings_report", """
select count(*) as total, sum((o_orderstatus = 'F')::int)::bigint as finished,
       sum((o_orderpriority = '5-LOW')::int)::bigint as low,
       sum((o_totalprice > 250000)::int)::bigint as dear, sum((year(o_orderdate) >= 2000)::int)::bigint as recent
from orders""")
def holdings_report(t):
    return holdings.holdings_report(t.orders, {
        "finished": F.col("o_orderstatus") == "F", "low": F.col("o_orderpriority") == "5-LOW",
        "dear": F.col("o_totalprice") > 250000, "recent": F.year("o_orderdate") >= 2000})


@query("basket_recap", """
select case when grouping(p_brand) = 0 then 'origin' when grouping(p_type) = 0 then 'category' else 'total' end as level,
       coalesce(p_brand, p_type, 'all') as value, count(*) as items,
       sum(round(p_retailprice * 100)::bigint)::bigint as amount
from part group by grouping sets ((p_brand), (p_type), ())""")
def basket_recap(t):
    df = t.part.select("p_brand", "p_type", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"))
    return holdings.basket_recap(df, "p_brand", "p_type", "cents")


@query("cap_per_group", """
select p_partkey, p_brand, p_retailprice from (
  select *, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r from part) where r <= 3""")
def cap_per_group(t):
    df = t.part.select("p_partkey", "p_brand", "p_retailprice")
    return holdings.cap_per_group(df, "p_brand", ["p_retailprice", "p_partkey"], 3)


# --- audits -----------------------------------------------------------------------------------

@query("fill_rate", """
with s as (select count(*) as n, count(o_orderkey) as a, sum((trim(o_orderstatus) <> '')::int) as b,
           sum((trim(o_orderpriority) <> '')::int) as c, sum((nullif(o_orderstatus, 'P') is not null)::int) as d,
           sum((o_totalprice < 1500)::int) as e from orders),
     l as (select 'o_orderkey' as "column", a::bigint as filled, n from s
           union all select 'o_orderstatus', b, n from s union all select 'o_orderpriority', c, n from s
           union all select 'not_pending', d, n from s union all select 'cheap', e, n from s)
select "column", filled::bigint as filled, round(100.0 * filled / n, 1)::double as percent,
       case when filled = 0 then 'empty' when round(100.0 * filled / n, 1) < 5 then 'rare' else '' end as flag from l""")
def fill_rate(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority",
                         F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("not_pending"),
                         F.when(F.col("o_totalprice") < 1500, F.col("o_totalprice")).alias("cheap"))
    return audit.fill_rate(df)


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@query("row_counts", " union all ".join(
    f"""select '{n}' as "table", count(*) as "rows", {c} as columns, (count(*) = 0)::int as empty from {n}"""
    for n, c in zip(TABLES, (2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4))))
def row_counts(t):
    return audit.row_counts({n: getattr(t, n) for n in TABLES})


@query("value_inventory", """
select 'o_orderstatus' as "column", o_orderstatus as value, count(*) as n from orders group by 2
union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2""")
def value_inventory(t):
    return audit.value_inventory(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("scorecard", """
select 'urgent' as label, sum((o_orderpriority = '1-URGENT')::int)::bigint as n from orders
union all select 'pending', sum((o_orderstatus = 'P')::int)::bigint from orders
union all select 'before 1997', sum((o_orderdate < timestamp '1997-01-01')::int)::bigint from orders""")
def scorecard(t):
    return audit.scorecard(t.orders, {
        "urgent": F.col("o_orderpriority") == "1-URGENT", "pending": F.col("o_orderstatus") == "P",
        "before 1997": F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")})


@query("counts_by_type", "select event_type, count(*) as n from events group by 1")
def counts_by_type(t):
    return audit.counts(t.events, ["event_type"])


@query("shelfmark_prefix", """
select substr(p_name, 1, 4) as prefix, count(*) as n from part where p_type = 'ECONOMY' group by 1""")
def shelfmark_prefix(t):
    df = t.part.where(F.col("p_type") == "ECONOMY").select(F.substring("p_name", 1, 4).alias("prefix"))
    return audit.counts(df, ["prefix"])


@query("duplicates", """
select lower(trim(p_name)) as title, p_brand as author, count(*) as n, min(p_partkey) as first_key
from part group by 1, 2 having count(*) > 1""")
def duplicates(t):
    return audit.duplicates(t.part, "p_name", "p_brand", "p_partkey")


@query("duplicate_members", """
select first_key, p_partkey as key from (
  select p_partkey, min(p_partkey) over w as first_key, count(*) over w as n from part
  window w as (partition by lower(trim(p_name)), p_brand)) where n > 1""")
def duplicate_members(t):
    return audit.duplicate_members(t.part, "p_name", "p_brand", "p_partkey")


SPELLED = """sp as (select p_partkey, p_brand, case when p_size % 7 = 0 then upper(p_name) when p_size % 7 = 1
  then p_name || '.' else p_name end as form from part)"""


def _spelled(t):
    form = (F.when(F.col("p_size") % 7 == 0, F.upper("p_name"))
            .when(F.col("p_size") % 7 == 1, F.concat("p_name", F.lit("."))).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", "p_brand", form.alias("form"))


@query("spelling_variants", f"""
with {SPELLED}, f as (select distinct form, trim(regexp_replace(lower(form), '[^a-z0-9]+', ' ', 'g')) as series_key from sp)
select series_key, count(*) as spellings, min(form) as first_form, max(form) as last_form
from f group by 1 having count(*) > 1""")
def spelling_variants(t):
    return audit.spelling_variants(_spelled(t), "form")


@query("majority_form", f"""
with {SPELLED}, c as (select trim(lower(form), ' .') as form_key, form, count(*) as n from sp group by 1, 2),
  r as (select *, row_number() over (partition by form_key order by n desc, form) as r,
        sum(n) over (partition by form_key) as group_rows, count(*) over (partition by form_key) as group_values from c)
select form_key, form, group_rows::bigint as group_rows, group_values from r where r = 1""")
def majority_form(t):
    df = _spelled(t)
    half = F.col("p_partkey") % 2 == 0
    return audit.majority_form(df.where(half), df.where(~half), "form")


@query("apply_majority", f"""
with {SPELLED}, c as (select trim(lower(form), ' .') as form_key, form, count(*) as n from sp group by 1, 2),
  r as (select *, row_number() over (partition by form_key order by n desc, form) as r from c)
select p_partkey, p_brand, r.form from sp join r on trim(lower(sp.form), ' .') = r.form_key and r.r = 1""")
def apply_majority(t):
    df = _spelled(t)
    return audit.apply_majority(df, audit.majority_form(df, df.limit(0), "form"), "form")


@query("harmonise", """
with c as (select p_name, p_type, count(*) as n from part group by 1, 2),
  m as (select p_name, p_type as modal from (
        select *, row_number() over (partition by p_name order by n desc, p_type) as r from c) where r = 1)
select p_partkey, p_name, modal as p_type, p_type <> modal as changed from part join m using (p_name)""")
def harmonise(t):
    return audit.harmonise_by_group(t.part.select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


@query("usage_report", """
select strftime(ts, '%Y-%m-%d') as day, count(*) as requests,
       round(100.0 * sum((event_type = 'error')::int) / count(*), 1)::double as error_pct,
       round(100.0 * sum((event_type = 'view')::int) / count(*), 1)::double as export_pct,
       round(100.0 * sum((event_type = 'purchase')::int) / count(*), 1)::double as edit_pct,
       sum((event_type = 'click')::int)::bigint as searches
from events group by 1""")
def usage_report(t):
    kind = F.col("event_type")
    return audit.usage_report(t.events, "ts", kind == "error", kind == "view", kind == "purchase",
                              F.when(kind == "click", 1).otherwise(0))


@query("last_errors", """
select event_id, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 10""")
def last_errors(t):
    return audit.last_errors(t.events, "ts", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("filtered_columns", r"""
with w as (select unnest(regexp_extract_all(text, '(?i)\b(?:where|and|or)\s+([A-Za-z_][A-Za-z_0-9.]*)', 1)) as name
           from conversations)
select lower(name) as name, count(*) as n from w group by 1 order by n desc, name limit 15""")
def filtered_columns(t):
    return audit.filtered_columns(t.conversations, "text")


@query("mapping_preview", """
select p_type as old, case p_type when 'ECONOMY' then 'BASIC' when 'SMALL' then 'COMPACT' else p_type end as new,
       count(*) as n from part where p_type in ('ECONOMY', 'SMALL') group by 1, 2""")
def mapping_preview(t):
    new = (F.when(F.col("p_type") == "ECONOMY", "BASIC").when(F.col("p_type") == "SMALL", "COMPACT")
           .otherwise(F.col("p_type")))
    return audit.changes_preview(t.part, "p_type", new)


@query("deduced_fields", """
with m as (select case p_size % 4 when 0 then 'serie,tome' when 1 then 'genre' when 2 then 'serie, genre' end as marks
           from part)
select trim(f) as field, count(*) as n from (select unnest(string_split(marks, ',')) as f from m) group by 1""")
def deduced_fields(t):
    k = F.col("p_size") % 4
    marks = F.when(k == 0, "serie,tome").when(k == 1, "genre").when(k == 2, "serie, genre")
    return audit.deduced_fields(t.part.select(marks.alias("marks")), "marks")


@query("import_report", """
with r as (select case when l_linenumber = 7 then null else l_partkey::varchar end as raw,
                  case when l_linenumber = 7 or l_partkey % 10 = 3 then null else l_partkey end as code from lineitem),
  c as (select code, count(*) as n from r where code is not null group by 1),
  h as (select c.*, p_partkey is not null as held from c left join (select p_partkey from part where p_size <= 40) on p_partkey = code)
select reason, sum(rows)::bigint as rows from (
  select case when raw is null then 'no_identifier' else 'invalid_identifier' end as reason, 1 as rows from r where code is null
  union all select case when held then 'updated' else 'out_of_scope' end, 1 from h
  union all select 'duplicate_in_file', n - 1 from h where n > 1) group by 1""")
def import_report(t):
    none = F.col("l_linenumber") == 7
    rows = t.lineitem.select(
        F.when(~none, F.col("l_partkey").cast("string")).alias("raw"),
        F.when(~none & (F.col("l_partkey") % 10 != 3), F.col("l_partkey")).alias("code"), "l_orderkey")
    return audit.import_report(rows, "raw", "code", "l_orderkey", t.part.where(F.col("p_size") <= 40), "p_partkey")


@query("suggestions_by_source", """
select source, sum((lang = 'en' and n_chars < 1000)::int)::bigint as to_purge,
       sum((not (lang = 'en' and n_chars < 1000))::int)::bigint as kept from documents group by 1""")
def suggestions_by_source(t):
    return audit.suggestions_by_source(t.documents, "source", F.col("lang") == "en", F.col("n_chars") < 1000)


@query("multi_award", """
with n as (select trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as title_key, p_brand from part)
select title_key, count(*) as entries, count(distinct p_brand) as prizes, min(p_brand) as first_prize,
       max(p_brand) as last_prize from n group by 1 having count(*) > 1""")
def multi_award(t):
    return audit.multi_award(t.part, "p_name", "p_brand")


@query("source_health", """
with s as (select source, count(*) as answers, max((n_chars > 12000)::int) as has_series,
                  max((lang = 'de')::int) as has_volume from documents group by 1)
select source, answers, has_series, has_volume, case when source in ('src0', 'src1', 'src2') and has_series = 0
       then 'degraded' else 'ok' end as state from s""")
def source_health(t):
    docs = t.documents.select("source", F.lit("t").alias("title"),
                              F.when(F.col("n_chars") > 12000, "x").alias("series"),
                              F.when(F.col("lang") == "de", "1").alias("volume"))
    return audit.source_health(docs.select("source"), docs, "source", "title", "series", "volume",
                               ("src0", "src1", "src2"))


@query("without_copy", "select o_orderkey, o_orderpriority from orders where o_orderkey not in (select l_orderkey from lineitem)")
def without_copy(t):
    return audit.without_copy(t.orders.select("o_orderkey", "o_orderpriority"),
                              t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("copies_without", """
select event_id, 'props' as missing from events where json_extract(props, '$.k')::int > 90
union all select event_id, 'value' from events where value < 2""")
def copies_without(t):
    k = F.get_json_object("props", "$.k").cast("int")
    df = t.events.select("event_id", F.when(k <= 90, F.col("props")).alias("props"),
                         F.when(F.col("value") >= 2, F.col("value")).alias("value"))
    return audit.copies_without(df, ["props", "value"]).select("event_id", "missing")


# --- filters, orders, sets -----------------------------------------------------------------------

@query("inventory_view", """
select p_partkey as id, p_name as title, l_orderkey as barcode, l_linestatus as status
from part left join (select * from lineitem where l_quantity > 45) on l_partkey = p_partkey""")
def inventory_view(t):
    copies = t.lineitem.where(F.col("l_quantity") > 45).select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linestatus")
    return filters.inventory_view(t.part, copies, "p_partkey", {
        "p_partkey": "id", "p_name": "title", "l_orderkey": "barcode", "l_linestatus": "status"})


@query("keyword_filter", """
select p_partkey from part where contains(lower(concat_ws(' ', p_name, p_brand)), 'ring') and p_type in ('ECONOMY', 'SMALL')""")
def keyword_filter(t):
    return filters.keyword_filter(t.part, ["p_name", "p_brand"], "RING", {"p_type": ["ECONOMY", "SMALL"]}).select("p_partkey")


@query("title_lookup", r"""
select doc_id, case when doc_id % 3 = 0 then 'found without EAN' else 'found' end as state from documents
where contains(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), 'eau que')""")
def title_lookup(t):
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CB:"), "doc_id")).otherwise(F.col("doc_id").cast("string"))
    df = t.documents.withColumn("code", key).withColumn("none", F.lit(None).cast("string"))
    return filters.title_lookup(df, "Eàu QUE", "text", "none", "code").select("doc_id", "state")


@query("pending_enrichment", """
select p_partkey from part where p_size % 5 <> 0 and (p_size > 30 or (p_type = 'ECONOMY' and p_brand = 'Brand#1'))""")
def pending_enrichment(t):
    df = t.part.select(
        "p_partkey", F.when(F.col("p_size") % 5 == 0, "CB:1").otherwise("97").alias("code"),
        F.when(F.col("p_size") <= 30, "2026").alias("enriched"),
        F.when(F.col("p_type") == "ECONOMY", "LIVRE").otherwise("CD").alias("kind"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_name")).alias("series"))
    return filters.pending_enrichment(df, "code", "enriched", "kind", "series").select("p_partkey")


@query("to_qualify", """
select p_partkey, 'no category' as reason from part where p_brand = 'Brand#2'
union all select p_partkey, 'no genre' from part where p_brand <> 'Brand#2' and p_type = 'SMALL'""")
def to_qualify(t):
    df = t.part.select("p_partkey", F.lit("LIVRE").alias("kind"),
                       F.when(F.col("p_brand") != "Brand#2", F.col("p_brand")).alias("category"),
                       F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("genre"))
    return filters.to_qualify(df, "kind", "category", "genre").select("p_partkey", "reason")


@query("recent_items", "select o_orderkey from orders where o_orderdate >= timestamp '2001-03-28'")
def recent_items(t):
    return filters.recent_items(t.orders, "o_orderdate", "2001-07-30").select("o_orderkey")


@query("new_since", "select o_orderkey from orders where o_orderdate >= timestamp '2001-07-22'")
def new_since(t):
    return filters.new_since(t.orders, "o_orderdate", "2001-07-30").select("o_orderkey")


@query("missing_ean", """
select o_orderkey from orders where o_orderkey % 4 = 0 and o_orderstatus = 'F' and year(o_orderdate) >= 2000""")
def missing_ean(t):
    df = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "CB:1").otherwise("97").alias("code"),
        F.when(F.col("o_orderstatus") == "F", "LIVRE").otherwise("REVUE").alias("kind"), "o_orderdate")
    return audit.missing_ean(df, "code", "kind", "o_orderdate").select("o_orderkey")


@query("purge", "select o_orderkey, o_orderstatus from orders where not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')")
def purge(t):
    doomed = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return filters.purge(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), doomed).select(
        "o_orderkey", "o_orderstatus")


@query("union_exclusions", """
select p_partkey as code from part where p_size > 45 union select l_partkey from lineitem where l_quantity > 49
union select l_partkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F'""")
def union_exclusions(t):
    li = t.lineitem.withColumnRenamed("l_partkey", "code")
    return filters.union_exclusions(
        "code", t.part.where(F.col("p_size") > 45).withColumnRenamed("p_partkey", "code"),
        li.where(F.col("l_quantity") > 49), li.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")))


@query("except_keys", """
select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def except_keys(t):
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.except_keys(t.orders.select("o_orderkey"), ["o_orderkey"], returned)


@query("boolean_first", """
select o_orderkey, o_orderpriority, row_number() over (order by (o_orderpriority = '1-URGENT') desc, o_orderdate desc, o_orderkey) as place from orders""")
def boolean_first(t):
    order = filters.boolean_first(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate").desc(), "o_orderkey")
    return filters.placed(t.orders, order).select("o_orderkey", "o_orderpriority", "place")


@query("shelf_order", """
select p_partkey, row_number() over (order by case when p_size = 1 then 'zzz' else p_brand end, p_name, p_partkey) as place from part""")
def shelf_order(t):
    df = t.part.withColumn("cote", F.when(F.col("p_size") != 1, F.col("p_brand")))
    return filters.placed(df, filters.by_shelf("cote", "p_name", "p_partkey")).select("p_partkey", "place")


@query("page", "select o_orderkey from orders order by o_orderkey limit 300 offset 600")
def page(t):
    return filters.page(t.orders.select("o_orderkey"), 300, 600, "o_orderkey")


@query("segments", """
select p_partkey, case when p_size % 2 = 0 then 'bd_jeunesse' else 'bd_adulte' end as segment from part where p_type = 'ECONOMY'""")
def segments(t):
    df = t.part.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "BD").alias("category"),
                       F.when(F.col("p_size") % 2 == 0, "BDJ 1").otherwise("R 2").alias("mark"),
                       F.lit("Adulte").alias("audience"))
    tests = filters.segments("category", "mark", "audience")
    name = F.when(tests["bd_jeunesse"], "bd_jeunesse").when(tests["bd_adulte"], "bd_adulte")
    return df.withColumn("segment", name).where(F.col("segment").isNotNull()).select("p_partkey", "segment")


@query("guarded_query", """
select sum(n)::bigint as total, sum(n) > 500 as cut from (select count(*) as n from orders where o_totalprice > 100000)""")
def guarded_query(t):
    t.orders.createOrReplaceTempView("shelfspark_orders")
    return filters.guarded_query(t.spark, "select o_orderkey from shelfspark_orders where o_totalprice > 100000;")[1]


# --- footfall ----------------------------------------------------------------------------------------

OPEN = """((month(ts) in (7, 8) and isodow(ts) <= 6 and strftime(ts, '%H:%M') >= '10:00' and strftime(ts, '%H:%M') < '19:00')
  or (month(ts) not in (7, 8) and isodow(ts) between 2 and 6 and strftime(ts, '%H:%M') >= '10:00' and strftime(ts, '%H:%M') < '18:00'))"""
E_SQL = "e as (select event_id, ts, round(value * 100)::bigint as n from events)"


def counters(t):
    return t.events.select("event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("n"))


@query("footfall_hourly", f"""
with {E_SQL} select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:00') as hour, sum(n)::bigint as all_entries,
  sum(case when {OPEN} then n end)::bigint as open_entries from e where n > 0 group by 1, 2""")
def footfall_hourly(t):
    return footfall.hourly(counters(t), "ts", "n")


@query("footfall_daily", f"""
with {E_SQL} select strftime(ts, '%Y-%m-%d') as day, sum(n)::bigint as all_entries,
  sum(case when {OPEN} then n end)::bigint as open_entries from e where n > 0 group by 1""")
def footfall_daily(t):
    return footfall.daily(counters(t), "ts", "n")


@query("footfall_open", f"""
with {E_SQL} select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:00') as hour, sum(n)::bigint as open_entries
from e where n > 0 and {OPEN} group by 1, 2""")
def footfall_open(t):
    return footfall.open_series(footfall.hourly(counters(t), "ts", "n"))


@query("footfall_reconcile", f"""
with {E_SQL}, d as (select strftime(ts, '%Y-%m-%d') as day, sum(n)::bigint as daily from e where n > 0 and day(ts) <> 3 group by 1),
  h as (select strftime(ts, '%Y-%m-%d') as day, sum(n)::bigint as hourly from e where n > 0 and day(ts) <> 5
        and not (day(ts) = 7 and hour(ts) = 12) group by 1)
select coalesce(d.day, h.day) as day, daily, hourly, case when hourly is null then 'daily only'
  when daily is null then 'hourly only' else 'totals differ' end as problem
from d full join h on d.day = h.day where daily is distinct from hourly""")
def footfall_reconcile(t):
    c = counters(t)
    d = footfall.daily(c.where(F.dayofmonth("ts") != 3), "ts", "n")
    h = footfall.hourly(c.where((F.dayofmonth("ts") != 5) & ~((F.dayofmonth("ts") == 7) & (F.hour("ts") == 12))), "ts", "n")
    return footfall.day_reconciliation(d, h)


@query("open_hours_join", f"""
with {E_SQL} select event_id, (isodow(ts) - 1)::int as weekday, '10:00' as opens,
  case when month(ts) in (7, 8) then '19:00' else '18:00' end as closes,
  {OPEN} as open_public from e
where strftime(ts, '%H:%M') >= '10:00' and ({OPEN} or (month(ts) not in (7, 8) and isodow(ts) = 1 and strftime(ts, '%H:%M') < '18:00'))""")
def open_hours_join(t):
    return footfall.open_hours_join(counters(t), "ts", footfall.opening_rules(t.spark)).select(
        "event_id", "weekday", "opens", "closes", "open_public")


@query("busiest_slot", f"""
with {E_SQL}, h as (select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:00') as hour, sum(n)::bigint as entries
                    from e where n > 0 group by 1, 2)
select day, hour, entries from (select *, row_number() over (partition by day order by entries desc, hour) as r from h) where r = 1""")
def busiest_slot(t):
    return footfall.busiest_slot(footfall.hourly(counters(t), "ts", "n"))


@query("busiest_weekday_slot", f"""
with {E_SQL}, h as (select (isodow(ts) - 1)::int as weekday, strftime(ts, '%H:00') as hour, sum(n)::bigint as entries
                    from e where n > 0 group by 1, 2)
select weekday, hour, entries from (select *, row_number() over (partition by weekday order by entries desc, hour) as r from h) where r = 1""")
def busiest_weekday_slot(t):
    return footfall.busiest_slot(footfall.hourly(counters(t), "ts", "n"), by="weekday")


@query("yoy_by_weekday", """
select weekofyear(o_orderdate)::int as week, (isodow(o_orderdate) - 1)::int as weekday,
       (count(*) filter (isoyear(o_orderdate) = 1996))::bigint as first_total,
       (count(*) filter (isoyear(o_orderdate) = 1997))::bigint as second_total
from orders where isoyear(o_orderdate) in (1996, 1997) group by 1, 2
having count(*) filter (isoyear(o_orderdate) = 1996) > 0 and count(*) filter (isoyear(o_orderdate) = 1997) > 0""")
def yoy_by_weekday(t):
    return footfall.yoy_by_weekday(t.orders.select("o_orderdate", F.lit(1).alias("n")), "o_orderdate", "n", 1996, 1997)


@query("footfall_profile", """
with d as (select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1)
select substr(day, 1, 4) as year, count(*) as days, sum(n)::bigint as entries, min(day) as first_day, max(day) as last_day,
  0::bigint as no_entries, sum((n > 10)::int)::bigint as too_many,
  sum((isodow(day::date) = 7)::int)::bigint as sundays from d group by 1""")
def footfall_profile(t):
    d = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("all_entries"))
    return footfall.footfall_profile(d, ceiling=10)


@query("date_formats", """
select case when o_orderkey % 3 = 0 then 'dd/mm/yyyy' when o_orderkey % 3 = 1 then 'yyyy-mm-dd' else 'other' end as format,
       count(*) as n from orders group by 1""")
def date_formats(t):
    k = F.col("o_orderkey") % 3
    text = (F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy")))
    return footfall.date_formats(t.orders.select(text.alias("d")), "d")

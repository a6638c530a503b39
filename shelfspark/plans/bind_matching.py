"""Fixture bindings: presence and absence, merging, choosing, stock-take, weeding."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import keyed, matching, merging, selection, stocktake, suggestions, weeding
from shelfspark.plans.registry import query

FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


# --- presence and absence ---------------------------------------------------------------------

@query("absent_by_id", """
select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
  and c_custkey not in (select user_id from events)""")
def absent_by_id(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return matching.absent_by_id(t.customer.select("c_custkey"), "c_custkey", (urgent, "o_custkey"), (t.events, "user_id"))


@query("absent_by_title", f"""
with h as (select distinct {FOLD.format('text')} as f from documents)
select conv_id, turn from conversations where {FOLD.format('text')} <> '' and {FOLD.format('text')} not in (select f from h)""")
def absent_by_title(t):
    return matching.absent_by_title(t.conversations, "text", t.documents, "text").select("conv_id", "turn")


@query("present_by_title", f"""
with h as (select distinct {FOLD.format('text')} as f from documents where lang = 'en')
select doc_id, lang from documents where {FOLD.format('text')} <> '' and {FOLD.format('text')} in (select f from h)""")
def present_by_title(t):
    return matching.present_by_title(t.documents, "text", t.documents.where(F.col("lang") == "en"), "text").select("doc_id", "lang")


@query("already_owned", """
with h as (select * from lineitem where l_returnflag = 'R'),
 hv as (select distinct l_orderkey, l_linenumber from h), hp as (select distinct l_partkey from h where l_quantity > 40),
 hs as (select distinct l_suppkey from h where l_quantity = 50 and l_discount = 0.1)
select l.l_orderkey, l.l_linenumber, l.l_partkey, hv.l_orderkey is not null as by_volume, hp.l_partkey is not null as by_part,
  hs.l_suppkey is not null as by_supplier,
  hv.l_orderkey is not null or hp.l_partkey is not null or hs.l_suppkey is not null as owned
from lineitem l left join hv on hv.l_orderkey = l.l_orderkey and hv.l_linenumber = l.l_linenumber
left join hp on hp.l_partkey = l.l_partkey left join hs on hs.l_suppkey = l.l_suppkey where l.l_returnflag = 'N'""")
def already_owned(t):
    held = t.lineitem.where(F.col("l_returnflag") == "R")
    mine = t.lineitem.where(F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    volume = F.concat_ws("#", "l_orderkey", "l_linenumber")
    keys = {"by_volume": (volume, volume),
            "by_part": (F.col("l_partkey"), F.when(F.col("l_quantity") > 40, F.col("l_partkey"))),
            "by_supplier": (F.col("l_suppkey"), F.when((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1), F.col("l_suppkey")))}
    return matching.already_owned(mine, held, keys).drop("l_suppkey")


@query("fill_from_child", """
select o_orderkey, coalesce(case when o_orderstatus <> 'P' then o_orderstatus end,
  (select min(l_linestatus) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A'), 'Tout public') as status from orders""")
def fill_from_child(t):
    parent = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    child = t.lineitem.where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("o_orderkey"),
                                                                  F.col("l_linestatus").alias("status"))
    return matching.fill_from_child(parent, child, "o_orderkey", "status", "Tout public")


@query("order_reconciliation", """
select o_orderkey, round(o_totalprice / 1000)::bigint as ordered, coalesce(q, 0)::bigint as delivered,
       (round(o_totalprice / 1000) - coalesce(q, 0))::bigint as gap
from orders left join (select l_orderkey, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey""")
def order_reconciliation(t):
    ordered = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 1000).cast("bigint").alias("q"))
    delivered = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("bigint").alias("d"))
    return matching.order_reconciliation(ordered, delivered, "o_orderkey", "q", "d")


@query("dictionary_lookup", "select c_custkey, n_name as label from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
def dictionary_lookup(t):
    table = t.nation.where(F.col("n_regionkey") < 3)
    return matching.dictionary_lookup(t.customer, "c_nationkey", table, "n_nationkey", "n_name").select("c_custkey", "label")


@query("update_by_mapping", """
select s_suppkey, coalesce(r_name, n_name) as place, r_name is not null as changed from supplier
join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey and r_regionkey <> 2""")
def update_by_mapping(t):
    df = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.col("n_name").alias("place"))
    mapping = t.nation.join(t.region.where(F.col("r_regionkey") != 2), F.col("r_regionkey") == F.col("n_regionkey"))
    return matching.update_by_mapping(df, "place", mapping, "n_name", "r_name")


@query("carry_over_status", """
select n.o_orderkey, coalesce(o.o_orderstatus, 'à traiter') as status from (select * from orders where o_orderdate >= timestamp '1997-01-01') n
left join (select * from orders where o_orderdate < timestamp '1999-01-01') o using (o_orderkey)""")
def carry_over_status(t):
    cut = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    new = t.orders.where(F.col("o_orderdate") >= cut(1997)).select("o_orderkey")
    old = t.orders.where(F.col("o_orderdate") < cut(1999)).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return merging.carry_over_status(new, old, "o_orderkey", "status", "à traiter")


@query("attach_proposal", """
select p_partkey, f.proposed, f.confidence from part left join (
  select l_partkey, min(l_orderkey) as proposed, case when max(l_quantity) > 49 then 'élevée' else 'faible' end as confidence
  from lineitem where l_returnflag = 'A' and l_discount = 0.1 group by 1) f on l_partkey = p_partkey""")
def attach_proposal(t):
    found = (t.lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_discount") == 0.1))
             .groupBy(F.col("l_partkey").alias("p_partkey"))
             .agg(F.min("l_orderkey").alias("proposed"), F.when(F.max("l_quantity") > 49, "élevée").otherwise("faible").alias("confidence")))
    return matching.attach_proposal(t.part.select("p_partkey"), found, "p_partkey")


@query("regretted_withdrawals", """
with w as (select l_partkey::varchar as code, lower(p_name) as title, l_shipdate as d from lineitem join part on p_partkey = l_partkey
           where l_returnflag = 'R' and l_quantity = 50),
 c as (select code, min(d) as d from w group by 1), x as (select title, min(d) as d from w group by 1),
 r as (select o_orderkey, o_custkey::varchar as code, lower(p_name) as title, o_orderdate from orders join part on p_partkey = o_custkey),
 j as (select r.*, case when c.d is null then x.d when x.d is null then c.d else least(c.d, x.d) end as first
       from r left join c using (code) left join x using (title))
select o_orderkey, strftime(first, '%Y-%m-%d') as first_withdrawn from j where o_orderdate > first""")
def regretted_withdrawals(t):
    names = t.part.select("p_partkey", F.col("p_name").alias("title"))
    gone = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)).select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").alias("gone_on")).join(names, "p_partkey")
    asked = t.orders.select("o_orderkey", F.col("o_custkey").alias("p_partkey"), "o_orderdate").join(names, "p_partkey")
    out = matching.regretted_withdrawals(gone, asked, "p_partkey", "title", "gone_on", "o_orderdate")
    return out.select("o_orderkey", F.date_format("first_withdrawn", "yyyy-MM-dd").alias("first_withdrawn"))


# --- similarity -------------------------------------------------------------------------------------

def fuzzy_sql(pattern, score, threshold):
    return f"""
with w as (select doc_id, source, list_filter(list_distinct(string_split(regexp_replace(lower(strip_accents(text)), {pattern}, 'g'), ' ')), lambda w: w <> '') as w from documents),
 u as (select doc_id, source < 'src15' as is_left, len(w) as n, unnest(w) as word from w),
 c as (select a.doc_id as left_id, b.doc_id as right_id, a.n as na, b.n as nb, count(*) as k from u a join u b on a.word = b.word
       where a.is_left and not b.is_left group by all),
 s as (select left_id, right_id, {score} as score from c),
 r as (select *, row_number() over (partition by left_id order by score desc, right_id) as r from s where score >= {threshold})
select left_id, right_id, round(score, 6)::double as score from r where r = 1"""


def two_sources(t):
    docs = t.documents.select("doc_id", "text", "source")
    return docs.where(F.col("source") < "src15"), docs.where(F.col("source") >= "src15")


@query("fuzzy_match_jaccard", fuzzy_sql("'[^a-z0-9 ]', ''", "k / (na + nb - k)", 0.6))
def fuzzy_match_jaccard(t):
    left, right = two_sources(t)
    out = matching.fuzzy_title_match(left, "doc_id", "text", right, "doc_id", "text", 0.6, "jaccard")
    return out.withColumn("score", F.round("score", 6))


@query("fuzzy_match_overlap", fuzzy_sql("'[^a-z0-9]+', ' '", "k / greatest(na, nb)", 0.5))
def fuzzy_match_overlap(t):
    left, right = two_sources(t)
    out = matching.fuzzy_title_match(left, "doc_id", "text", right, "doc_id", "text", 0.5, "overlap")
    return out.withColumn("score", F.round("score", 6))


@query("similar_items", """
with w as (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as word from part),
 probe as (select min(p_partkey) as p_partkey from part group by p_brand),
 o as (select a.p_partkey as probe, b.p_partkey as "similar", count(*) as common from w a join probe using (p_partkey)
       join w b on a.word = b.word and a.p_partkey <> b.p_partkey
       where b.p_partkey in (select p_partkey from part where p_size > 5) group by 1, 2)
select probe, "similar", common, place::int as place from (
  select *, row_number() over (partition by probe order by common desc, "similar") as place from o) where place <= 10""")
def similar_items(t):
    items = t.part.select("p_partkey", "p_name", "p_size", "p_brand")
    probes = items.groupBy("p_brand").agg(F.min("p_partkey").alias("probe_key"))
    return matching.similar_items(items, "p_partkey", F.split("p_name", " "), probes, "probe_key", 10, F.col("p_size") > 5)


# --- first, last, merge, fuse ---------------------------------------------------------------------------

@query("first_per_key", """
select l_partkey, l_orderkey, strftime(l_shipdate, '%Y-%m-%d') as shipped, ignored from (
  select *, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) as r,
    count(*) over (partition by l_partkey) - 1 as ignored from lineitem) where r = 1""")
def first_per_key(t):
    df = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    out = keyed.first_with_ignored(df, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    return out.select("l_partkey", "l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), "ignored")


@query("latest_status", """
select user_id, event_type as status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_status(t):
    return suggestions.latest_status(t.events, "user_id", "event_type", "ts", "event_id").select("user_id", "status")


@query("last_per_key", """
select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def last_per_key(t):
    return keyed.last_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
                              ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("latest_copy", """
select l_partkey, l_orderkey from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey) as r
  from (select l_partkey, l_shipdate, min(l_orderkey) as l_orderkey from lineitem group by 1, 2)) where r = 1""")
def latest_copy(t):
    return selection.latest_copy(t.lineitem.select("l_partkey", "l_orderkey", "l_shipdate"), "l_partkey", "l_shipdate",
                                 "l_orderkey").drop("l_shipdate")


@query("first_origin", """
select l_partkey, l_suppkey as list from (select *, row_number() over (partition by l_partkey order by l_suppkey, l_orderkey) as r from lineitem) where r = 1""")
def first_origin(t):
    df = t.lineitem.select("l_partkey", F.col("l_suppkey").alias("list"), "l_orderkey")
    return selection.first_origin(df, "l_partkey", "list", "l_orderkey").drop("l_orderkey")


@query("longest_label", """
select p_brand, p_name as label from (select *, row_number() over (partition by p_brand order by length(p_name) desc, p_name desc) as r from part) where r = 1""")
def longest_label(t):
    return selection.longest_label(t.part, "p_brand", "p_name")


@query("exact_rank", """
select o_orderkey, row_number() over (partition by o_orderstatus order by o_orderdate, o_orderkey) as rank from orders""")
def exact_rank(t):
    return keyed.exact_rank(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"],
                            ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rank")


@query("coalesce_merge", """
with o as (select c_custkey, case when c_nationkey > 4 then c_name end as c_name, case when c_acctbal > 0 then c_mktsegment end as seg,
                  case when c_nationkey < 20 then c_nationkey end as nat from customer where c_custkey % 3 <> 0),
 n as (select c_custkey, case when c_nationkey < 15 then upper(c_name) end as c_name, lower(c_mktsegment) as seg, c_nationkey + 100 as nat
       from customer where c_custkey % 3 <> 1)
select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(o.seg, n.seg) as seg,
  case when o.c_custkey is not null then o.nat else n.nat end as nat,
  case when o.c_custkey is null then 'inserted' when n.c_custkey is null then 'kept' else 'updated' end as merge_action
from o full join n on o.c_custkey = n.c_custkey""")
def coalesce_merge(t):
    c, nation = t.customer, F.col("c_nationkey")
    old = c.where(F.col("c_custkey") % 3 != 0).select(
        "c_custkey", F.when(nation > 4, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("seg"), F.when(nation < 20, nation).alias("nat"))
    new = c.where(F.col("c_custkey") % 3 != 1).select(
        "c_custkey", F.when(nation < 15, F.upper("c_name")).alias("c_name"), F.lower("c_mktsegment").alias("seg"),
        (nation + 100).alias("nat"))
    return merging.coalesce_merge(old, new, "c_custkey", ["c_name"], ["seg"], ["nat"])


@query("upserted", """
with s as (select o_orderkey, 'new' as status, 1.5::double as price from orders where o_orderkey % 4 = 0
           union all select o_orderkey + 10000000, 'ins', 2.5 from orders where o_orderkey % 7 = 0)
select coalesce(o.o_orderkey, s.o_orderkey) as o_orderkey, coalesce(s.status, o.o_orderstatus) as status,
  case when o.o_orderkey is not null then o.o_totalprice else s.price end as price
from orders o full join s on s.o_orderkey = o.o_orderkey""")
def upserted(t):
    from shelfspark.sinks.exports import upserted as merge
    target = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    key = F.col("o_orderkey")
    source = t.orders.where(key % 4 == 0).select(key, F.lit("new").alias("status"), F.lit(1.5).alias("price")).unionByName(
        t.orders.where(key % 7 == 0).select((key + 10000000).alias("o_orderkey"), F.lit("ins").alias("status"), F.lit(2.5).alias("price")))
    return merge(target, source, "o_orderkey", ["status"])


CANDS = """l as (select l_orderkey as id, l_linenumber as prio, min(l_partkey) as p from lineitem group by 1, 2),
 c as (select id, prio, 's' || prio as source, case when p_size % 9 > 0 then p_name || case when p_size % 4 = 0 then '!' else '' end end as title,
   case when p_size > 20 then p_brand end as author, case when p_size % 3 = 0 then p_type end as publisher,
   case when p_size % 2 = 0 then p_size::varchar end as year from l join part on p_partkey = p)"""


def candidates(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("prio")).agg(
        F.min("l_partkey").alias("p_partkey"))
    size = F.col("p_size")
    title = F.when(size % 9 > 0, F.concat("p_name", F.when(size % 4 == 0, "!").otherwise("")))
    return lines.join(t.part, "p_partkey").select(
        "id", "prio", F.concat(F.lit("s"), F.col("prio").cast("string")).alias("source"), title.alias("title"),
        F.when(size > 20, F.col("p_brand")).alias("author"), F.when(size % 3 == 0, F.col("p_type")).alias("publisher"),
        F.when(size % 2 == 0, size.cast("string")).alias("year"))


@query("title_vote", f"""
with {CANDS}, k as (select *, trim(regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g')) as k, -length(title) * 0.01 as q from c where title is not null),
 f as (select id, k, title, q, count(*) as n, min(prio) as p from k group by all),
 g as (select id, k, sum(n)::bigint as votes, min(p) as first, arg_max(title, (q, -p, title)) as best, max(q) as bq from f group by 1, 2)
select id, best as title, votes from (select *, row_number() over (partition by id order by votes desc, bq desc, first) as r from g) where r = 1""")
def title_vote(t):
    return merging.title_vote(candidates(t), "id", "title", "prio")


FIELDS = ("title", "author", "publisher", "year")


@query("fuse_records", f"""
with {CANDS}, o as (select *, row_number() over (partition by id order by
   (title is not null)::int + (author is not null)::int + (publisher is not null)::int + (year is not null)::int desc, prio) as r from c),
 f as (select id, arg_min(title, r) filter (title is not null) as title, arg_min(author, r) filter (author is not null) as author,
   arg_min(publisher, r) filter (publisher is not null) as publisher, arg_min(year, r) filter (year is not null) as year,
   arg_min(source, r) as lead, [arg_min(source, r) filter (author is not null), arg_min(source, r) filter (publisher is not null),
   arg_min(source, r) filter (year is not null)] as helpers from o group by id)
select id, title, author, publisher, year, case when n = 0 then lead else lead || ' +' || n end as sources from (
  select *, len(list_filter(list_distinct(helpers), lambda h: h <> lead)) as n from f)""")
def fuse_records(t):
    return merging.fuse_records(candidates(t), "id", "prio", "source", FIELDS, FIELDS[1:])


@query("early_stop", f"""
with {CANDS}, k as (select *, trim(regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g')) as k from c where title is not null),
 two as (select id, min(prio) as agree from (select *, row_number() over (partition by id, k order by prio) as r from k) where r = 2 group by 1),
 late as (select id, prio as late from (select *, row_number() over (partition by id order by prio) as r from k) where r = 4),
 f as (select id, min(prio) filter (author is not null) as a, min(prio) filter (year is not null) as y,
   min(prio) filter (publisher is not null) as o from k group by 1),
 s as (select id, case when agree is not null and a is not null and y is not null and coalesce(least(o, late), o, late) is not null
   then greatest(agree, a, y, coalesce(least(o, late), o, late)) end as stop from f left join two using (id) left join late using (id))
select id, prio, source from k join s using (id) where stop is null or prio <= stop""")
def early_stop(t):
    out = merging.early_stop_prefix(candidates(t), "id", "title", "prio", ["author", "year"], optional="publisher")
    return out.select("id", "prio", "source")


@query("second_source", """
select c_custkey, coalesce(name, case when use then c_name end) as name, coalesce(seg, case when use then c_mktsegment end) as seg,
  coalesce(nat, case when use then c_nationkey::varchar end) as nat from (
 select *, case when c_custkey % 2 = 0 then 'n' end as name, case when c_custkey % 3 = 0 then 's' end as seg,
   case when c_custkey % 5 = 0 then '1' end as nat,
   (c_custkey % 2 <> 0)::int + (c_custkey % 3 <> 0)::int + (c_custkey % 5 <> 0)::int >= 2 as use from customer)""")
def second_source(t):
    k = F.col("c_custkey")
    first = t.customer.select(k, F.when(k % 2 == 0, "n").alias("name"), F.when(k % 3 == 0, "s").alias("seg"), F.when(k % 5 == 0, "1").alias("nat"))
    second = t.customer.select(k, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("nat"))
    return merging.fill_missing_from_second(first, second, "c_custkey", ["name", "seg", "nat"], ["name", "seg", "nat"])


# --- choosing ---------------------------------------------------------------------------------------------

@query("rotating_quota", """
with f as (select s_suppkey, s_nationkey, case when s_nationkey < 8 then 'youth' when s_nationkey < 12 then 'prize' else 'other' end as family from supplier),
 r as (select *, row_number() over (partition by family order by s_acctbal desc, s_suppkey desc) as place, count(*) over (partition by family) as n
       from f join supplier using (s_suppkey)),
 q as (select family, n, case family when 'youth' then 7 when 'prize' then 4 end as q from r group by all),
 z as (select family, n, coalesce(q, greatest(14 - (select sum(least(q, 2 * n)) from q where family <> 'other'), 0))::bigint as size from q),
 s as (select *, (31 * size) % n as start from z)
select s_suppkey, r.family, (place - 1 + turn * s.n - start)::bigint as slot from r join s using (family), (values (0), (1)) v(turn)
where place - 1 + turn * s.n - start >= 0 and place - 1 + turn * s.n - start < size""")
def rotating_quota(t):
    nation = F.col("s_nationkey")
    df = t.supplier.select("s_suppkey", "s_acctbal", F.when(nation < 8, "youth").when(nation < 12, "prize").otherwise("other").alias("family"))
    out = selection.rotating_quota(df, "family", [F.col("s_acctbal").desc(), F.col("s_suppkey").desc()], 31,
                                   {"youth": 7, "prize": 4}, 14, "other")
    return out.select("s_suppkey", "family", "slot")


@query("budget_select", """
with recursive c as (select p_partkey, p_brand, round(p_retailprice * 100 * (1 + p_size / 10.0))::bigint as cents,
    row_number() over (partition by p_brand order by p_type, p_partkey) as n from part),
 walk as (select p_brand, 0::bigint as n, 1000000::bigint as money, null::bigint as p_partkey from c group by 1
   union all select w.p_brand, c.n, case when c.cents <= w.money then w.money - c.cents else w.money end,
     case when c.cents <= w.money then c.p_partkey end from walk w join c on c.p_brand = w.p_brand and c.n = w.n + 1)
select p_partkey, p_brand from walk where p_partkey is not null""")
def budget_select(t):
    price = F.round(F.col("p_retailprice") * 100 * (1 + F.col("p_size") / 10.0)) / 100
    df = t.part.select("p_partkey", "p_brand", "p_type", price.alias("price"))
    return selection.budget_select(df, "p_brand", "price", ["p_type", "p_partkey"], 10000.0).select("p_partkey", "p_brand")


@query("budget_select_keys", """
with recursive c as (select p_partkey, p_brand, p_name, p_size::varchar as size, round(p_retailprice * 100)::bigint as cents,
    row_number() over (partition by p_brand order by p_type, p_partkey) as n from part),
 walk as (select p_brand, 0::bigint as n, 1200000::bigint as money, null::bigint as p_partkey, []::varchar[] as names, []::varchar[] as sizes from c group by 1
   union all select p_brand, n, case when fits then money - cents else money end, case when fits then p_partkey end,
     case when fits then list_append(names, p_name) else names end, case when fits then list_append(sizes, size) else sizes end
   from (select c.p_brand, c.n, w.money, c.cents, c.p_partkey, c.p_name, c.size, w.names, w.sizes,
       c.cents <= w.money and not list_contains(w.names, c.p_name) and not list_contains(w.sizes, c.size) as fits
     from walk w join c on c.p_brand = w.p_brand and c.n = w.n + 1))
select p_partkey, p_brand from walk where p_partkey is not null""")
def budget_select_keys(t):
    """One title and one size per brand at most."""
    df = t.part.select("p_partkey", "p_brand", "p_type", "p_name", F.col("p_size").cast("string").alias("size"), "p_retailprice")
    return selection.budget_select(df, "p_brand", "p_retailprice", ["p_type", "p_partkey"], 12000.0,
                                   keys=("p_name", "size")).select("p_partkey", "p_brand")


# --- stock-take, weeding ---------------------------------------------------------------------------------------

SCANS = "scans as (select l_partkey as code from lineitem where l_suppkey % 20 = 3 union all select l_orderkey + 900000 from lineitem where l_suppkey = 5)"


def stock_and_scans(t):
    stock = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("zone"))
    scans = t.lineitem.where(F.col("l_suppkey") % 20 == 3).select(F.col("l_partkey").alias("code")).unionByName(
        t.lineitem.where(F.col("l_suppkey") == 5).select((F.col("l_orderkey") + 900000).alias("code")))
    return stock, scans


@query("stocktake_missing", f"""
with {SCANS} select p_partkey as code, p_brand as zone from part where p_partkey not in (select code from scans)
 and p_brand in (select p_brand from part where p_partkey in (select code from scans))""")
def stocktake_missing(t):
    return stocktake.stock_missing(*stock_and_scans(t), "code", "zone")


@query("stocktake_unknown", f"with {SCANS} select distinct code from scans where code not in (select p_partkey from part)")
def stocktake_unknown(t):
    stock, scans = stock_and_scans(t)
    return stocktake.unknown_codes(scans, stock, "code")


@query("stocktake_progress", f"""
with {SCANS}, s as (select distinct code from scans)
select p_brand as zone, count(*) as expected, count(code) as seen, count(*) - count(code) as missing,
  round(100.0 * count(code) / count(*), 1)::double as percent from part left join s on code = p_partkey group by 1 having count(code) > 0""")
def stocktake_progress(t):
    return stocktake.zone_progress(*stock_and_scans(t), "code", "zone")


@query("scan_delta", """
with now as (select l_partkey as code, count(*) as n from lineitem group by 1),
 mem as (select p_partkey as code, p_size::bigint as n from part where p_size % 2 = 0)
select coalesce(now.code, mem.code) as code, greatest(coalesce(now.n, 0), coalesce(mem.n, 0))::bigint as n,
  case when coalesce(now.n, 0) <= coalesce(mem.n, 0) then 'unchanged' when mem.n is null then 'new' else 'seen again' end as status,
  greatest(coalesce(now.n, 0) - coalesce(mem.n, 0), 0)::bigint as added from now full join mem on mem.code = now.code""")
def scan_delta(t):
    scans = t.lineitem.select(F.col("l_partkey").alias("code"))
    none = F.array().cast("array<struct<date:string,times:bigint>>")
    memory = t.part.where(F.col("p_size") % 2 == 0).select(F.col("p_partkey").alias("code"), F.col("p_size").cast("bigint").alias("n"), none.alias("dates"))
    out = stocktake.scan_delta(scans, memory, "code", "2026-08-05")
    added = F.aggregate("dates", F.lit(0).cast("bigint"), lambda a, d: a + d["times"])
    return out.select("code", "n", "status", added.alias("added"))


@query("weeding_candidates", """
with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, p_type, p_brand, p_size,
   case p_size % 6 when 0 then 'Documentaire' when 1 then 'BD' when 2 then 'Album' when 3 then 'Fonds local' when 4 then '' else 'Manga' end as category,
   case when p_size % 6 in (0, 1) or p_size > 45 then lpad(((p_partkey * 13) % 1000)::varchar, 3, '0') end as dewey, 'Adulte' as audience,
   2026 - (1985 + p_size % 40) as age, case when l_returnflag = 'N' then null else year(l_shipdate) + 21 end as ly,
   case when l_returnflag = 'N' then 0 else l_quantity end as loans from lineitem join part on p_partkey = l_partkey where p_type <> 'PROMO'),
 b as (select *, count(*) over (partition by l_partkey) as copies, 2026 - ly as idle, loans = 0 and ly is null as never,
   coalesce(category = 'Documentaire' or (dewey is not null and category not in ('BD', 'Manga', 'Album')), false) as doc, dewey::int as d from c where category <> 'Fonds local'),
 r as (select *, case when d < 100 then 5 when d between 340 and 349 then 3 when d between 320 and 329 then 5 when d between 910 and 919 then 10 when d >= 700 then 15 else 10 end as ra,
   case when d < 100 then 2 when d between 340 and 349 then 1 when d between 320 and 329 then 2 when d between 910 and 919 then 3 when d >= 700 then 5 else 3 end as ri from b),
 k as (select *, case when doc and dewey is not null and age >= ra and (never or coalesce(idle >= ri, false)) then 'Documentaires'
   when category in ('BD', 'Manga') and never and age >= 10 then 'BD-manga jamais prêtées' when category in ('BD', 'Manga') and idle >= 10 then 'BD-manga sans prêt 10 ans'
   when category = 'Album' and idle >= 5 then 'Jeunesse sans prêt 5 ans'
   when category not in ('BD', 'Manga', 'Album') and not doc and idle >= 5 then 'Romans adultes sans prêt 5 ans' end as class from r)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, class from k where class is not null
union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'Doublons dormants' from k where copies >= 3 and idle >= 3""")
def weeding_candidates(t):
    size = F.col("p_size")
    category = (F.when(size % 6 == 0, "Documentaire").when(size % 6 == 1, "BD").when(size % 6 == 2, "Album")
                .when(size % 6 == 3, "Fonds local").when(size % 6 == 4, "").otherwise("Manga"))
    dewey = F.when((size % 6).isin(0, 1) | (size > 45), F.lpad(((F.col("p_partkey") * 13) % 1000).cast("string"), 3, "0"))
    parts = t.part.where(F.col("p_type") != "PROMO").select(
        F.col("p_partkey").alias("l_partkey"), F.lit("LIVRE").alias("kind"), category.alias("category"), dewey.alias("dewey"),
        (1985 + size % 40).cast("string").alias("published"), F.lit("Adulte").alias("audience"))
    new = F.col("l_returnflag") == "N"
    copies = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(~new, F.year("l_shipdate") + 21).alias("last_year"), F.when(new, 0).otherwise(F.col("l_quantity")).alias("loans"))
    out = weeding.weeding_candidates(copies.join(parts, "l_partkey"), "l_partkey", "kind", "category", "audience", "dewey",
                                     "published", "loans", "last_year", 2026)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "class")


# --- suggestions ---------------------------------------------------------------------------------------------------

@query("suggestion_rows", """
with k as (select *, row_number() over (partition by lower(p_name) order by p_partkey) as r from part where p_size > 10
           and lower(p_name) not in (select lower(p_name) from part where p_size = 1))
select p_name as title, p_brand as publisher, 'Tout public' as audience, 'À classer' as category, 'Amour / Romance' as genre,
  'Parution annoncée par l''éditeur' as motive, 'à étudier' as status from k where r = 1""")
def suggestion_rows(t):
    feed = t.part.where(F.col("p_size") > 10).select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
                                                     F.lit("Romance").alias("genre"))
    stored = t.part.where(F.col("p_size") == 1).select(F.col("p_name").alias("title"))
    return suggestions.suggestion_rows(feed, stored, "title", "p_partkey", "Veille éditeurs").select(
        "title", "publisher", "audience", "category", "genre", "motive", "status")


@query("allowed_actions", """
with s as (select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1),
 m as (select event_id, e.user_id, case e.event_type when 'view' then 'à étudier' when 'click' then 'à commander' when 'purchase' then 'acquise' else 'écartée' end as action,
  case s.event_type when 'view' then 'à étudier' when 'click' then 'à commander' when 'purchase' then 'acquise' else 'écartée' end as now from events e join s using (user_id))
select event_id, action from m where (now = 'à étudier' and action <> 'à étudier') or (now = 'à commander' and action <> 'à commander')
  or (now = 'acquise' and action in ('à étudier', 'à commander')) or (now = 'écartée' and action = 'à étudier')""")
def allowed_actions(t):
    kind = F.col("event_type")
    name = F.when(kind == "view", "à étudier").when(kind == "click", "à commander").when(kind == "purchase", "acquise").otherwise("écartée")
    events = t.events.select("event_id", "user_id", "ts", name.alias("action"))
    states = suggestions.latest_status(events, "user_id", "action", "ts", "event_id")
    return suggestions.allowed_actions(events, states, "user_id").select("event_id", "action")


@query("next_batch", """
select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by 1 limit 200""")
def next_batch(t):
    tried = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return suggestions.next_batch(t.orders.select("o_orderkey"), tried, "o_orderkey")


@query("feed_freshness", """
with old as (select o_orderpriority as feed, max(strftime(o_orderdate, '%Y-%m-%d')) as previous from orders where o_orderstatus = 'F' and o_orderpriority <> '2-HIGH' group by 1),
 new as (select o_orderpriority as feed, max(strftime(o_orderdate, '%Y-%m-%d')) as file_date from orders where o_orderstatus = 'O' and o_totalprice < 300000 group by 1)
select feed, file_date, previous, case when previous is null then 'first' when file_date < previous then 'older'
  when file_date = previous then 'same' else 'newer' end as freshness from new left join old using (feed)""")
def feed_freshness(t):
    def latest(df):
        return df.groupBy(F.col("o_orderpriority").alias("feed")).agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("file_date"))
    state = latest(t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "2-HIGH")))
    incoming = latest(t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 300000)))
    return suggestions.feed_freshness(state, incoming)


@query("first_valid_cover", """
with u as (select p_partkey, unnest([p_brand || '/' || p_size, p_name || '/' || p_size]) as url, unnest([0, 1]) as rank from part),
 good as (select distinct p_brand || '/' || p_size as url from part where p_size % 3 = 0 union select distinct p_name || '/' || p_size from part where p_size % 2 = 0)
select p_partkey, arg_min(url, rank) as cover from u where url in (select url from good) group by 1""")
def first_valid_cover(t):
    size = F.col("p_size")
    first, second = F.concat_ws("/", "p_brand", "p_size"), F.concat_ws("/", "p_name", "p_size")
    statuses = t.part.select(first.alias("url"), F.when(size % 3 == 0, "image/png").otherwise("text/html").alias("content_type"),
                             F.lit(5000).alias("size")).unionByName(
        t.part.select(second.alias("url"), F.lit("image/jpeg").alias("content_type"), F.when(size % 2 == 0, 1000).otherwise(999).alias("size")))
    return suggestions.first_valid_cover(t.part.select("p_partkey", "p_brand", "p_name", "p_size"), "p_partkey", F.array(first, second), statuses)

"""Fixture bindings of files written and read back, and of whole jobs, one query per output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import filters
from shelfspark.operators.keyed import exact_rank
from shelfspark.plans import derive, jobs
from shelfspark.plans.bind_sources import TITLES, catalogue, parsed
from shelfspark.plans.registry import query
from shelfspark.session import scratch
from shelfspark.sinks import exports
from shelfspark.sources import files, marc


def written(t, df, label: str) -> str:
    """A folder of delimited files with a header in each."""
    path = scratch(t.spark, label)
    df.write.csv(path, header=True, sep=";")
    return path


def in_file_order(df):
    """Rows of a file source with their place."""
    return exact_rank(df.select("*", files.file_order().alias("_order")).withColumn("_all", F.lit(1)), ["_all"], ["_order"], "place").drop("_order", "_all")


# --- loan and counter exports ----------------------------------------------------------------------

@query("loans_per_title", """
select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, case when l_linenumber < 7 then lpad(l_partkey::varchar, 13, '9') end as ean,
  case when l_returnflag <> 'N' then l_quantity::bigint end as total, strftime(l_shipdate, '%Y-%m-%d') || ' 10:30' as last_loan from lineitem""")
def loans_per_title(t):
    """An export per title, read from files; three figures carry the line's keys."""
    code = F.when(F.col("l_linenumber") < 7, F.lpad(F.col("l_partkey").cast("string"), 13, "9")).otherwise("12")
    carried = [F.col(c).cast("string").alias(files.TITLE_COLUMNS[n]) for c, n in (("l_orderkey", "n1"), ("l_linenumber", "n2"), ("l_partkey", "n3"))]
    rows = t.lineitem.select(
        F.lit("Titre").alias("Titre"), code.alias(files.TITLE_CODE),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("string")).otherwise("Aucune donnée disponible").alias(files.TITLE_COLUMNS["total"]),
        *carried, F.date_format("l_shipdate", "dd/MM/yyyy 10:30").alias(files.LAST_LOAN))
    layout, found = files.read_loans(t.spark, written(t, rows, "loans"))
    assert layout == "title"
    return found.select(F.col("n1").alias("l_orderkey"), F.col("n2").alias("l_linenumber"), F.col("n3").alias("l_partkey"), "ean", "total", "last_loan")


COPY_SQL = """
c as (select 'B' || l_partkey as barcode, case when l_returnflag = 'N' then null else l_quantity::bigint end as loans, year(l_shipdate)::varchar as last_loan_year, l_orderkey, l_linenumber, l_suppkey
  from lineitem where l_linenumber <> 3)"""


def copy_export(t):
    """Codes of line 3 are blank; lines come in the order of their keys."""
    rows = t.lineitem.orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").select(
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit(" B"), F.col("l_partkey").cast("string"))).otherwise("  ").alias(files.COPY_CODE),
        F.when(F.col("l_returnflag") == "N", "—").otherwise(F.col("l_quantity").cast("string")).alias(files.COPY_COLUMNS["loans"]),
        F.concat(F.year("l_shipdate").cast("string"), F.lit(".0")).alias(files.COPY_COLUMNS["last_year"]))
    layout, found = files.read_loans(t.spark, written(t, rows, "copy-loans"), placed=True)
    assert layout == "copy"
    return found


@query("loans_per_copy", f"with {COPY_SQL} select barcode, loans, last_loan_year, count(*) as n from c group by 1, 2, 3")
def loans_per_copy(t):
    return copy_export(t).groupBy("barcode", "loans", "last_loan_year").agg(F.count(F.lit(1)).alias("n"))


@query("copy_loans_import", f"""
with {COPY_SQL}, last as (select * from c qualify row_number() over (partition by barcode order by l_orderkey desc, l_linenumber desc, l_suppkey desc) = 1)
select p.barcode, case when last.barcode is null then 7 else last.loans end as loans, last_loan_year from (select 'B' || p_partkey as barcode from part where p_size % 2 = 0) p left join last using (barcode)""")
def copy_loans_import(t):
    """The last row of a code counts, also where it gives no figure; codes of unknown copies do not come in."""
    copies = t.part.where("p_size % 2 = 0").select(F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("barcode"), F.lit(7).cast("bigint").alias("loans"),
                                                   F.lit(None).cast("string").alias("last_loan_year"))
    return jobs.copy_loans_import(copy_export(t), copies)


@query("footfall_files", """
select date_trunc('minute', ts) as ts, (event_id % 7)::bigint as entries, count(*) as n from events where event_id % 7 > 0 and event_type <> 'error' group by 1, 2""")
def footfall_files(t):
    """Counter exports in both header dialects; rows without a clock are left out."""
    clock = F.when(F.col("event_type") != "error", F.date_format("ts", "HH:mm:ss")).otherwise("n/a")
    out = None
    for rest, (date, hour, entries) in enumerate((("DATE", "HOUR", "IN"), ("Date", "Heure", "Entrées"))):
        rows = t.events.where(F.col("event_id") % 2 == rest).select(F.date_format("ts", "yyyy-MM-dd").alias(date), clock.alias(hour),
                                                                    F.concat(F.lit(" "), (F.col("event_id") % 7).cast("string")).alias(entries))
        found = files.read_footfall(t.spark, written(t, rows, "footfall"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("ts", "entries").agg(F.count(F.lit(1)).alias("n"))


# --- exports read back -----------------------------------------------------------------------------

@query("inventory_file", """
select row_number() over (order by p_name, 'B' || p_partkey) as place, p_name as "Titre", 'B' || p_partkey as "Code-barres", p_size::varchar as "Tome", p_type as "Catégorie" from part""")
def inventory_file(t):
    """The inventory as written, in the order of the files; columns that the frame lacks stay empty."""
    path = scratch(t.spark, "inventory")
    exports.export_inventory(t.part.select(F.col("p_name").alias("title"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("barcode"),
                                           F.col("p_size").alias("volume"), F.col("p_type").alias("category")), path)
    back = t.spark.read.csv(path, header=True, sep=";")
    assert back.columns == [label for _, label in exports.INVENTORY_LABELS]
    return in_file_order(back).where(F.col("Cote").isNull()).select(F.col("place").cast("bigint").alias("place"), "Titre", "Code-barres", "Tome", "Catégorie")


@query("order_files", """
with b as (select 'E' || p_partkey as ean, p_type as origin, p_brand as category, p_name as series, p_size as volume from part),
 r as (select ean, row_number() over (order by origin, category, regexp_replace(lower(series), '[^a-z0-9 ]', '', 'g'), lpad(volume::varchar, 3, '0'), ean) as place from b)
select place, ean, 1 as quantity from r""")
def order_files(t):
    """Both files of an order, in order: the lines with a quantity, and the plain codes."""
    folder = scratch(t.spark, "order")
    exports.export_order(t.part.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("ean"), F.col("p_type").alias("origin"),
                                       F.col("p_brand").alias("category"), F.col("p_name").alias("series"), F.col("p_size").alias("volume")), folder)
    lines = in_file_order(t.spark.read.csv(f"{folder}/order_csv", header=True, sep=";"))
    codes = in_file_order(t.spark.read.text(f"{folder}/order_txt"))
    return (lines.join(codes.select("place", F.col("value").alias("code")), "place").where(F.col("code") == F.col("EAN"))
            .select(F.col("place").cast("bigint").alias("place"), F.col("EAN").alias("ean"), F.col("Quantité").cast("int").alias("quantity")))


@query("missing_series_volume", """
select o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderstatus = 'F' and o_orderkey % 3 = 0 and o_orderkey % 2 = 0""")
def missing_series_volume(t):
    key = F.col("o_orderkey")
    df = t.orders.select(key, F.when(key % 5 == 0, F.concat(F.lit("CB:"), key.cast("string"))).otherwise(key.cast("string")).alias("id"),
                         F.when(F.col("o_orderstatus") == "F", "LIVRE").otherwise("DVD").alias("kind"),
                         F.when(key % 3 != 0, F.col("o_orderpriority")).alias("series"), F.when(key % 2 != 0, "1").alias("volume"))
    return filters.missing_series_volume(df, "id", "kind", "series", "volume").select("o_orderkey")


# --- jobs, table by table --------------------------------------------------------------------------

LOANS_SQL = f"""
t as ({TITLES}), f as (select '978' || lpad(l_partkey::varchar, 10, '0') as ean, l_quantity::bigint as total from lineitem
  qualify row_number() over (partition by l_partkey order by l_orderkey * 100 + l_linenumber, l_quantity) = 1)"""


def loans_job(t):
    code = F.concat(F.lit("978"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"))
    rows = t.lineitem.select(code.alias("raw_code"), code.alias("ean"), F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_quantity").alias("pos"),
                             F.col("l_quantity").cast("bigint").alias("total"))
    titles = marc.marc_to_titles(parsed(t), derive.SITE, derive.SCHEME).drop("record_id").withColumn("total", F.lit(-1).cast("bigint"))
    return jobs.loans_import(rows, titles, "2026-08-05")


@query("loans_titles", f"with {LOANS_SQL} select identifier, title, case when ean is null then -1 else total end as total from t left join f on ean = identifier")
def loans_titles(t):
    return loans_job(t)["titles"].select("identifier", "title", "total")


@query("loans_snapshot", f"with {LOANS_SQL} select identifier, '2026-08-05' as exported, total from t join f on ean = identifier")
def loans_snapshot(t):
    return loans_job(t)["snapshot"]


COPIES_SQL = """
c as (select case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end as identifier, 'A' || p_partkey as barcode, 'R ' || p_brand as shelfmark,
    'Jeunesse' as audience, 'Imprimé' as support, '2026-08-05' as entered, p_partkey from part
  union all select case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end, 'C' || p_partkey, null, 'Adulte', 'Imprimé', null, p_partkey from part where p_size > 25)"""


@query("catalogue_copies", f"""
with {COPIES_SQL}, old as (select 'A' || p_partkey as barcode, p_type as zone from part where p_size % 3 = 0 union all select 'Z' || p_partkey, p_type from part where p_size = 7)
select barcode, identifier, shelfmark, audience, support, entered, zone from old full join c using (barcode)""")
def catalogue_copies(t):
    """Copies of an import: known ones are replaced but for what the import does not know, others stay."""
    known = t.part.where("p_size % 3 = 0").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("barcode"), F.col("p_type").alias("zone"))
    known = known.unionByName(t.part.where("p_size = 7").select(F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("barcode"), F.col("p_type").alias("zone")))
    none = F.lit(None).cast("string")
    for c in ("identifier", "shelfmark", "audience", "status", "support", "entered"):
        known = known.withColumn(c, none)
    titles = marc.marc_to_titles(parsed(t, t.part.where("p_size = 1")), derive.SITE, derive.SCHEME).drop("record_id")
    out = jobs.catalogue_import(parsed(t), titles, known, derive.SITE, derive.SCHEME)["copies"]
    return out.select("barcode", "identifier", "shelfmark", "audience", "support", "entered", "zone")


SIGNALS_SQL = f"""
q as (select l_partkey, sum(l_quantity)::bigint as loans from lineitem group by 1),
t as (select x.*, coalesce(loans, 0) as loans, 'DL ' || (p_size + 1980) as published from ({TITLES}) x left join q on l_partkey = p_partkey)"""


def signals(t):
    records = parsed(t)
    copies = marc.marc_to_copies(records, derive.SITE).withColumn("loans", F.length("barcode") * 3)
    return jobs.acquisition_signals(catalogue(t, records), copies, 2026)


@query("signals_top_creators", f"""with {SIGNALS_SQL}
select author, count(*) as titles, sum(loans)::bigint as total_loans, round(sum(loans) / count(*), 1) as loans_per_title from t where loans > 0 group by 1 having sum(loans) >= 15 order by total_loans desc, author limit 25""")
def signals_top_creators(t):
    return signals(t)["top_creators"]


@query("signals_single_copy_hot", f"""with {SIGNALS_SQL}
select identifier, 1::bigint as copies, (3 * length('A' || p_partkey))::bigint as total_loans from t where p_size <= 25 and 3 * length('A' || p_partkey) >= 12 order by total_loans desc, identifier limit 20""")
def signals_single_copy_hot(t):
    return signals(t)["single_copy_hot"].select("identifier", "copies", "total_loans")


@query("signals_genre_rotation", f"""with {SIGNALS_SQL}
select genre, audience, count(*) as titles, sum(loans)::bigint as total_loans, round(sum(loans) / count(*), 1) as rotation from t where genre is not null and loans > 0
group by 1, 2 having count(*) >= 3 order by rotation desc, genre, audience limit 30""")
def signals_genre_rotation(t):
    return signals(t)["genre_rotation"]


@query("signals_audience_rotation", f"""with {SIGNALS_SQL}
select audience, count(*) as titles, sum(loans)::bigint as total_loans, round(sum(loans) / count(*), 1) as rotation from t group by 1""")
def signals_audience_rotation(t):
    return signals(t)["audience_rotation"]


@query("signals_recent_low_use", f"""with {SIGNALS_SQL}
select identifier, published, loans from t where p_size + 1980 >= 2024 and loans < 3 order by published desc, loans, identifier limit 30""")
def signals_recent_low_use(t):
    return signals(t)["recent_low_use"].select("identifier", "published", "loans")


@query("signals_series_gaps", f"""with {SIGNALS_SQL},
 v as (select series, volume, sum(loans) as loans from t where series is not null and regexp_matches(volume, '^[0-9]') group by 1, 2)
select series, count(*) as volumes_held, max(volume::bigint) as highest, sum(loans)::bigint as total_loans from v group by 1
having count(*) < max(volume::bigint) and max(volume::bigint) > 1 and sum(loans) >= 5 order by total_loans desc, series limit 25""")
def signals_series_gaps(t):
    return signals(t)["series_gaps"]


@query("signals_age_profile", f"""with {SIGNALS_SQL},
 y as (select loans, substr(published, 1, 4) as year from t)
select case when year >= '2023' then '2023-2026 (recent)' when year >= '2020' then '2020-2022' when year >= '2015' then '2015-2019' when year >= '2010' then '2010-2014'
  when year >= '2000' then '2000-2009' else 'avant 2000' end as period, count(*) as titles, sum(loans)::bigint as total_loans, round(sum(loans) / count(*), 1) as rotation from y group by 1""")
def signals_age_profile(t):
    return signals(t)["age_profile"]


@query("display_slides", """
select '978' || lpad(p_partkey::varchar, 10, '0') as isbn, p_name as t, p_brand as a, (p_size + 1980)::varchar as y, p_type || '.' as ed, 'R ' || p_brand as cote, 'Jeunesse' as pub, 'Imprimé' as sup,
  'Résumé suite' as d, 'https://c/978' || lpad(p_partkey::varchar, 10, '0') || '.jpg' as img from part where p_size % 4 <> 0 and p_size % 3 = 0 and p_size <= 25""")
def display_slides(t):
    """Every field of the slides, read out of their JSON, of titles with one copy."""
    records = parsed(t, t.part.where("p_size <= 25"))
    titles = marc.marc_to_titles(records, derive.SITE, derive.SCHEME)
    copies = marc.marc_to_copies(records, derive.SITE).withColumn("entered", F.lit("2026-07-01"))
    code = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    statuses = t.part.where("p_size % 3 = 0").select(F.concat(F.lit("https://c/"), code, F.lit(".jpg")).alias("url"), F.lit("image/jpeg").alias("content_type"), F.lit(4000).alias("size"))
    shown = jobs.display_feed(titles, copies, statuses, "2026-08-05", "https://c/{}.jpg")
    return shown.select(F.from_json("value", "t string, a string, y string, ed string, cote string, pub string, sup string, d string, isbn string, img string").alias("s")).select("s.*")

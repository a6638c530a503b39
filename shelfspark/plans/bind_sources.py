"""Fixture bindings: records, pages, feeds, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import filters
from shelfspark.operators.keyed import exact_rank
from shelfspark.plans import derive, jobs
from shelfspark.plans.bind_holdings import OPEN
from shelfspark.plans.registry import query
from shelfspark.session import materialise, scratch, spread
from shelfspark.sinks import exports
from shelfspark.sources import feeds, files, marc, pages
from shelfspark.streaming import jobs as streams


# --- records -------------------------------------------------------------------------------------

def parsed(t, rows=None):
    """The derived records, stored like an export and then parsed; titles and copies read the
    stored fields, so that a record is cut once."""
    return materialise(marc.parse_marc(derive.records(t.part if rows is None else rows), "value"), "parsed")


@query("marc_fields", """
with f as (select p_partkey as record_id, unnest(['073', '200', '700', '702', '210', '330', '461', '606', '686', '995', '995', '995']) as tag,
  unnest([p_size % 4 <> 0, true, true, true, true, true, p_size % 5 = 1, true, true, true, true, p_size > 25]) as there,
  unnest([1, case when p_size % 5 = 0 then 3 else 2 end, 3, 2, 2, 2, case when p_size % 2 = 0 then 2 else 1 end, 2, 2, 3, 6, 4]) as subs,
  unnest(range(12)) as n from part)
select record_id, (row_number() over (partition by record_id order by n) - 1)::int as pos, tag, subs::int as subs from f where there""")
def marc_fields(t):
    return marc.marc_fields(parsed(t)).select("record_id", "pos", "tag", F.size("sub").alias("subs"))


@query("marc_files", """
select (case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end) as identifier, p_name as title,
 case when p_size % 2 = 0 then 'été' else chr(65533) || 't' || chr(65533) end as subtitle, p_brand as author, p_type || '.' as publisher,
 row_number() over (partition by p_size % 2 order by p_partkey) as place from part""")
def marc_files(t):
    """Records in files, half of them in Latin-1: the bytes keep their places, so that what is plain
    reads the same; places follow the files."""
    folders = []
    for charset, rest in (("ISO-8859-1", 1), (None, 0)):
        made = derive.records(t.part.where(F.col("p_size") % 2 == rest), charset)
        folders.append(scratch(t.spark, "marc-files"))
        (made.repartitionByRange("record_id").sortWithinPartitions("record_id").select("value")
         .write.option("lineSep", marc.RECORD_END).text(folders[-1]))
    out = None
    for folder in folders:
        titles = marc.marc_to_titles(marc.read_marc(t.spark, folder), derive.SITE, derive.SCHEME)
        ranked = exact_rank(titles.withColumn("all", F.lit(1)), ["all"], ["record_id"], "place")
        found = ranked.select("identifier", "title", "subtitle", "author", "publisher", F.col("place").cast("bigint").alias("place"))
        out = found if out is None else out.unionByName(found)
    return out


@query("marc_titles", """
select p_partkey as record_id, case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end as identifier,
 'LIVRE' as kind, p_name as title, 'été' as subtitle, case when p_size % 5 = 0 then p_name when p_size % 5 = 1 then 'Série' end as series,
 case when p_size % 5 = 0 then p_size::varchar when p_size % 5 = 1 and p_size % 2 = 0 then '4' end as volume, p_brand as author,
 'Dessinateur' as illustrator, p_type || '.' as publisher, 'DL ' || (p_size + 1980) as published, 'Résumé suite' as abstract, 'Jeunesse' as audience,
 case when p_size % 2 = 0 then 'BD' end as category, case when p_size % 2 = 1 then 'Policier' end as genre, p_type || ' | mer' as keywords from part""")
def marc_titles(t):
    return marc.marc_to_titles(parsed(t), derive.SITE, derive.SCHEME).select(
        "record_id", "identifier", "kind", "title", "subtitle", "series", "volume", "author", "illustrator", "publisher",
        "published", "abstract", "audience", "category", "genre", "keywords")


@query("marc_copies", """
with c as (select p_partkey, case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end as identifier, * from part)
select identifier, 'A' || p_partkey as barcode, 'R ' || p_brand as shelfmark, 'Jeunesse' as audience, 'Imprimé' as support, '20260805' as entered from c
union all select identifier, 'C' || p_partkey, null, 'Adulte', 'Imprimé', null from c where p_size > 25""")
def marc_copies(t):
    return marc.marc_to_copies(parsed(t), derive.SITE).select("identifier", "barcode", "shelfmark", "audience", "support", "entered")


TITLES = """select case when p_size % 4 <> 0 then '978' || lpad(p_partkey::varchar, 10, '0') else 'CB:A' || p_partkey end as identifier,
 p_name as title, case when p_size % 5 = 0 then p_name when p_size % 5 = 1 then 'Série' end as series,
 case when p_size % 5 = 0 then p_size::varchar when p_size % 5 = 1 and p_size % 2 = 0 then '4' end as volume, p_brand as author,
 p_type || '.' as publisher, case when p_size % 2 = 0 then 'BD' end as category, case when p_size % 2 = 1 then 'Policier' end as genre,
 'Jeunesse' as audience, p_partkey, p_size from part"""


@query("catalogue_import", f"""
with t as ({TITLES}) select identifier, title, series, volume, author, publisher, category, genre, audience,
  case when p_size % 3 = 0 then 'inserted' else 'updated' end as merge_action from t""")
def catalogue_import(t):
    """Records of all parts merged into a catalogue made of the records of two
    thirds of them."""
    have = parsed(t, t.part.where(F.col("p_size") % 3 != 0))
    titles = marc.marc_to_titles(have, derive.SITE, derive.SCHEME).drop("record_id")
    copies = marc.marc_to_copies(have, derive.SITE).drop("record_id", "copy_pos")
    merged = jobs.catalogue_import(parsed(t), titles, copies, derive.SITE, derive.SCHEME)["titles"]
    return merged.select("identifier", "title", "series", "volume", "author", "publisher", "category", "genre", "audience", "merge_action")


# --- pages ------------------------------------------------------------------------------------------

LINKS = r"""l as (select page_id, url as base, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>')) as a from pages),
 h as (select page_id, base, trim(regexp_extract(a, '(?is)href="([^"]*)"', 1)) as href,
   substr(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), 1, 70) as label from l),
 x as (select distinct page_id, case when regexp_matches(b, '^(?i)https?://') then b when starts_with(b, '//') then regexp_extract(base, '^(https?:)', 1) || b
   when starts_with(b, '/') then regexp_extract(base, '^(https?://[^/?#]+)', 1) || b when starts_with(b, '?') then regexp_extract(base, '^([^?#]*)', 1) || b
   else rtrim(regexp_extract(base, '^(https?://[^/?#]+(?:/[^?#]*/)?)', 1), '/') || '/' || b end as link, label
   from (select *, regexp_extract(href, '^([^#]*)', 1) as b from h where href <> '' and not regexp_matches(lower(href), '^(mailto:|javascript:|#)')))"""


@query("page_links", f"with {LINKS} select page_id, link, label from x")
def page_links(t):
    return pages.extract_links(t.pages, "page_id", "url", "html")


@query("link_classes", rf"""
with {LINKS}, y as (select regexp_replace(regexp_replace(link, '/(The|the)$', '/ssh-12'), '/and$', '/rayon') as link from x)
select case when regexp_matches(link, '/list-\d+/') then 'SELECTIONS' when regexp_matches(link, '/livre/\d{{9,13}}') then 'FICHES'
 when regexp_matches(link, '/ssh-\d+|/rayon') then 'RAYONS' when regexp_matches(link, 'listeliv|recherche|search') then 'RECHERCHES' else 'AUTRES' end as link_class,
 count(*) as n from y group by 1""")
def link_classes(t):
    links = pages.extract_links(t.pages, "page_id", "url", "html")
    shelves = F.regexp_replace(F.regexp_replace("link", "/(The|the)$", "/ssh-12"), "/and$", "/rayon")
    return pages.classify_links(links.withColumn("link", shelves)).groupBy("link_class").agg(F.count(F.lit(1)).alias("n"))


@query("page_titles", r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as title from pages""")
def page_titles(t):
    return t.pages.select("page_id", pages.page_title("html").alias("title"))


@query("product_titles", """
select p_partkey, p_name || case when p_size % 2 = 0 then ' Tome ' || p_size else '' end as title, p_brand as author, 'Dupuis' as publisher,
 'Poche' as support, case when p_size % 2 = 0 then p_name end as series, case when p_size % 2 = 0 then p_size::varchar end as volume from part""")
def product_titles(t):
    return pages.parse_product_title(derive.product_pages(t.part), "html", "La Librairie").drop("html")


@query("result_titles", """
select p_partkey, case when p_size % 3 = 2 then p_name else p_brand end as title, case when p_size % 3 <> 1 then p_name end as series,
  case when p_size % 3 <> 1 then p_size::varchar end as volume, case when p_size % 3 <> 1 then 'J. K. Rowling' end as author from part""")
def result_titles(t):
    size = F.col("p_size")
    numbered = F.concat(F.col("p_name"), F.lit(" Tome "), size.cast("string"))
    author = F.lit("J. K. Rowling- Livres audio - CD")
    body = (F.when(size % 3 == 0, F.concat_ws(" : ", numbered, "p_brand", author)).when(size % 3 == 1, F.concat_ws(" : ", "p_name", "p_brand"))
            .otherwise(F.concat_ws(" : ", numbered, author)))
    df = t.part.select("p_partkey", F.concat(F.lit("<title>"), body, F.lit(" | Magasin</title>")).alias("html"))
    return pages.parse_result_title(df, "html", "Magasin").drop("html")


@query("product_codes", """
select p_partkey, 0 as place, '978' || lpad(p_partkey::varchar, 10, '0') as code from part union all select p_partkey, 1, '9781111111111' from part""")
def product_codes(t):
    return pages.extract_product_codes(derive.product_pages(t.part), "p_partkey", "html")


@query("prices", """
select p_partkey, case when p_size % 4 in (0, 1) then p_retailprice when p_size % 4 = 2 then p_size + 10.5 end::double as price from part""")
def prices(t):
    return derive.product_pages(t.part).select("p_partkey", pages.extract_price("html").alias("price"))


@query("candidate_pages", """
select p_partkey, p_name || ' & co' as title, p_type as publisher, (p_size + 1980)::varchar as year, 'trouvé' as state, 's' as source from part""")
def candidate_pages(t):
    out = pages.parse_candidate_page(derive.product_pages(t.part), "html", "s")
    return out.select("p_partkey", "title", "publisher", "year", "state", "source")


# --- feeds and responses -------------------------------------------------------------------------------

@query("feed_items", """
select p_partkey, p_name || ' & ' || p_brand as title, 'http://x/livres/' || p_partkey as link, p_brand as author, 'Seuil' as publisher,
 '0' || (1 + p_size % 9) || '/02/2026' as published from part""")
def feed_items(t):
    date = F.concat(F.lit("0"), (1 + F.col("p_size") % 9).cast("string"), F.lit("/02/2026"))
    item = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit(" &amp; "), F.col("p_brand"), F.lit("</title><link>http://x/livres/"),
                    F.col("p_partkey").cast("string"), F.lit("</link><description>&lt;p&gt;Auteur : "), F.col("p_brand"),
                    F.lit(" ;&lt;/p&gt;&lt;p&gt;&amp;Eacute;diteur : Seuil&lt;/p&gt;&lt;p&gt;Date de parution : "), date,
                    F.lit("&lt;/p&gt;</description></item>"))
    other = F.lit("<item><title> </title><link>x</link></item><item><title>Article</title><link>http://x/articles/1</link></item>")
    xml = F.concat(F.lit("<rss><channel>"), item, other, F.lit("</channel></rss>"))
    return feeds.read_feed(spread(t.part).select("p_partkey", xml.alias("xml")), "xml", reviews_only=True)


@query("marcxml", """
select p_partkey, p_name || ' : sous-titre' as title, case when p_size % 2 = 0 then 'Nom F' else 'X ' || p_brand end as author, p_type as publisher,
 (1980 + p_size % 40)::varchar as year, 'mer, terre' as keywords, '741.5' as dewey, 'Jeune' as audience from part""")
def marcxml(t):
    size = F.col("p_size")
    def data(tag, *subs):
        inner = [F.concat(F.lit(f'<mxc:subfield code="{c}">'), v, F.lit("</mxc:subfield>")) for c, v in subs]
        return F.concat(F.lit(f'<mxc:datafield tag="{tag}" ind1=" ">'), *[F.coalesce(i, F.lit("")) for i in inner], F.lit("</mxc:datafield>"))
    xml = F.concat(
        F.lit('<srw:searchRetrieveResponse xmlns:srw="u"><srw:records><srw:record><srw:recordData><mxc:record xmlns:mxc="info">'),
        data("200", ("a", F.col("p_name")), ("e", F.lit("sous-titre")), ("f", F.when(size % 2 == 0, "Nom F"))),
        data("700", ("a", F.col("p_brand")), ("b", F.lit("X"))),
        data("214", ("c", F.col("p_type")), ("d", F.concat(F.lit("DL "), (1980 + size % 40).cast("string")))),
        data("606", ("a", F.lit("mer"))), data("607", ("a", F.lit("terre"))), data("676", ("a", F.lit("741.5"))),
        data("521", ("a", F.lit("Pour les enfants"))),
        F.lit("</mxc:record></srw:recordData></srw:record></srw:records></srw:searchRetrieveResponse>"))
    return feeds.parse_marcxml(spread(t.part).select("p_partkey", xml.alias("xml")), "xml").drop("abstract")


@query("volumes_json", """
select p_partkey, p_name || ' : ' || p_type as title, p_brand || ', B, C' as author, 'Seuil' as publisher, '2019' as year,
  case when p_size % 2 = 0 then 'BD' else 'Roman' end as genre, case when p_size % 2 = 0 then 'Jeune' end as audience, 'https://i/t' as image from part""")
def volumes_json(t):
    info = F.struct(
        F.col("p_name").alias("title"), F.col("p_type").alias("subtitle"), F.array(F.col("p_brand"), F.lit("B"), F.lit("C")).alias("authors"),
        F.lit("Seuil").alias("publisher"), F.lit("2019-04").alias("publishedDate"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Juvenile"), F.lit("Comics"))).otherwise(F.array(F.lit("Fiction"))).alias("categories"),
        F.struct(F.lit("http://i/t&edge=curl").alias("thumbnail")).alias("imageLinks"))
    body = F.to_json(F.struct(F.array(F.struct(info.alias("volumeInfo"))).alias("items")))
    return feeds.parse_volumes_json(spread(t.part).select("p_partkey", body.alias("body")), "body").drop("abstract")


@query("bibkeys_json", """
select p_partkey, p_name || ' tome ' || p_size as title, p_brand as author, 'Dupuis' as publisher, '2015' as year, 'BD' as type, 'Jeunesse' as audience,
 p_size::varchar as volume, p_name as series, '7' as pegi from part""")
def bibkeys_json(t):
    isbn = F.concat(F.lit("978"), F.col("p_partkey").cast("string"))
    book = F.struct(F.concat(F.col("p_name"), F.lit(" tome "), F.col("p_size").cast("string")).alias("title"),
                    F.array(F.struct(F.col("p_brand").alias("name"))).alias("authors"),
                    F.array(F.struct(F.lit("Dupuis").alias("name"))).alias("publishers"), F.lit("May 2015").alias("publish_date"))
    body = F.to_json(F.create_map(F.concat(F.lit("ISBN:"), isbn), book))
    df = spread(t.part).select("p_partkey", isbn.alias("isbn"), body.alias("body"))
    return feeds.parse_bibkeys_json(df, "body", "isbn").select(
        "p_partkey", "title", "author", "publisher", "year", "type", "audience", "volume", "series", "pegi")


@query("code_list", """
select o_orderkey::varchar as code from orders where o_orderkey % 3 <> 0""")
def code_list(t):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit(" # "), k)).when(k % 3 == 1, F.concat(F.lit(" "), k, F.lit(" # note 12"))).otherwise(k.cast("string"))
    return files.code_list(t.orders.select(line.alias("value")), digits_only=True)


@query("decision_pairs", """
select distinct p_type as old, upper(p_brand) as new from part where p_size % 3 > 0""")
def decision_pairs(t):
    sheet = t.part.select(F.concat(F.lit(" "), F.col("p_type")).alias("a"), F.when(F.col("p_size") % 3 > 0, F.upper("p_brand")).otherwise("").alias("b"))
    return files.decision_pairs(sheet, "a", "b")


@query("route_inputs", """
select 'catalogue' as feed, max('x/Liste - ' || strftime(o_orderdate, '%Y-%m-%d') || '.mrc') as path, count(*) filter (o_orderstatus = 'F') as files,
  max(strftime(o_orderdate, '%Y-%m-%d')) as file_date from orders where o_orderstatus = 'F'
union all select 'footfall', max('x/Liste - ' || strftime(o_orderdate, '%Y-%m-%d') || '.csv'), count(*), max(strftime(o_orderdate, '%Y-%m-%d')) from orders where o_orderstatus = 'O'""")
def route_inputs(t):
    ending = F.when(F.col("o_orderstatus") == "F", ".mrc").when(F.col("o_orderstatus") == "O", ".CSV").otherwise(".txt")
    names = t.orders.select(F.concat(F.lit("x/Liste - "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lower(ending)).alias("path"),
                            F.col("o_orderdate").alias("modificationTime"))
    return files.route_inputs(names)


# --- sinks ------------------------------------------------------------------------------------------------

@query("export_query", """
select (select count(*) from orders where o_orderstatus <> 'P') as total, (select count(*) from orders where o_orderstatus <> 'P') > 1000 as cut,
  row_number() over (order by o_orderkey) as place, o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P' order by o_orderkey limit 1000""")
def export_query(t):
    """The first 1000 orders written as CSV, read back, with what the export reports."""
    path = scratch(t.spark, "export")
    report = exports.export_query(t.orders.where(F.col("o_orderstatus") != "P").select("o_orderkey", "o_orderstatus"), path, "o_orderkey", cap=1000)
    back = t.spark.read.csv(path, header=True, sep=";").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))
    return filters.placed(back, ["o_orderkey"]).join(F.broadcast(report))


@query("export_by_class", "select o_orderpriority, count(*) as n from orders group by 1")
def export_by_class(t):
    path = scratch(t.spark, "classes")
    exports.export_by_class(t.orders, "o_orderpriority", path, "o_orderstatus", "o_orderkey")
    return t.spark.read.csv(path, header=True, sep=";").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("slides", """
select p_partkey, p_name as t, p_brand as ed, '' as a from part""")
def slides(t):
    df = t.part.select(F.col("p_name").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("2020").alias("year"),
                       F.col("p_brand").alias("publisher"), F.lit("R").alias("shelfmark"), F.lit("x").alias("audience"), F.lit("y").alias("support"),
                       F.lit("a\nb").alias("abstract"), F.col("p_partkey").alias("identifier"), F.lit("u").alias("cover"))
    j = lambda p: F.get_json_object("value", "$." + p)
    return exports.slides(df).select(j("isbn").cast("bigint").alias("p_partkey"), j("t").alias("t"), j("ed").alias("ed"), j("a").alias("a"))


# --- streams --------------------------------------------------------------------------------------------------

def stream_of(t, name):
    return (t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t.folder))


def event_stream(t):
    return stream_of(t, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
                                         F.round(F.col("value") * 100).cast("bigint").alias("n"))


def finish(t, started):
    started.awaitTermination()
    if started.exception():
        raise RuntimeError(str(started.exception()))


HOURLY = f"""
with e as (select ts, round(value * 100)::bigint as n from events)
select strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%H:00') as hour, sum(n)::bigint as all_entries,
  sum(case when {OPEN} then n end)::bigint as open_entries from e where n > 0 group by 1, 2"""


@query("stream_footfall", HOURLY)
def stream_footfall(t):
    table = scratch(t.spark, "footfall")
    events = event_stream(t).withColumn("file", F.lit("2026-01"))
    finish(t, streams.stream_footfall(events, "ts", "n", table, scratch(t.spark, "check"), "file"))
    return streams.stored_footfall(t.spark, table)


@query("stream_hours", """
select strftime(ts, '%Y-%m-%d %H') as slot, sum(round(value * 100)::bigint)::bigint as all_entries from events
where round(value * 100)::bigint > 0 group by 1""")
def stream_hours(t):
    """Additive mode with a watermark; the final sums of each window are kept."""
    path, check = scratch(t.spark, "windows"), scratch(t.spark, "check")
    hours = streams.hourly_windows(event_stream(t), "ts", "n")
    def keep(batch, n):
        batch.write.mode("append").parquet(path)
    finish(t, hours.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep)
           .trigger(availableNow=True).start())
    out = t.spark.read.parquet(path).groupBy(F.date_format("slot.start", "yyyy-MM-dd HH").alias("slot"))
    return out.agg(F.max("all_entries").alias("all_entries"))


@query("stream_stocktake", """
select user_id as code, strftime(ts, '%Y-%m-%d') as day, count(*) as scans from events group by 1, 2""")
def stream_stocktake(t):
    table = scratch(t.spark, "scans")
    scans = event_stream(t).withColumnRenamed("user_id", "code")
    finish(t, streams.stream_stocktake(scans, "code", F.date_format("ts", "yyyy-MM-dd"), table, scratch(t.spark, "check")))
    return streams.stored_scans(t.spark, table, "code")


@query("stream_latest_status", """
select user_id, event_type as status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def stream_latest_status(t):
    table = scratch(t.spark, "status")
    finish(t, streams.stream_latest_status(event_stream(t), "user_id", "event_type", "ts", "event_id", table, scratch(t.spark, "check")))
    return streams.stored_status(t.spark, table, "user_id").select("user_id", "status")


@query("stream_usage_log", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1")
def stream_usage_log(t):
    table = scratch(t.spark, "log")
    finish(t, streams.append_usage_log(event_stream(t), table, scratch(t.spark, "check"), F.date_format("ts", "yyyy-MM-dd")))
    day = F.date_format(F.col("log_day").cast("date"), "yyyy-MM-dd").alias("day")
    return t.spark.read.parquet(table).groupBy(day).agg(F.count(F.lit(1)).alias("n"))


@query("stream_distinct", "select distinct user_id, event_type from events")
def stream_distinct(t):
    path = scratch(t.spark, "distinct")
    once = streams.distinct_within(event_stream(t), "ts", ["user_id", "event_type"]).select("user_id", "event_type")
    finish(t, once.writeStream.outputMode("append").format("parquet").option("path", path)
           .option("checkpointLocation", scratch(t.spark, "check")).trigger(availableNow=True).start())
    return t.spark.read.parquet(path)


@query("stream_suggestions", """
with k as (select lower(p_name) as title_key, p_partkey, row_number() over (partition by lower(p_name) order by p_partkey) as r from part)
select title_key, p_partkey from k where r = 1""")
def stream_suggestions(t):
    table = scratch(t.spark, "suggested")
    feed = stream_of(t, "part").select("p_partkey", F.col("p_name").alias("title"))
    finish(t, streams.stream_suggestions(feed, "title", "p_partkey", table, scratch(t.spark, "check")))
    return t.spark.read.parquet(table).select("title_key", "p_partkey")


# --- composite jobs ------------------------------------------------------------------------------------------------

def catalogue(t, records=None):
    """Titles of a catalogue derived from the parts, with loans."""
    records = parsed(t) if records is None else records
    loans = t.lineitem.groupBy(F.col("l_partkey").alias("record_id")).agg(F.sum("l_quantity").cast("bigint").alias("loans"))
    return marc.marc_to_titles(records, derive.SITE, derive.SCHEME).join(loans, "record_id", "left").withColumn(
        "loans", F.coalesce("loans", F.lit(0).cast("bigint")))


@query("acquisition_signals", """
select 'BD' as category, count(*) as titles, coalesce(sum(q), 0)::bigint as total_loans, round(sum(coalesce(q, 0)) / count(*), 1)::double as rotation
from part left join (select l_partkey, sum(l_quantity) as q from lineitem group by 1) on l_partkey = p_partkey where p_size % 2 = 0""")
def acquisition_signals(t):
    records = parsed(t)
    copies = marc.marc_to_copies(records, derive.SITE).withColumn("loans", F.lit(1))
    return jobs.acquisition_signals(catalogue(t, records), copies, 2026)["category_rotation"]


@query("loans_import", """
with c as (select l_partkey, count(*) as n from lineitem group by 1), h as (select c.*, p_size % 4 <> 0 as held from c join part on p_partkey = l_partkey)
select reason, sum(n)::bigint as rows from (select case when held then 'updated' else 'out_of_scope' end as reason, 1 as n from h
  union all select 'duplicate_in_file', n - 1 from h where n > 1) group by 1""")
def loans_import(t):
    rows = t.lineitem.select(
        F.concat(F.lit("978"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("raw_code"),
        F.concat(F.lit("978"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("ean"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("bigint").alias("total"))
    titles = catalogue(t).drop("record_id")
    return jobs.loans_import(rows, titles, "2026-08-05")["report"]


@query("enrichment")
def enrichment(t):
    """Order lines as answers of several sources for each order."""
    from shelfspark.plans.bind_matching import candidates
    none = F.lit(None).cast("string")
    cands = candidates(t).withColumnRenamed("id", "identifier").withColumnRenamed("prio", "priority").withColumn(
        "identifier", F.col("identifier").cast("string"))
    for c in ("illustrator", "type", "audience", "genre", "series", "volume", "pegi", "collection", "abstract"):
        cands = cands.withColumn(c, none)
    titles = t.orders.select(F.col("o_orderkey").cast("string").alias("identifier"), F.lit("LIVRE").alias("kind"))
    for c in ("enriched_on", "series", "volume", "category", "genre", "audience", "pegi", "illustrator", "collection", "abstract"):
        titles = titles.withColumn(c, none)
    return jobs.enrichment(titles, cands, "2026-08-05").select("identifier", "category", "genre", "audience", "pegi", "enriched_on")


@query("display_feed", """
select count(*) as slides from part where p_size % 4 <> 0 and p_size % 3 = 0""")
def display_feed(t):
    records = parsed(t)
    titles = marc.marc_to_titles(records, derive.SITE, derive.SCHEME)
    copies = marc.marc_to_copies(records, derive.SITE).withColumn("entered", F.lit("2026-07-01"))
    code = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    statuses = t.part.where(F.col("p_size") % 3 == 0).select(F.concat(F.lit("https://c/"), code, F.lit(".jpg")).alias("url"),
                                                             F.lit("image/jpeg").alias("content_type"), F.lit(4000).alias("size"))
    return jobs.display_feed(titles, copies, statuses, "2026-08-05", "https://c/{}.jpg").agg(F.count(F.lit(1)).alias("slides"))


@query("watch_lists", """
with k as (select '978' || lpad(p_partkey::varchar, 10, '0') as isbn, p_name || case when p_size % 2 = 0 then ' Tome ' || p_size else '' end as title,
             p_brand as author, case when p_size % 2 = 0 then ' — série ' || p_name || ' t.' || p_size else '' end as tail from part where p_size >= 25 and p_size <> 30),
 f as (select *, row_number() over (partition by lower(title) order by isbn) as r from k where lower(title) not in (select lower(p_name) from part where p_size = 30))
select title, author, isbn, 'Sélection de libraires : Prix' || tail as motive, 'À classer' as category, 'Tout public' as audience from f where r = 1""")
def watch_lists(t):
    """One list page per part linking to products; products of small parts are
    already held."""
    list_pages = derive.product_pages(t.part).select(F.col("p_partkey").alias("list_rank"), F.lit("Prix").alias("name"), "html")
    code = F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    products = derive.product_pages(t.part).select(code.alias("code"), "html")
    held = t.part.where(F.col("p_size") < 25).select(code.alias("identifier"))
    stored = t.part.where(F.col("p_size") == 30).select(F.col("p_name").alias("title"), code.alias("isbn"))
    out = jobs.watch_lists(list_pages, products, held, stored, "La Librairie", "Veille libraires")
    return out.select("title", "author", "isbn", "motive", "category", "audience")

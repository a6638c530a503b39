"""Rules on values that differ from row to row; the SQL computes the rule itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import text as X
from shelfspark.functions import vocab as V
from shelfspark.plans.registry import query


def text(name):
    return F.col(name).cast("string")


@query("parsed_columns", """
select o_orderkey, case when o_orderkey % 5 <> 0 then trunc(o_totalprice)::bigint end as whole,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d 10:05') else strftime(o_orderdate, '%Y-%m-%d') end as moment,
  case when o_orderkey % 4 <> 0 then year(o_orderdate)::varchar end as year,
  case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as day,
  case when o_orderkey % 4 in (0, 2) then lpad(o_orderkey::varchar, 13, '9') end as ean from orders""")
def parsed_columns(t):
    key, when, day = F.col("o_orderkey"), F.when, lambda f: F.date_format("o_orderdate", f)      # noqa: E731
    code = F.lpad(text("o_orderkey"), 13, "9")
    number = when(key % 5 == 0, F.concat(F.lit("n° "), text("o_totalprice"))).otherwise(F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice"), F.lit(" ")))
    moment = when(key % 7 == 0, day("yyyy.MM.dd")).when(key % 2 == 0, F.concat(day("dd/MM/yyyy"), F.lit(" 10:05"))).otherwise(day("dd/MM/yyyy"))
    year = when(key % 4 == 0, F.col("o_orderpriority")).when(key % 4 == 1, F.concat(F.lit("DL "), day("yyyy"))).otherwise(day("yyyy-MM-dd"))
    dated = when(key % 3 == 0, day("yyyy-MM-dd")).otherwise(F.concat(day("yyyyMMdd"), F.lit(" 12:00")))
    ean = when(key % 4 == 0, code).when(key % 4 == 1, F.substring(code, 1, 12)).when(key % 4 == 2, F.concat(F.lit(" "), code, F.lit(".0"))).otherwise(F.concat(F.substring(code, 1, 12), F.lit("X")))
    return t.orders.select(key, X.safe_int(number).alias("whole"), X.fr_datetime(moment).alias("moment"), X.pub_year(year).alias("year"),
                           X.yyyymmdd(dated).alias("day"), X.valid_ean(ean).alias("ean"))


@query("names_of_parts", """
select p_partkey, case p_size % 3 when 0 then 'BRAND' when 1 then '(sans cote)' else upper(regexp_extract(p_name, '^([A-Za-z]+)', 1)) end as zone,
  p_name as series, lower(p_name) as series_key, p_name || ', ' || p_brand as first_author,
  upper(substr(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), 1, 3)) as letters, 'https://x.org/list-' || p_partkey || '/' as url,
  upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) as list_name, case when p_size % 2 = 0 then p_size::varchar end as pegi from part""")
def names_of_parts(t):
    size, name = F.col("p_size"), F.col("p_name")
    mark = F.when(size % 3 == 0, F.concat(F.lit(" "), F.col("p_brand"))).when(size % 3 == 1, F.concat(text("p_size"), F.lit(" "), name)).otherwise(name)
    series = F.when(size % 2 == 0, F.concat(name, F.lit(" / "), F.col("p_brand"))).otherwise(F.concat(name, F.lit(" [BD]")))
    url = F.concat(F.lit("https://x.org/list-"), text("p_partkey"), F.when(size % 3 == 0, "?page=2").when(size % 3 == 1, "#top").otherwise("/"))
    listed = F.concat(F.lit("https://x.org/list-9/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit("/?page=2"))
    return t.part.select(
        "p_partkey", X.shelf_zone(mark).alias("zone"), X.series_name(series).alias("series"),
        X.series_key(F.concat(F.lit(" "), F.upper(name), F.lit(" ."))).alias("series_key"),
        X.author_first(F.concat(name, F.lit(", "), F.col("p_brand"), F.lit(" ; Zimmer"))).alias("first_author"),
        X.director_letters(F.concat(name, F.lit(", Ladj / Autre"))).alias("letters"), X.canonical_url(url).alias("url"),
        X.slug_title(listed).alias("list_name"), X.clean_pegi(F.when(size % 2 == 0, F.concat(F.lit("PEGI "), text("p_size"))).otherwise("tous")).alias("pegi"))


@query("manga_ratings", f"""
select p_partkey, case when p_size % 3 = 0 then 'Adolescent' when p_size >= {V.MANGA_ADULT_AGE} then 'Adulte' else 'Jeunesse' end as audience from part""")
def manga_ratings(t):
    size = F.col("p_size")
    rating = F.when(size % 3 == 1, F.concat(F.lit("PEGI "), text("p_size"))).when(size % 3 == 2, text("p_size"))
    return t.part.select("p_partkey", R.manga_audience(rating, F.lit("Ado (12+)")).alias("audience"))


_FORMS = list(V.AUDIENCE_FORMS.items())


@query("audience_forms", f"""
with f as (select unnest(range({len(_FORMS)})) as i, unnest([{', '.join("'" + k.replace("'", "''") + "'" for k, _ in _FORMS)}]) as form,
  unnest([{', '.join("'" + v.replace("'", "''") + "'" for _, v in _FORMS)}]) as audience)
select p_partkey, case p_size % 4 when 0 then 'Jeunesse' when 1 then p_type when 2 then f.audience end as audience, p_size % 4 = 0 as is_age,
  case when p_size % 4 = 0 then p_size || ' ans' end as age from part join f on i = p_partkey % {len(_FORMS)}""")
def audience_forms(t):
    """Ages, unknown values, every known form in upper case with blanks around it, and nothing."""
    size = F.col("p_size")
    form = F.get(F.array(*[F.lit(k) for k, _ in _FORMS]), (F.col("p_partkey") % len(_FORMS)).cast("int"))
    raw = (F.when(size % 4 == 0, F.concat(text("p_size"), F.lit(" ans"))).when(size % 4 == 1, F.col("p_type"))
           .when(size % 4 == 2, F.concat(F.lit("  "), F.upper(form), F.lit(" "))))
    df = t.part.select("p_partkey", raw.alias("audience"), F.coalesce(R.age_in_audience(raw), F.lit(False)).alias("is_age"), F.lit(None).cast("string").alias("age"))
    return R.move_age_then_normalise(df, "audience", "age")


@query("film_marks", """
with f as (select p_partkey, p_size % 5 as form, p_size % 6 = 0 as studio, p_size % 2 = 0 as adult,
   upper(substr(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), 1, 3)) as own from part),
 g as (select *, case form when 2 then 'BRA' when 3 then own end as letters from f)
select p_partkey, 'cote_absente' as anomaly from g where form = 0
union all select p_partkey, 'cote_non_conforme' from g where form = 1
union all select p_partkey, 'public_incoherent' from g where (form = 2 and not adult) or (form = 3 and adult)
union all select p_partkey, 'disney_mal_cote' from g where form in (2, 3) and studio and not (form = 3 and letters = 'DIS')
union all select p_partkey, 'lettres_discordantes' from g where form in (2, 3) and not studio and not (form = 3 and letters = 'DIS') and letters <> own
union all select p_partkey, 'fjdis_pas_disney' from g where form = 3 and not studio and letters = 'DIS'""")
def film_marks(t):
    """Film copies whose shelfmark follows, misses or contradicts the maker's name."""
    from shelfspark.operators.weeding import film_audit
    size, letters = F.col("p_size"), F.substring(F.regexp_replace("p_name", "[^A-Za-z]", ""), 1, 3)
    mark = (F.when(size % 5 == 1, F.col("p_brand")).when(size % 5 == 2, F.concat(F.lit("F "), F.substring("p_brand", 1, 3)))
            .when(size % 5 == 3, F.concat(F.lit("FJ "), letters)).when(size % 5 == 4, F.concat(text("p_size"), F.lit(".1 ABC"))))
    films = t.part.select("p_partkey", mark.alias("mark"), F.when(size % 6 == 0, "Disney Home").otherwise("Autre").alias("publisher"),
                          F.concat(F.col("p_name"), F.lit(", Jean")).alias("people"), F.when(size % 2 == 0, "Adulte").otherwise("Jeunesse").alias("audience"))
    return film_audit(films, "mark", "publisher", "people", "audience").select("p_partkey", "anomaly")

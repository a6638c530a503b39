"""Documents built by Spark from table rows: records, pages, feeds, responses.

They give the parsers an input that grows with the tables.  Rows are dealt over all cores first: a
document is much work, and the table behind a few million of them is a file or two.  Documents are
written by the tasks that build them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import materialise, spread

SUB, END, RECORD = "\x1f", "\x1e", "\x1d"


def sub(code: str, value) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(SUB + code), value)


def field(*subs: Column) -> Column:
    """Field content: indicators and subfields; NULL subfields are left out."""
    return F.concat(F.lit("  "), *[F.coalesce(s, F.lit("")) for s in subs])


def iso2709(df: DataFrame, key: str, fields: list[tuple[str, Column]]) -> DataFrame:
    """One record a row, in ``value`` beside ``key``; a NULL field is absent.

    Contents, sizes and places are columns, each made from the one before: expressions over an array
    of the fields are interpreted, and add up the sizes before each field anew."""
    places = range(len(fields))
    df = df.select(key, *[content.alias(f"_c{i}") for i, (_, content) in enumerate(fields)])
    df = df.select("*", *[F.coalesce(F.octet_length(f"_c{i}") + 1, F.lit(0)).alias(f"_n{i}") for i in places])
    starts = [F.lit(0)]
    for i in places:
        starts.append(starts[-1] + F.col(f"_n{i}"))
    df = df.select("*", *[start.alias(f"_s{i}") for i, start in enumerate(starts)])

    def digits(number, width):
        return F.lpad(number.cast("string"), width, "0")

    def there(i, *parts):
        return F.when(F.col(f"_c{i}").isNotNull(), F.concat(*parts)).otherwise(F.lit(""))
    listing = [there(i, F.lit(tag), digits(F.col(f"_n{i}"), 4), digits(F.col(f"_s{i}"), 5)) for i, (tag, _) in enumerate(fields)]
    body = [there(i, F.col(f"_c{i}"), F.lit(END)) for i in places]
    present = sum((F.col(f"_c{i}").isNotNull().cast("int") for i in places), F.lit(0))
    df = df.withColumn("_base", present * 12 + 25)
    total = F.col("_base") + F.col(f"_s{len(fields)}") + 1
    return df.select(key, F.concat(F.lit("\n"), digits(total, 5), F.lit("nam0 22"), digits(F.col("_base"), 5),
                                   F.lit("   450 "), *listing, F.lit(END), *body).alias("value"))


SITE, SCHEME = "Site A", "Centre d'intérêt"


def records(part: DataFrame, charset: str | None = None) -> DataFrame:
    """One catalogue record per part; with ``charset`` its values are bytes of that encoding."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    code = F.concat(F.lit("978"), F.lpad(key, 10, "0"))
    listed = [
        ("073", F.when(size % 4 != 0, field(sub("a", code)))),
        ("200", field(sub("a", F.col("p_name")), sub("e", "été"), F.when(size % 5 == 0, sub("h", size.cast("string"))))),
        ("700", field(sub("a", F.col("p_brand")), sub("b", "X"), sub("4", "070"))),
        ("702", field(sub("a", "Dessinateur"), sub("4", "440"))),
        ("210", field(sub("c", F.concat(F.col("p_type"), F.lit("."))), sub("d", F.concat(F.lit("DL "), (size + 1980).cast("string"))))),
        ("330", field(sub("a", "Résumé"), sub("a", "suite"))),
        ("461", F.when(size % 5 == 1, field(sub("t", F.concat(F.lit("Série / "), F.col("p_brand"))), F.when(size % 2 == 0, sub("v", "4"))))),
        ("606", field(sub("a", F.col("p_type")), sub("a", "mer"))),
        ("686", field(sub("l", F.when(size % 2 == 0, "Bandes dessinées").otherwise("Policier")), sub("2", SCHEME))),
        ("995", field(sub("a", "Site B"), sub("f", F.concat(F.lit("B"), key)), sub("w", "DVD"))),
        ("995", field(sub("a", SITE), sub("f", F.concat(F.lit("A"), key)), sub("k", F.concat(F.lit("R "), F.col("p_brand"))),
                      sub("l", "Jeune"), sub("w", "Imprimé"), sub("1", "20260805"))),
        ("995", F.when(size > 25, field(sub("a", SITE), sub("f", F.concat(F.lit("C"), key)), sub("w", "Imprimé"), sub("l", "Adulte")))),
    ]
    written = [(tag, F.encode(content, charset).cast("string") if charset else content) for tag, content in listed]
    dealt = spread(part).withColumn("record_id", F.col("p_partkey"))
    return materialise(iso2709(dealt, "record_id", written), "records")


def product_pages(part: DataFrame) -> DataFrame:
    """One product page per part, in four price forms."""
    size, price = F.col("p_size"), F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    comma = F.replace(F.substring((size + 10.5).cast("decimal(6,2)").cast("string"), 1, 6), F.lit("."), F.lit(","))
    priced = (F.when(size % 4 == 0, F.concat(F.lit('<span itemprop="price" content="'), price, F.lit('">')))
              .when(size % 4 == 1, F.concat(F.lit('{"price": "'), price, F.lit('"}')))
              .when(size % 4 == 2, F.concat(F.lit('<b>'), comma, F.lit(' €</b>'))).otherwise(F.lit("")))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.when(size % 2 == 0, F.concat(F.lit(" Tome "), size.cast("string"))).otherwise(""),
        F.lit(" - "), F.col("p_brand"), F.lit(" - Dupuis - Poche - La Librairie</title></head><body><h1>"), F.col("p_name"),
        F.lit(" &amp; co</h1>"), priced, F.lit('<a href="/livre/978'), F.lpad(F.col("p_partkey").cast("string"), 10, "0"),
        F.lit('/">lien</a><a href="/livre/9781111111111/x">autre</a><a href="/livre/978'), F.lpad(F.col("p_partkey").cast("string"), 10, "0"),
        F.lit('/">encore</a><ul><li>Éditeur : '), F.col("p_type"), F.lit("</li><li>Date de parution : 05/"),
        (size + 1980).cast("string"), F.lit("</li></ul></body></html>"))
    return materialise(spread(part).select("p_partkey", html.alias("html")), "pages")

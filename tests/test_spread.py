"""Work on records and texts does not depend on how many files their table has."""

from pyspark.sql import functions as F

from shelfspark.plans import derive
from shelfspark.plans.registry import QUERIES
from shelfspark.sources import marc


def one_part(spark):
    return spark.createDataFrame([(i, f"name {i}", "Brand", "TYPE", i % 50, 900.0) for i in range(40)],
                                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1)


def test_documents_are_dealt_over_the_cores(spark):
    for built in (derive.records(one_part(spark)), derive.product_pages(one_part(spark))):
        rows = built.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(rows) > spark.sparkContext.defaultParallelism // 2 and sum(r["count"] for r in rows) == 40


def test_parsers_of_a_table_in_one_file_use_all_cores(spark, tmp_path):
    import __spark_entry__  # noqa: F401  registers the queries
    one_part(spark).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("marcxml", "bibkeys_json", "title_parts"):
        parts = QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().count()
        assert parts > spark.sparkContext.defaultParallelism // 2, name


def test_filters_on_titles_and_copies_do_not_cut_records_again(spark):
    records = marc.parse_marc(derive.records(one_part(spark)), "value")
    for read, column in ((marc.marc_to_titles(records, derive.SITE, derive.SCHEME), "kind"), (marc.marc_to_copies(records, derive.SITE), "barcode")):
        plan = read.where(F.col("identifier").isNotNull() & (F.col(column) != "x"))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan


def test_titles_of_a_field_without_subfields(spark):
    """A field of indicators only has no subfields; the first piece never is one."""
    row = spark.range(1).select(marc._subfields(F.lit("  ")).alias("none"), marc._subfields(F.lit("  \x1fax\x1f\x1fb")).alias("two")).first()
    assert row["none"] == [] and [(s["code"], s["val"]) for s in row["two"]] == [("a", "x"), ("b", "")]


def test_responses_are_read_once(spark):
    """A stored response is read once, not for every value and filter that mentions what was read."""
    from shelfspark.sources import feeds
    xml = spark.createDataFrame([(1, '<record><datafield tag="200" ind1=" "><subfield code="a">T</subfield></datafield></record>'), (2, None)], "k int, xml string")
    out = feeds.parse_marcxml(xml, "xml")
    assert "from_xml" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r["k"], r["title"]) for r in out.collect()] == [(1, "T")]
    body = spark.createDataFrame([("1", '{"ISBN:1": {"title": "U"}}'), ("2", "{}")], "isbn string, body string")
    out = feeds.parse_bibkeys_json(body, "body", "isbn")
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r["isbn"], r["title"]) for r in out.collect()] == [("1", "U")]


def test_expressions_given_to_helpers_are_evaluated_once(spark):
    from shelfspark.functions import text
    from shelfspark.functions.rules import normalise_audience
    from shelfspark.sources.pages import unescape_html
    df = spark.createDataFrame([("Été &amp; œuvre",), ("",), (None,)], "c string")
    costly = F.regexp_extract("c", "(?s)(.*)", 1)
    for helper in (text.none_if_empty, text.strip_accents, unescape_html, normalise_audience):
        assert str(helper(costly)).count("regexp_extract(c") == 1, helper.__name__
    got = df.select(text.none_if_empty(costly).alias("n"), text.strip_accents(costly).alias("s"), unescape_html(costly).alias("u")).collect()
    assert [tuple(r) for r in got] == [("Été &amp; œuvre", "Ete &amp; œuvre", "Été & œuvre"), (None, "", ""), (None, None, None)]


def test_audience_forms_written_plainly_need_no_folding(spark):
    """The forms of the table are what folding makes of them, so a value equal to one but for
    capitals may skip it."""
    from shelfspark.functions import text
    from shelfspark.functions import vocab as V
    forms = spark.createDataFrame([(k,) for k in V.AUDIENCE_FORMS], "c string")
    assert all(V.AUDIENCE_FORMS.values())
    assert [r.k for r in forms.select(text.fold_key("c").alias("k")).collect()] == list(V.AUDIENCE_FORMS)


def test_values_of_a_copy_are_read_in_one_walk(spark):
    """The last value of a code counts, the first copy with an audience gives the title's."""
    def copy(*subs):
        return ("995", [*subs])
    df = spark.createDataFrame([(1, [copy(("a", "S"), ("f", "A"), ("f", "B"), ("l", "")), copy(("a", "T"), ("l", "Adulte")),
                                     copy(("a", "T"), ("a", "S"), ("l", "JEUNE "), ("w", "Jeu")), copy(("f", "C"))])],
                               "record_id long, fields array<struct<tag: string, sub: array<struct<code: string, val: string>>>>")
    title = marc.marc_to_titles(df, "S", "x").first()
    assert (title.identifier, title.audience, title.kind) == ("CB:B", "Jeunesse", "JEU")
    assert [(r.barcode, r.audience) for r in marc.marc_to_copies(df, "S").orderBy("copy_pos").collect()] == [("B", ""), (None, "Jeunesse")]
    assert str(marc.local_copies("S")).count("filter(") <= 2

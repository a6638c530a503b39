"""Records are built, read and dealt with work that follows their number alone."""

from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.plans import derive
from shelfspark.sources import marc


def parsed(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, name string, bare string, site string, audience string")
    fields = [("200", derive.field(derive.sub("a", F.col("name")))), ("330", F.col("bare")),
              ("995", derive.field(derive.sub("a", F.col("site")), derive.sub("f", F.lit("B1")), derive.sub("l", F.col("audience")))),
              ("995", F.when(F.col("audience").isNotNull(), derive.field(derive.sub("a", F.col("site")), derive.sub("l", "adulte"))))]
    return marc.parse_marc(derive.iso2709(df, "record_id", fields), "value")


ROWS = [(1, "été", "  ", "S", "Jeune"), (2, "œuf", None, "T", "Jeune"), (3, "", None, "S", None)]


def test_records_are_built_without_interpreted_arrays(spark):
    df = derive.iso2709(spark.createDataFrame([(7, "été", None), (8, None, None)], "k long, a string, b string"), "k", [("200", F.col("a")), ("330", F.col("b")), ("700", F.lit("xy"))])
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["value"] for r in df.orderBy("k").collect()] == [
        "\n00059nam0 2200049   450 200000600000700000300006\x1eété\x1exy\x1e",
        "\n00041nam0 2200037   450 700000300000\x1exy\x1e"]


def test_copies_cut_records_once(spark, monkeypatch):
    """An inferred filter on the copies would cut every record a second time."""
    monkeypatch.setattr(marc, "materialise", lambda df, label: df)
    copies = marc.marc_to_copies(parsed(spark, ROWS), "S")
    plan = copies._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]
    assert plan.count("map_from_entries") == 1
    assert [(r.record_id, r.copy_pos, r.barcode, r.audience) for r in copies.orderBy("record_id", "copy_pos").collect()] == [
        (1, 0, "B1", "Jeunesse"), (1, 1, None, "Adulte"), (3, 0, "B1", None)]


def test_titles_evaluate_codes_outside_arrays(spark, monkeypatch):
    """Values mentioned several times are columns; an array made to hold one is interpreted."""
    monkeypatch.setattr(marc, "materialise", lambda df, label: df)
    titles = marc.marc_to_titles(parsed(spark, ROWS), "S", "x")
    assert "array(regexp_replace" not in titles._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.identifier, r.title, r.audience, r.abstract) for r in titles.orderBy("record_id").collect()] == [
        ("CB:B1", "été", "Jeunesse", None), (None, "œuf", None, None), ("CB:B1", "", None, None)]


def test_stored_rows_are_read_in_as_many_tasks_as_dealt(spark):
    before = spark.conf.get(session.READ_PARTS, None)
    try:
        spark.conf.unset(session.READ_PARTS)
        session.read_widely(spark)
        stored = session.materialise(session.spread(spark.range(5000)), "dealt")
        assert stored.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        spark.conf.set(session.READ_PARTS, 3)
        assert session.read_widely(spark).conf.get(session.READ_PARTS) == "3"
    finally:
        spark.conf.unset(session.READ_PARTS) if before is None else spark.conf.set(session.READ_PARTS, before)


def test_values_of_a_record_are_mapped_by_their_use(spark):
    """Last values, empty ones too, and first values that are not empty, each of their own fields."""
    df = spark.createDataFrame([(1, [("200", [("a", "x"), ("a", "")]), ("214", [("c", ""), ("c", "new")]), ("210", [("c", "old"), ("d", "1")])])],
                               "record_id long, fields array<struct<tag string, sub array<struct<code string, val string>>>>")
    row = marc.with_values(df, ("200",), ("210", "214")).first()
    assert row["_last"] == {"200a": ""} and row["_first"] == {"210c": "new", "210d": "1"}


def test_report_joins_codes_to_titles_once(spark):
    """Firsts and repeats of a code are outcomes of one pass; each was a join of all codes."""
    from shelfspark.operators import audit
    rows = spark.createDataFrame([("a", "a", 1), ("a", "a", 2), ("b", "b", 3), ("x", None, 4), (None, None, 5)], "raw string, code string, pos int")
    known = spark.createDataFrame([("a",), ("a",), ("c",)], "identifier string")
    report = audit.import_report(rows, "raw", "code", "pos", known, "identifier")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r["reason"]: r["rows"] for r in report.collect()} == {
        "updated": 1, "out_of_scope": 1, "duplicate_in_file": 1, "invalid_identifier": 1, "no_identifier": 1}

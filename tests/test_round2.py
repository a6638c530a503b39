"""Cases that fixtures lack: complete parsing, file order, streams cut differently, long series."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions.text import fold_text
from shelfspark.operators import filters, holdings, keyed
from shelfspark.session import shared_dir
from shelfspark.sources import marc, pages
from shelfspark.streaming import jobs as streams
from test_files import _record


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("written, read", [
    ("&apos;&check;&#128512;&#x1F600;", "'✓😀😀"), ("&eacute;&amp;&nothing; &", "é&&nothing; &"), ("&#55296; &#9999999;", "&#55296; &#9999999;"), ("&NotEqualTilde;", "≂̸")])
def test_character_references(spark, written, read):
    assert one(spark, pages.unescape_html("h"), h=written) == read


def test_value_behind_a_long_label(spark):
    label = "Éditeur " + "x" * 60
    assert one(spark, pages._labelled(F.col("h"), ["Éditeur"]), h=f"<li>{label} : Dupuis</li>") == "Dupuis"


@pytest.mark.parametrize("text, folded", [("Ⅳ ⅓ ŉ", "iv 1 3 n"), ("Été ﬁn №5", "ete fin no5"), ("㎏", "kg"), ("plain", "plain")])
def test_every_decomposition_is_applied(spark, text, folded):
    assert one(spark, fold_text("t"), t=text) == folded


def test_links_as_a_browser_sees_them(spark):
    html = ("<a class=x href='/q'>one</a><A HREF=../up.html>two</A><a href=\"./here/../there?x=../y#z\">three</a><a data-href=\"/no\">none</a>"
            "<a href='mailto:x'>m</a><a href=\"/q\">one</a>")
    df = spark.createDataFrame([(1, "https://a.example/b/c/d.html", html)], "id int, url string, html string")
    got = {(r["link"], r["label"]) for r in pages.extract_links(df, "id", "url", "html").collect()}
    assert got == {("https://a.example/q", "one"), ("https://a.example/b/up.html", "two"), ("https://a.example/b/c/there?x=../y", "three")}


def test_long_series_is_listed_whole(spark):
    n = 100_000
    rows = spark.range(1, n + 1).where("id <> 7").select(F.lit("s").alias("series"), F.col("id").cast("string").alias("volume"), F.lit(1).alias("loans"))
    listed = holdings.listed_volumes(rows, "series", "volume", "loans")
    assert listed.agg(F.sum(F.size(F.split("volumes", ",")))).first()[0] == n - 1
    assert listed.agg(F.max(F.size(F.split("volumes", ",")))).first()[0] <= 500


def test_fields_are_cut_by_the_directory(spark):
    """A stray terminator inside a field and a stored field that the directory omits."""
    whole = _record([("100", "  \x1faX"), ("200", "1 \x1faÉté\x1e stray"), ("700", "  \x1faNom")])
    df = spark.createDataFrame([(1, whole)], "record_id int, value string")
    got = {r["tag"]: r["sub"][0]["val"] for r in marc.marc_fields(marc.parse_marc(df, "value")).collect()}
    assert got == {"100": "X", "200": "Été\x1e stray", "700": "Nom"}
    base, listing = int(whole[12:17]), whole[24:int(whole[12:17]) - 1]
    shorter = whole[:12] + f"{base - 12:05d}" + whole[17:24] + listing[12:] + whole[base - 1:]
    df = spark.createDataFrame([(1, shorter)], "record_id int, value string")
    assert {r["tag"] for r in marc.marc_fields(marc.parse_marc(df, "value")).collect()} == {"200", "700"}


def test_records_follow_files_and_places(spark, tmp_path):
    for name, first, count in (("a", 0, 2), ("b", 100, 400)):
        (tmp_path / f"{name}.mrc").write_text("".join(_record([("200", f"  \x1fa{first + i}")]) for i in range(count)), encoding="utf-8")
    rows = marc.read_marc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [int(r["fields"][0]["sub"][0]["val"]) for r in rows] == [0, 1, *range(100, 500)]


def test_bytes_of_another_encoding_shift_nothing(spark, tmp_path):
    """The directory counts bytes; a Latin-1 record read as UTF-8 loses its accents and no letter."""
    fields = [("200", "1 \x1faL'\xe9t\xe9 \xe0 No\xebl"), ("700", "  \x1faHergenroth\x1fbAnna"), ("073", "  \x1fa9781234567897")]
    raw = _record(fields).encode("latin-1")
    entries, body = b"", b""
    for tag, content in fields:
        data = content.encode("latin-1") + b"\x1e"
        entries += f"{tag}{len(data):04d}{len(body):05d}".encode()
        body += data
    base = 24 + len(entries) + 1
    raw = f"{base + len(body) + 1:05d}nam0 22{base:05d}   450 ".encode() + entries + b"\x1e" + body + b"\x1d"
    (tmp_path / "one.mrc").write_bytes(b"\n\n" + raw + raw + b"\n" + b"12345 no leader" + b"\x1d")
    want = {None: "L'\ufffdt\ufffd \ufffd No\ufffdl", "ISO-8859-1": "L'été à Noël"}
    for encoding, title in want.items():
        rows = marc.marc_to_titles(marc.read_marc(spark, str(tmp_path), encoding), "S", "x").collect()
        assert [(r.title, r.author, r.identifier) for r in rows] == [(title, "Hergenroth", "9781234567897")] * 2


def test_never_lent_with_missing_loans(spark):
    got = one(spark, R.weeding_class(F.lit(None).cast("string"), F.lit("BD"), F.lit("Adulte"), F.lit(20), F.lit(None).cast("int"), F.lit(None).cast("int"), 2026))
    assert got is not None and got["class"] == "BD-manga jamais prêtées"


def _cut(spark, tmp_path, name, parts, schema):
    """A stream whose micro-batches are the given lists of rows."""
    folder = tmp_path / name
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_streams_do_not_depend_on_the_cut(spark, tmp_path):
    schema = "ts timestamp, n bigint, file string, code string, tie int"
    rows = spark.sql("""select timestamp'2026-05-05 10:10:00' ts, 5L n, 'f1' file, 'A' code, 1 tie union all select timestamp'2026-05-05 10:50:00', 7L, 'f1', 'A', 2
        union all select timestamp'2026-05-05 10:20:00', 4L, 'f2', 'B', 3 union all select timestamp'2026-05-05 11:20:00', 9L, 'f1', 'B', 4""").collect()
    results = []
    for name, parts in (("single", [rows]), ("many", [[r] for r in rows])):
        stream = lambda: _cut(spark, tmp_path, f"{name}-{len(list(tmp_path.iterdir()))}", parts, schema)      # noqa: E731
        paths = [str(tmp_path / f"{name}-{x}") for x in ("hours", "c1", "scans", "c2", "status", "c3")]
        streams.stream_footfall(stream(), "ts", "n", paths[0], paths[1], "file").awaitTermination()
        streams.stream_stocktake(stream(), "code", F.date_format("ts", "yyyy-MM-dd"), paths[2], paths[3]).awaitTermination()
        streams.stream_latest_status(stream(), "code", "file", "ts", "tie", paths[4], paths[5]).awaitTermination()
        results.append([sorted(tuple(r) for r in df.collect()) for df in (
            streams.stored_footfall(spark, paths[0]), streams.stored_scans(spark, paths[2], "code"), streams.stored_status(spark, paths[4], "code").select("code", "status"))])
    assert results[0] == results[1]
    assert results[0][0] == [("2026-05-05", "10:00", 4, 4), ("2026-05-05", "11:00", 9, 9)]
    assert results[0][1] == [("A", "2026-05-05", 2), ("B", "2026-05-05", 2)] and results[0][2] == [("A", "f1"), ("B", "f1")]


def test_first_and_mode_need_no_join(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), ("b", 6, "z"), ("a", 3, "y")], "k string, o int, v string")
    first = keyed.first_with_ignored(df, ["k"], ["o"])
    assert sorted(map(tuple, first.collect())) == [("a", 1, "y", 2), ("b", 5, None, 1)]
    mode = keyed.modal_values(df, "k", "v")
    assert sorted(map(tuple, mode.collect())) == [("a", "y", 3, 2), ("b", "z", 2, 2)]
    assert all("Join" not in x._jdf.queryExecution().toString() for x in (first, mode))


def test_places_of_every_row(spark):
    df = spark.createDataFrame([(3, None), (1, "b"), (2, "a")], "id int, mark string")
    assert sorted(tuple(r) for r in filters.placed(df, filters.by_shelf("mark", "id")).select("place", "id").collect()) == [(1, 2), (2, 1), (3, 3)]


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None
    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_majority_form_keeps_ties_small(spark):
    df = spark.createDataFrame([("s", "b"), ("s", "a")], "g string, v string")
    assert keyed.modal_values(df, "g", "v").first()["modal"] == "a"

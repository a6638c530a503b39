"""Delimited files, records out of order, keyed replacement, exports."""

from pyspark.sql import functions as F

from shelfspark.operators import audit, footfall, stocktake
from shelfspark.sinks import exports
from shelfspark.sources import files, marc


def test_footfall_dialects(spark, tmp_path):
    old = tmp_path / "old.csv"
    old.write_text("sep=;\nDATE;IN;HOUR\n2026-07-06;5;9:59\n2026-07-06;7;10:00\n2026-07-06;3;18:30\n2026-07-06;0;11:00\n"
                   "2026-05-04;4;11:00\n2026-05-05;6;\n2026-05-05;2;17:59\n2026-05-05;1;18:00\n", encoding="utf-8")
    new = tmp_path / "new.csv"
    new.write_text("Date;Entrées;Heure\n2026-05-05;8;10:15\n", encoding="utf-8")
    rows = files.read_footfall(spark, str(old)).unionByName(files.read_footfall(spark, str(new)))
    days = {r.day: (r.all_entries, r.open_entries) for r in footfall.daily(rows, "ts", "entries").collect()}
    # Monday is open in July only
    assert days == {"2026-07-06": (15, 10), "2026-05-04": (4, None), "2026-05-05": (11, 10)}
    hours = footfall.hourly(rows, "ts", "entries")
    assert footfall.day_reconciliation(footfall.daily(rows, "ts", "entries"), hours).count() == 0


def test_loans_layouts(spark, tmp_path):
    per_title = tmp_path / "titles - 2026-07-01.csv"
    per_title.write_text("\nEAN / ISBN;Nombre de prêts total;Date de dernier prêt\n9781234567890;12;03/02/2024 10:05\n"
                         "978;4;\n;3;\n9781234567890;9;\n9780000000002;Aucune donnée disponible;01/01/2020\n", encoding="utf-8")
    kind, rows = files.read_loans(spark, str(per_title))
    assert kind == "title"
    assert {(r.raw_code, r.ean, r.total, r.last_loan) for r in rows.collect()} == {
        ("9781234567890", "9781234567890", 12, "2024-02-03 10:05"), ("978", None, 4, None), (None, None, 3, None),
        ("9781234567890", "9781234567890", 9, None), ("9780000000002", "9780000000002", None, "2020-01-01")}
    known = spark.createDataFrame([("9781234567890",)], "identifier string")
    report = {r.reason: r.rows for r in audit.import_report(rows, "raw_code", "ean", "pos", known, "identifier").collect()}
    assert report == {"no_identifier": 1, "invalid_identifier": 1, "duplicate_in_file": 1, "updated": 1, "out_of_scope": 1}
    per_copy = tmp_path / "copies.csv"
    per_copy.write_text("Code-barres de l'exemplaire;Nombre de prêts total (ex);Année du dernier prêt\nA1;3.0;2021.0\nA2;;-Non Précisé-\n",
                        encoding="utf-8")
    kind, rows = files.read_loans(spark, str(per_copy))
    assert kind == "copy"
    assert {tuple(r) for r in rows.collect()} == {("A1", 3, "2021"), ("A2", None, None)}


def _record(entries):
    """entries: (tag, content) in directory order; stored in reverse order."""
    stored, start, place = "", 0, {}
    for i, (tag, content) in reversed(list(enumerate(entries))):
        size = len(content.encode()) + 1
        place[i] = (tag, size, start)
        stored += content + "\x1e"
        start += size
    listing = "".join(f"{t}{n:04d}{s:05d}" for t, n, s in (place[i] for i in range(len(entries))))
    base = 24 + len(listing) + 1
    return f"{base + start + 1:05d}nam0 22{base:05d}   450 " + listing + "\x1e" + stored + "\x1d"


def test_marc_directory_order_and_filler(spark, tmp_path):
    a = _record([("073", "  \x1fa9781234567890"), ("200", "1 \x1faÉté\x1feun \x1fh"), ("700", "  \x1faNom\x1fbX"),
                 ("701", "  \x1faAutre\x1f4070"), ("995", "  \x1faS\x1ff1\x1fwDVD")])
    b = _record([("010", "  \x1fa2-07-054127-4"), ("200", "1 \x1faB"), ("995", "  \x1faT\x1ff2")])
    path = tmp_path / "Liste - 2026-06-27.mrc"
    path.write_bytes((a + "\n\r " + b + "\n" + "bad leader here and nothing else\x1d").encode())
    records = marc.read_marc(spark, str(path))
    fields = marc.marc_fields(records).orderBy("record_id", "pos").select("tag").collect()
    assert [r.tag for r in fields] == ["073", "200", "700", "701", "995", "010", "200", "995"]
    titles = {r.identifier: r for r in marc.marc_to_titles(records, "S", "x").collect()}
    assert set(titles) == {"9781234567890", "9782070541270"}
    first = titles["9781234567890"]
    assert (first.title, first.author, first.kind, first.subtitle) == ("Été", "Autre", "DVD", "un ")
    assert marc.marc_to_copies(records, "S").count() == 1


def test_upsert_replaces_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", "m1", 1, 1), ("b", "m1", 2, 2), ("c", "m2", 3, 3)], "k string, month string, v int, w int")
    exports.upsert(spark, path, first, ["k"], ["v"], partition="month")
    before = {p.name for p in (tmp_path / "t" / "month=m2").glob("part*")}
    again = spark.createDataFrame([("a", "m1", 9, 9), ("d", "m1", 4, 4)], first.schema)
    for _ in range(2):
        exports.upsert(spark, path, again, ["k"], ["v"], partition="month")
    got = {(r.k, r.month, r.v, r.w) for r in spark.read.parquet(path).collect()}
    assert got == {("a", "m1", 9, 1), ("b", "m1", 2, 2), ("c", "m2", 3, 3), ("d", "m1", 4, 4)}
    assert before == {p.name for p in (tmp_path / "t" / "month=m2").glob("part*")}


def test_scan_memory(spark):
    lines = spark.createDataFrame([("# comment",), ("A\t2\t2026-01-01;2026-01-01",), ("B\t2026-01-02",)], "value string")
    memory = stocktake.read_memory(lines)
    scans = spark.createDataFrame([("A",)] * 3 + [("C",)] * 2 + [("B",)], "code string")
    out = {r.code: (r.n, r.status, [tuple(d) for d in r.dates]) for r in stocktake.scan_delta(scans, memory, "code", "2026-08-05").collect()}
    assert out == {"A": (3, "seen again", [("2026-01-01", 2), ("2026-08-05", 1)]), "B": (1, "unchanged", [("2026-01-02", 1)]),
                   "C": (2, "new", [("2026-08-05", 2)])}


def test_exports(spark, tmp_path):
    basket = spark.createDataFrame([("2", "b", "c", "s", "10"), ("1", "a", "c", "s", "2")], "ean string, origin string, category string, series string, volume string")
    exports.export_order(basket, str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "order_txt")).collect()] == ["1", "2"]
    exports.export_inventory(basket.withColumnRenamed("ean", "barcode").withColumn("title", F.lit("t")), str(tmp_path / "inv"))
    back = spark.read.csv(str(tmp_path / "inv"), header=True, sep=";")
    assert back.columns[:4] == ["Identifiant", "Code-barres", "Cote", "Titre"] and back.count() == 2


def test_route_and_copy(spark, tmp_path):
    for name in ("Liste - 2026-01-01.mrc", "Liste - 2026-02-01.mrc", "x.csv", "y.txt"):
        (tmp_path / name).write_text("x")
    routed = {r.feed: r for r in files.route_inputs(files.list_files(spark, str(tmp_path))).collect()}
    assert set(routed) == {"catalogue", "footfall"} and routed["catalogue"].files == 2
    spark.range(3).write.parquet(str(tmp_path / "src" / "a.parquet"))
    assert files.copy_tables(spark, str(tmp_path / "src"), str(tmp_path / "dst"), ["a", "absent"]) == ["a"]

"""Files in, files out: types, text forms, discovery, import and row identity."""

import csv
import glob
import io
import itertools
import os
import random
import sqlite3
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanframe import ROWID, Pager, discover, export_csv, import_entities, load, scan
from gleanframe.session import shared_folder
from gleanframe.sources.records import count_records, ends_inside, layout, records
from suite.writers import MAIN, OFFICE, PACKAGE, _write, save_workbook


def _types(df):
    return dict(df.dtypes)


def _save(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# ---- CSV and Parquet ----------------------------------------------------------------------------


def test_csv_types_and_nulls(spark, tmp_path):
    path = _save(
        tmp_path / "t.csv",
        "id,amount,flag,day,at,clock,name\n"
        "1,2.5,true,2024-01-15,2024-01-15 10:00:00,10:15:00,Ann\n"
        '2,,false,2024-01-16,2024-01-15 10:00:00.25,11:00:00,""\n'
        '3,7,,,,,"say ""hi"", ok"\n',
    )
    df = scan(spark, path)
    types = _types(df)
    assert types.pop("id") in ("int", "bigint")
    assert types == {
        "amount": "double",
        "flag": "boolean",
        "day": "date",
        "at": "timestamp_ntz",
        "clock": "string",
        "name": "string",
    }
    rows = df.orderBy("id").collect()
    assert rows[1].amount is None and rows[1].name is None
    assert rows[2].name == 'say "hi", ok' and rows[2].day is None
    assert rows[0].clock == "10:15:00" and rows[1].at.microsecond == 250000


def test_csv_with_line_breaks_in_fields(spark, tmp_path):
    path = _save(tmp_path / "t.csv", 'id,note\n1,"two\nlines"\n2,plain\n3,"a\n\n""b"",\nc"\n')
    for options in ({}, {"multiline": True}):
        rows = scan(spark, path, **options).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "plain"), (3, 'a\n\n"b",\nc')]
    assert discover(spark, path).first().row_count == 3


@pytest.mark.parametrize("bytes_per_task", [7, 40, 1 << 20])
def test_records_are_cut_by_many_tasks(spark, tmp_path, bytes_per_task):
    rng = random.Random(bytes_per_task)
    word = lambda: "".join(rng.choice(['"', "\n", ",", "a", "é", " ", ";", "\n\n"]) for _ in range(rng.randint(0, 12)))
    files = {f"f{k}.csv": [(str(i), word(), word()) for i in range(k * 100, k * 100 + rng.randint(0, 40))] for k in range(3)}
    for name, rows in files.items():
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as out:
            csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if name == "f1.csv" else csv.QUOTE_MINIMAL).writerows([("id", "a", "b"), *rows])
    want = [r for name in sorted(files) for r in files[name]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_task)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = layout(spark, str(tmp_path), ",", '"')
        assert len(found.blocks) >= (30 if bytes_per_task == 7 else 3)
        assert found.records - found.files == len(want) == count_records(spark, str(tmp_path), ",", '"')
        cut = records(spark, str(tmp_path), found, ",", '"').where("NOT first").orderBy("file", "block", "at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [tuple(next(csv.reader(io.StringIO(r.text, newline="")))) for r in cut] == want


def test_multi_line_files_keep_their_order_and_names(spark, tmp_path):
    body = "".join(f'{i},"line {i}\nmore",{i / 2}\n' for i in range(3000))
    path = _save(tmp_path / "t.csv", f'id,,id\n{body}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        frame = load(spark, path, "lines").frame
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert frame.columns == [ROWID, "id0", "_c1", "id2"]
    rows = frame.orderBy(ROWID).collect()
    assert [(r.id0, r._c1, r.id2) for r in rows] == [(i, f"line {i}\nmore", i / 2) for i in range(3000)]


def test_state_behind_a_line():
    for line, inside, want in [
        ('a,"b', False, True), ('a,"b"', False, False), ('a,b"c', False, False), ('x",y', True, False), ('x"",y', True, True),
        ('x"",y"', True, False), ('x""","z', True, True), ('x",y"z,"', True, True), ("", True, True), ("", False, False), ('"', False, True), ('""', False, False),
    ]:
        assert ends_inside(line, inside, ",", '"') is want, line


def test_days_that_may_be_months_stay_text(spark, tmp_path):
    path = _save(tmp_path / "t.csv", "a,b,c,d\n03/04/2024,13/04/2024,03-04-2024,03.04.2024\n05/06/2024,01/02/2024,05-06-2024,05.06.2024\n")
    types = _types(scan(spark, path))
    assert types == {"a": "string", "b": "date", "c": "string", "d": "date"}
    assert str(scan(spark, path, date_format="MM/dd/yyyy", schema="a date, b string, c string, d string", delimiter=",").first().a) == "2024-03-04"


def test_csv_with_stray_quotes_is_split(spark, tmp_path):
    path = _save(tmp_path / "t.csv", 'id,note\n1,5" pipe\n2,"a ""b"" c"\n3,6"" x\n')
    assert [r.note for r in scan(spark, path).orderBy("id").collect()] == ['5" pipe', 'a "b" c', '6"" x']


@pytest.mark.parametrize("delimiter", [";", "\t", "|", ","])
def test_csv_dialects(spark, tmp_path, delimiter):
    lines = ["id;day;us;name;when", '1;31/01/2024;01/31/2024;"a;b,c|d";x', "2;01/02/2024;02/01/2024;e, f;31/02/2024", "3;;;;"]
    path = _save(tmp_path / "t.csv", "\n".join(x.replace(";", delimiter) for x in lines) + "\n")
    if delimiter == ",":
        path = _save(tmp_path / "t.csv", "\n".join(x.replace("e, f", "e f").replace(";", ",") for x in lines) + "\n")
    df = scan(spark, path)
    assert df.columns == ["id", "day", "us", "name", "when"]
    assert (_types(df)["day"], _types(df)["us"], _types(df)["when"]) == ("date", "date", "string")
    first, second, last = df.orderBy("id").collect()
    assert str(first.day) == "2024-01-31" == str(first.us) and str(second.day) == "2024-02-01" == str(second.us)
    assert first.name == "a;b,c|d".replace(";", delimiter) and last.day is None


def test_csv_options_are_taken_as_given(spark, tmp_path):
    path = _save(tmp_path / "t.csv", "a;b\n1;'x;y'\n")
    row = scan(spark, path, schema="a int, b string", delimiter=";", quote="'", multiline=False).first()
    assert tuple(row) == (1, "x;y")
    path = _save(tmp_path / "d.csv", "d\n2024|31|01\n")
    assert str(scan(spark, path, schema="d date", delimiter=",", date_format="yyyy|dd|MM").first().d) == "2024-01-31"


def test_csv_value_that_does_not_fit_fails(spark, tmp_path):
    path = _save(tmp_path / "t.csv", "id\n1\nx\n")
    assert [r.id for r in scan(spark, path).collect()] == ["1", "x"]
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE|malformed|FAILFAST"):
        scan(spark, path, schema="id int").collect()


def test_discover_and_import_single_tables(spark, tides, tmp_path):
    path = _save(tmp_path / "tiny.csv", "id,name\n1,a\n2,b\n")
    assert tuple(discover(spark, path).first())[1:] == ("data", "dataset", 2)
    (dataset,) = import_entities(spark, path)
    assert (dataset.name, dataset.view, dataset.row_count) == ("tiny.csv", "tiny_csv", 2)
    assert dataset.columns == {"id": "integer", "name": "string"}
    assert spark.table("tiny_csv").columns == ["id", "name"]
    dataset.remove()
    assert not spark.catalog.tableExists("tiny_csv")
    folder = str(tmp_path / "tides.parquet")
    tides.write.parquet(folder)
    assert load(spark, folder, "marks").row_count == 52
    with pytest.raises(ValueError, match="Unsupported file format: .txt"):
        scan(spark, "x.txt")


def test_rows_keep_file_order(spark, tmp_path):
    path = _save(tmp_path / "t.csv", "n\n" + "".join(f"{i}\n" for i in range(50)))
    dataset = load(spark, path, "ordered")
    assert [r.n for r in Pager(dataset.frame, size=50).fetch().rows] == list(range(50))
    with pytest.raises(ValueError, match=f"already named {ROWID}"):
        load(spark, dataset.frame.inputFiles()[0], "again", "parquet")


def test_export_text_and_order(spark, tides, tmp_path):
    rows = tides.repartition(4).withColumn(ROWID, F.col("id")).withColumn("at", F.col("taken").cast("timestamp_ntz"))
    out = str(tmp_path / "out")
    export_csv(rows, out, [{"column": "gauge", "operator": "!=", "value": "Float 1"}], "level", "desc")
    lines = []
    for part in sorted(glob.glob(f"{out}/part-*")):
        header, *body = open(part, encoding="utf-8").read().splitlines()
        assert header == "id,harbour,gauge,level,samples,taken,sky,observer,checked,at"
        lines += [line.split(",") for line in body]
    levels = [float(line[3]) if line[3] else None for line in lines]
    assert levels[-1] is None and levels[:-1] == sorted(levels[:-1], reverse=True)
    assert len(lines) == tides.where("gauge <> 'Float 1'").count()
    by_id = {line[0]: line for line in lines}
    assert by_id["1"][8] == "True" and by_id["2"][8] == "False" and by_id["49"][6] == ""
    assert by_id["1"][9] == "2023-01-04 00:00:00"
    with pytest.raises(ValueError, match="Invalid sort column: nope"):
        export_csv(tides, out, sort="nope")


def test_export_keeps_awkward_text(spark, tmp_path):
    texts = ['a "b"', "x,y", "two\nlines", "  padded ", "back\\slash", "é"]
    df = spark.createDataFrame([(i, t, 1e8 + 0.5) for i, t in enumerate(texts)], f"{ROWID} int, t string, x double")
    out = str(tmp_path / "out")
    export_csv(df, out)
    back = load(spark, out, "awkward", "csv", schema="t string, x double", multiline=True).frame
    assert [r.t for r in back.orderBy(ROWID).collect()] == texts
    assert "100000000.5" in open(glob.glob(f"{out}/part-*")[0]).read()


def test_row_identity_deals_no_file_to_one_task(spark, tmp_path):
    """Ranks of files and starts of blocks go to the rows, whatever their sizes; rows are not shuffled by file."""
    from gleanframe.sources.datasets import _place

    rows = spark.range(0, 400, 1, 2).selectExpr("id", "CAST(id AS string) AS t")
    rows.write.parquet(str(tmp_path / "p"))
    rows.write.csv(str(tmp_path / "c"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for source in (spark.read.parquet(str(tmp_path / "p")), spark.read.schema("id bigint, t string").csv(str(tmp_path / "c"))):
            located, place = _place(source)
            placed = located.select(place.alias(ROWID), "id")
            assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
            found = placed.orderBy(ROWID).collect()
            assert [r["id"] for r in found] == list(range(400))
            assert len({r[ROWID] for r in found}) == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_shared_folder_is_below_the_checkpoint_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and os.path.dirname(one) == root


# ---- workbooks ----------------------------------------------------------------------------------

CLAIMS = [("claim_id", "member_id", "paid_amt"), ("c1", "m1", 10.5), ("c2", "m2", 20)]
MEMBERS = [("member_id", "plan_type"), ("m1", "gold"), ("m2", "silver"), ("m3", "gold")]


def test_workbook_sheets(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    save_workbook(path, {"claims": CLAIMS, "members": MEMBERS})
    found = {(r.name, r.kind, r.row_count) for r in discover(spark, path).collect()}
    assert found == {("claims", "sheet", 2), ("members", "sheet", 3)}
    (dataset,) = import_entities(spark, path, ["members"])
    assert (dataset.name, dataset.row_count) == ("book_members", 3)
    (named,) = import_entities(spark, path, ["claims"], naming="entity_only")
    assert (named.name, named.columns["paid_amt"]) == ("claims", "float")
    assert [d.name for d in import_entities(spark, path, mode="all")] == ["book_claims", "book_members"]
    with pytest.raises(ValueError, match="No entities selected"):
        import_entities(spark, path)
    with pytest.raises(ValueError, match="Unknown entities selected: nope"):
        import_entities(spark, path, ["nope"])
    with pytest.raises(ValueError, match="requires a sheet name"):
        scan(spark, path)
    with pytest.raises(ValueError, match="Sheet not found"):
        scan(spark, path, entity="nope")


def test_workbooks_of_a_folder_must_agree(spark, tmp_path):
    save_workbook(str(tmp_path / "a.xlsx"), {"s": [("x", "y"), (1, True)]})
    save_workbook(str(tmp_path / "b.xlsx"), {"s": [("x", "y"), (2, None)], "t": [("z",)]})
    df = scan(spark, str(tmp_path), "excel", "s")
    assert sorted(map(tuple, df.collect())) == [(1.0, True), (2.0, None)]
    save_workbook(str(tmp_path / "c.xlsx"), {"s": [("x", "other"), (3, False)]})
    with pytest.raises(ValueError, match="Workbooks disagree on column B"):
        scan(spark, str(tmp_path), "excel", "s")


def _peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_workbooks_are_written_and_read_in_bounded_memory(tmp_path):
    from gleanframe.sources.workbook import _Book

    path = str(tmp_path / "large.xlsx")
    rows = ((i, f"text {i * 7919 % 1000003}", i / 7) for i in range(60_000))
    sheet = itertools.chain([("id", "name", "share")], rows)
    assert _peak_mb(lambda: save_workbook(path, {"s": sheet})) < 2
    found = []

    def read():
        book = _Book(pa.scalar(f"file:{path}"), pa.scalar(None, pa.binary()))
        found.append(sum(1 for _ in book.rows("s")))

    assert _peak_mb(read) < 2
    assert found == [60_001]
    with open(path, "rb") as file:
        book = _Book(pa.scalar("elsewhere:/large.xlsx"), pa.scalar(file.read()))
    assert sum(1 for _ in book.rows("s")) == 60_001


def test_tasks_open_mounted_workbooks_themselves(spark, tmp_path):
    from gleanframe.sources.workbook import _files

    folder = tmp_path / "with blank, 100%"
    folder.mkdir()
    save_workbook(str(folder / "a b.xlsx"), {"s": [("x",), (1,), (2,)]})
    assert [r["content"] for r in _files(spark, str(folder)).collect()] == [None]
    assert sorted(r["x"] for r in scan(spark, str(folder), "excel", "s").collect()) == [1.0, 2.0]
    assert discover(spark, str(folder), "excel").collect()[0]["row_count"] == 2


def test_workbook_cell_forms(spark, tmp_path):
    """Shared and rich strings, blank cells, dates, times, errors, formulas and mixed columns."""
    path = str(tmp_path / "forms.xlsx")
    strings = "<si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>x</t></rPh></si><si><t>plain</t></si>"
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>day</t></is></c>'
        '<c r="C2" t="inlineStr"><is><t>at</t></is></c><c r="E2" t="inlineStr"><is><t>name</t></is></c></row>'
        '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4" s="1"><v>45306</v></c><c r="C4" s="2"><v>45306.5</v></c>'
        '<c r="D4" t="e"><v>#N/A</v></c><c r="E4"><v>7</v></c></row>'
        '<row r="5"><c r="A5" t="s"><v>2</v></c><c r="D5"><v>3</v></c><c r="E5" t="str"><f>A5</f><v>seven</v></c></row>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="s" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId9" Target="/xl/worksheets/any.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/any.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    df = scan(spark, path, entity="s")
    assert df.dtypes == [
        ("name", "string"),
        ("day", "date"),
        ("at", "timestamp_ntz"),
        ("D1", "double"),
        ("name_1", "string"),
    ]
    got = [tuple(None if v is None else str(v) for v in r) for r in df.collect()]
    assert got == [("rich", "2024-01-15", "2024-01-15 12:00:00", None, "7"), ("plain", None, None, "3.0", "seven")]


# ---- SQLite -------------------------------------------------------------------------------------


def _database(path, rows=3):
    connection = sqlite3.connect(path)
    with connection:
        connection.execute("CREATE TABLE members (id INTEGER, name TEXT, joined DATE, score REAL, raw BLOB)")
        connection.executemany(
            "INSERT INTO members VALUES (?, ?, ?, ?, ?)",
            [(i, None if i % 2 else f"n{i}", "2024-01-05", i, b"\x00\x01") for i in range(rows)],
        )
        connection.execute('CREATE TABLE "odd name" (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID')
        connection.execute("INSERT INTO \"odd name\" VALUES ('a', 1), ('b', 2)")
    connection.close()
    return str(path)


def test_written_files_take_rows_as_they_come(spark, tmp_path):
    def save(path, names, rows):
        next(rows)
        tracemalloc.start()
        size = 1 + sum(1 for _ in rows)
        with open(path, "w") as file:
            file.write(f"{names} {size} {tracemalloc.get_traced_memory()[1] < 8_000_000}")
        tracemalloc.stop()

    _write(spark.range(0, 200_000, 1, 1).selectExpr("id", "CAST(id AS string) AS t"), str(tmp_path / "out"), ".txt", save)
    assert (tmp_path / "out" / "part-00000.txt").read_text() == "['id', 't'] 200000 True"


def test_sqlite_tables(spark, tmp_path):
    path = _database(tmp_path / "mini.sqlite")
    found = [(r.name, r.kind, r.row_count) for r in discover(spark, path).orderBy("name").collect()]
    assert found == [("members", "table", 3), ("odd name", "table", 2)]
    (dataset,) = import_entities(spark, path, ["members"])
    assert (dataset.name, dataset.row_count) == ("mini_members", 3)
    assert dataset.columns == {"id": "integer", "name": "string", "joined": "date", "score": "float", "raw": "string"}
    assert spark.table("mini_members").orderBy("id").first().raw == b"\x00\x01"
    assert sorted(map(tuple, scan(spark, path, entity="odd name").collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="requires a table name"):
        scan(spark, path)
    with pytest.raises(ValueError, match="Table not found: nope"):
        scan(spark, path, entity="nope")


def test_sqlite_is_read_in_row_ranges_over_a_folder(spark, tmp_path):
    from gleanframe.sources.sqlite import scan_sqlite

    _database(tmp_path / "a.sqlite", 25)
    _database(tmp_path / "b.db", 7)
    df = scan_sqlite(spark, str(tmp_path), "members", rows_per_partition=10)
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 32 and df.agg(F.sum("score")).first()[0] == sum(range(25)) + sum(range(7))


def test_ids_follow_the_names_of_unequal_files(spark, tmp_path):
    for kind in ("csv", "parquet"):
        folder = tmp_path / kind
        for piece, (low, high) in enumerate([(0, 10), (10, 60_000), (60_000, 60_500)]):
            rows = spark.range(low, high, numPartitions=1)
            writer = rows.write.option("header", True)
            (writer.csv if kind == "csv" else writer.parquet)(str(folder / f"piece={piece}"))
        frame = load(spark, str(folder), f"pieces_{kind}", kind).frame
        ids = [r.id for r in frame.orderBy(ROWID).select("id").collect()]
        assert ids == list(range(60_500)), kind


def test_sorted_export_loads_in_its_order(spark, tmp_path):
    rows = spark.range(20_000).repartition(6, "id").withColumn(ROWID, F.col("id"))
    rows = rows.withColumn("k", (F.col("id") * 7919) % 1000)
    out = str(tmp_path / "out")
    export_csv(rows, out, sort="k")
    back = [r.k for r in load(spark, out, "back", "csv").frame.orderBy(ROWID).select("k").collect()]
    assert len(back) == 20_000 and back == sorted(back)


def test_unsorted_export_shuffles_nothing(spark, tmp_path):
    """Each task's rows are a range of ids, whatever order the tasks come in."""
    low, high = spark.range(0, 900, numPartitions=2), spark.range(900, 2000, numPartitions=3)
    rows = high.unionByName(low).withColumn(ROWID, F.col("id"))
    out = str(tmp_path / "out")
    export_csv(rows, out)
    lines = [x for part in sorted(glob.glob(f"{out}/part-*")) for x in open(part).read().splitlines()[1:]]
    assert [int(x) for x in lines] == list(range(2000))
    mixed = str(tmp_path / "mixed")
    export_csv(spark.range(2000).repartition(5, "id").withColumn(ROWID, F.col("id")), mixed)
    lines = [x for part in sorted(glob.glob(f"{mixed}/part-*")) for x in open(part).read().splitlines()[1:]]
    assert [int(x) for x in lines] == list(range(2000))


def test_views_of_like_names_are_not_replaced(spark, tmp_path):
    path = _save(tmp_path / "t.csv", "n\n1\n")
    load(spark, path, "like-name")
    with pytest.raises(ValueError, match="would replace the view of 'like-name'"):
        load(spark, path, "like.name")

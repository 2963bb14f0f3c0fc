import itertools
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from tablecheck.sources import catalog, folder, jsonrecords, options, tables, workbooks


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_formats_and_options():
    assert options.format_of("/x/a.JSONL") == ("json", "jsonl")
    assert options.format_of("/x/a.ipc") == ("arrow", "ipc")
    with pytest.raises(ValueError):
        options.format_of("/x/a.txt")
    got = options.normalize_options("psv", {"quote": "'", "encoding": "LATIN1", "delimiter": None, "bogus": 1, "header": 0})
    assert got == {"header": False, "delimiter": "|", "encoding": "latin-1", "quote": "'", "escape": '"', "null_string": ""}
    assert options.normalize_options("csv", {"null_string": "x" * 99})["null_string"] == "x" * 99
    assert options.normalize_options("json", {"record_path": " $.a.b"})["record_path"] == "a.b"
    long = ".".join(["part"] * 100)
    assert options.normalize_options("json", {"record_path": long})["record_path"] == long
    assert options.normalize_options("workbook", {"header_row": 3})["data_start_row"] == 4
    assert options.normalize_options("workbook", {"header_row": 0}) == {"header_row": 0, "data_start_row": 2, "infer_types": False}


@pytest.mark.parametrize(
    ("family", "given"),
    [
        ("csv", {"encoding": "ebcdic"}),
        ("csv", {"quote": "''"}),
        ("csv", {"delimiter": ""}),
        ("csv", {"header": "yes"}),
        ("json", {"record_path": 5}),
        ("workbook", {"header_row": "x"}),
        ("workbook", {"header_row": -1}),
        ("workbook", {"header_row": 3, "data_start_row": 2}),
    ],
)
def test_invalid_options_are_errors(family, given):
    with pytest.raises(ValueError):
        options.normalize_options(family, given)


def test_delimited(spark, tmp_path):
    plain = write(tmp_path / "a.csv", 'id;name;n\n1;\'a;b\';NA\n2;c;5\n')
    df = tables.read_table(spark, plain, {"delimiter": ";", "quote": "'", "null_string": "NA"})
    assert rows(df) == [(1, "a;b", None), (2, "c", 5)]
    assert rows(tables.read_table(spark, write(tmp_path / "a.tsv", "x\ty\n1\tz\n"))) == [(1, "z")]
    assert rows(tables.read_table(spark, write(tmp_path / "a.psv", "x|y\n1|z\n"))) == [(1, "z")]
    latin = write(tmp_path / "l.csv", "w\nné\n", "latin-1")
    assert rows(tables.read_table(spark, latin, {"encoding": "iso-8859-1"})) == [("né",)]
    wide = write(tmp_path / "u.csv", "a,last\n1,x\n2,y\n", "utf-16")
    df = tables.read_table(spark, wide, {"encoding": "utf16"})
    assert df.columns == ["a", "last"] and rows(df) == [(1, "x"), (2, "y")]
    bare = tables.read_table(spark, write(tmp_path / "h.csv", "1,2\n3,4\n"), {"header": False})
    assert bare.columns == ["column0", "column1"] and bare.count() == 2
    multi = write(tmp_path / "m.csv", 'a,b\n"x\ny","say ""hi"""\n')
    assert rows(tables.read_table(spark, multi, {"multi_line": True})) == [("x\ny", 'say "hi"')]


def test_json(spark, tmp_path):
    text = '{"id":1,"data":{"items":[{"a":1,"b":{"c":"x"}},null]},"empty":{}}\n\n{"id":2}\n{"id":3,"data":{"items":[{"a":5}]}}\n'
    lines = write(tmp_path / "n.ndjson", text)
    df = tables.read_table(spark, lines)
    assert df.count() == 3
    picked = tables.read_table(spark, lines, {"record_path": "$.data.items"})
    assert rows(picked.select("a")) == [(1,), (5,), (None,)]
    flat = tables.read_table(spark, lines, {"record_path": "data.items", "flatten": True})
    assert set(flat.columns) == {"a", "b.c"}
    with pytest.raises(ValueError):
        tables.read_table(spark, lines, {"record_path": "data.nope"})
    doc = write(tmp_path / "d.json", '[{"a": 1},\n {"a": 2, "b": [1, 2]}]')
    assert rows(tables.read_table(spark, doc, {"flatten": True})) == [(1, None), (2, "[1,2]")]
    bad = write(tmp_path / "b.jsonl", '{"a":1}\n[2]\n3\n')
    with pytest.raises(Exception):
        tables.read_table(spark, bad, {"require_objects": True}).collect()


def test_json_record_path_of_mixed_documents(spark):
    docs = ['{"a":{"b":[{"x":1},3,null]}}', '{"a":{"b":{"x":2}}}', '{"a":null}', "bad{", '{"a":{"b":[]}}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = jsonrecords.json_record_path(df, "doc", "$.a.b", ["id"]).select("id", "pos", F.to_json("value"))
    assert rows(got) == [(0, 0, '{"x":1}'), (0, 1, "3"), (0, 2, "null"), (1, 0, '{"x":2}')]
    first = jsonrecords.json_record_path(df, "doc", "a.b.0.x", ["id"]).select("id", F.to_json("value"))
    assert rows(first) == [(0, "1")]


def test_flatten_keeps_dots_and_lists(spark):
    df = spark.createDataFrame([(1, (2, ("x", [1, 2])))], "id int, d struct<a:int, e:struct<f:string, `g.h`:array<int>>>")
    flat = jsonrecords.flatten_json(df)
    assert flat.columns == ["id", "d.a", "d.e.f", "d.e.g.h"]
    assert rows(flat) == [(1, 2, "x", "[1,2]")]


def test_arrow_layouts(spark, tmp_path):
    table = pa.table({"id": list(range(100)), "t": [f"v{i}" for i in range(100)]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as w:
        for batch in table.to_batches(max_chunksize=3):
            w.write_batch(batch)
    with pa.OSFile(str(tmp_path / "s.ipc"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    import pyarrow.feather as feather

    feather.write_feather(table, str(tmp_path / "f.feather"))
    for name in ("a.arrow", "s.ipc", "f.feather"):
        df = tables.read_table(spark, str(tmp_path / name))
        assert df.agg(F.count("*"), F.sum("id")).first() == (100, 4950), name
    split = tables.read_table(spark, str(tmp_path / "a.arrow"))
    assert split.rdd.getNumPartitions() == 3  # 34 batches, 16 per task


def test_avro_names_the_package(spark, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        tables.read_table(spark, write(tmp_path / "x.avro", "Obj"))


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet(path, body, part="sheet1", others=(), styles=""):
    """A small ``.xlsx``: rows as {row number: {column letters: value}}; a tuple is (value, attributes of the cell)."""
    lines = []
    for number, cells in body.items():
        parts = []
        for letters, value in cells.items():
            at = f"{letters}{number}"
            value, more = value if isinstance(value, tuple) else (value, "")
            if isinstance(value, str) and not more:
                parts.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            elif value is not None:
                parts.append(f'<c r="{at}" {more}><v>{value}</v></c>')
        lines.append(f'<row r="{number}">{"".join(parts)}</row>')
    names = [part, *others]
    tabs = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names))
    links = "".join(f'<Relationship Id="rId{k + 1}" Type="{OFFICE}/worksheet" Target="worksheets/{n}.xml"/>' for k, n in enumerate(names))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr(f"xl/worksheets/{part}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
        for other in others:
            z.writestr(f"xl/worksheets/{other}.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_first_tab_dates_and_errors(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy&quot; day &quot;dd"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts>'
    styles += '<cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs>'
    body = {
        1: {"A": "day", "B": "moment", "C": "plain", "D": "time", "E": "bad", "F": "yes", "AA": "far"},
        2: {"A": (45292, 's="1"'), "B": (45292.5, 's="2"'), "C": (1.5, 's="3"'), "D": (0.25, 's="4"'), "E": ("#N/A", 't="e"'), "F": (1, 't="b"'), "AA": 7},
    }
    sheet(tmp_path / "w.xlsx", body, part="sheet10", others=("sheet1", "sheet2"), styles=styles)
    found = tables.read_table(spark, str(tmp_path / "w.xlsx")).first()
    assert (found.day, found.moment, found.plain, found.time, found.bad, found.yes, found.far) == ("2024-01-01", "2024-01-01 12:00:00", "1.5", "06:00:00", None, "true", "7")


def test_column_names_and_places():
    names = list(itertools.islice(workbooks.column_names(), 800))
    assert names[:2] == ["A", "B"] and names[25:28] == ["Z", "AA", "AB"] and names[702] == "AAA"
    assert [workbooks.column_place(f"{n}12") for n in names] == list(range(1, 801)) and workbooks.column_place("") == 0


def test_workbooks(spark, tmp_path):
    sheet(tmp_path / "a.xlsx", {1: {"A": "id", "B": "name"}, 2: {"A": 1, "B": "x"}, 3: {"A": 2, "C": "beyond"}, 4: {}, 5: {"A": 9}})
    sheet(tmp_path / "b.xlsx", {1: {"A": "name", "B": "id"}, 2: {"A": "y", "B": 7}})
    (tmp_path / "bad.xlsx").write_text("no zip")
    df = tables.read_table(spark, str(tmp_path), {"format": "workbook"})
    got = df.select(F.regexp_extract("_path", "[^/]+$", 0).alias("f"), "id", "name")
    assert rows(got) == [("a.xlsx", "1", "x"), ("a.xlsx", "2", None), ("b.xlsx", "7", "y")]
    typed = tables.read_table(spark, str(tmp_path / "a.xlsx"), {"infer_types": True})
    assert dict(typed.dtypes)["id"] == "bigint"


def test_workbook_header_rows(spark, tmp_path):
    sheet(tmp_path / "c.xlsx", {1: {"A": "title"}, 3: {"A": "k", "B": "v"}, 4: {"A": "unit"}, 5: {"A": "a", "B": 1}, 6: {"A": "b", "B": 2}})
    path = str(tmp_path / "c.xlsx")
    df = tables.read_table(spark, path, {"header_row": 3, "data_start_row": 5})
    assert rows(df.select("_row", "k", "v")) == [(5, "a", "1"), (6, "b", "2")]
    bare = tables.read_table(spark, path, {"header_row": 0, "data_start_row": 5})
    assert rows(bare.select("A", "B")) == [("a", "1"), ("b", "2")]


def test_mount_folder(spark, tmp_path):
    write(tmp_path / "a-b.csv", "x\n1\n")
    write(tmp_path / "a_b.json", '{"x": 2}')
    write(tmp_path / "node_modules" / "skip.csv", "x\n1\n")
    write(tmp_path / "bad.orc", "not orc")
    spark.range(3).write.parquet(str(tmp_path / "1x.parquet"))
    spark.range(4).write.parquet(str(tmp_path / "sub" / "many"))
    mounted = {r.path: r.view for r in folder.mount_folder(spark, str(tmp_path)).collect()}
    assert mounted == {"a-b.csv": "a_b", "a_b.json": "a_b_2", "bad.orc": None, "1x.parquet": "_1x", "sub/many": "sub_many"}
    assert spark.table("a_b_2").first().x == 2
    assert spark.table("sub_many").count() == 4


def test_relations(spark, tmp_path):
    relations = spark.createDataFrame(
        [("c", "default", "t", "BASE TABLE"), ("c", "other", "t", "VIEW")], catalog.RELATION_SCHEMA
    )
    assert catalog.select_relation(relations)["schema"] == "default"
    assert catalog.select_relation(relations, {"schema": "other", "name": "t", "database": "gone"})["type"] == "VIEW"
    with pytest.raises(ValueError):
        catalog.select_relation(relations, {"name": "u"})
    spark.sql(f"CREATE TABLE IF NOT EXISTS listed USING parquet LOCATION '{tmp_path}/listed' AS SELECT 1 AS x")
    try:
        found = catalog.list_relations(spark)
        one = catalog.select_relation(found, {"name": "listed"})
        assert one["type"] == "BASE TABLE" and catalog.open_relation(spark, one).first().x == 1
    finally:
        spark.sql("DROP TABLE listed")


def test_unique_columns(spark):
    df = spark.sql("SELECT 1 AS x, 2 AS x, 3 AS ` `, 4 AS x_2")
    assert tables.unique_columns(df).columns == ["x", "x_3", "column", "x_2"]
    assert same_rows(df, df)


def test_workbooks_are_parsed_once(spark, tmp_path):
    sheet(tmp_path / "a.xlsx", {1: {"A": "id", "B": "day"}, 2: {"A": 1, "B": "2024-01-01"}, 3: {"A": 2}})
    got = tables.read_table(spark, str(tmp_path), {"format": "workbook", "infer_types": True})
    assert rows(got.select("id", F.col("day").cast("string"))) == [(1, "2024-01-01"), (2, None)]
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_bad_workbook_is_no_result(spark, tmp_path):
    body = {1: {"A": "id"}} | {k: {"A": k} for k in range(2, 2500)}
    for name in ("whole", "cut", "torn", "other"):
        (tmp_path / name).mkdir()
        sheet(tmp_path / name / "a.xlsx", {1: {"A": "id"}, 2: {"A": 1}})
    sheet(tmp_path / "whole" / "b.xlsx", body)
    content = (tmp_path / "whole" / "b.xlsx").read_bytes()
    (tmp_path / "cut" / "b.xlsx").write_bytes(content[: len(content) // 2])
    with zipfile.ZipFile(tmp_path / "whole" / "b.xlsx") as whole, zipfile.ZipFile(tmp_path / "torn" / "b.xlsx", "w") as torn:
        for part in whole.namelist():
            text = whole.read(part)
            torn.writestr(part, text if part != "xl/worksheets/sheet1.xml" else text[: text.index(b'<row r="2400"')])
    (tmp_path / "other" / "b.xlsx").write_text("no zip")
    read = lambda name, **more: tables.read_table(spark, str(tmp_path / name), {"format": "workbook", **more})
    assert read("whole").count() == 2499
    # The rows before the one that fails had come as a table before.
    for name in ("cut", "torn"):
        for header_row in (0, 1):
            with pytest.raises(ValueError, match="b.xlsx"):
                read(name, header_row=header_row)
    with pytest.warns(UserWarning, match="b.xlsx: NotAWorkbook"):
        assert read("other").count() == 1
    with pytest.raises(ValueError, match="b.xlsx"):
        read("other", only_workbooks=True)

import datetime as dt
import json
import zipfile

import pandas as pd
import pytest
from pyspark.errors import AnalysisException

from cleanloom.session import scratch_path
from cleanloom.sources.auto import read_auto, read_keyed
from cleanloom.sources.csv import raw_header, read_csv, unique_names
from cleanloom.sources.json import is_json_lines, read_json
from cleanloom.sources.sinks import timestamped, write_cleaned, write_log
from cleanloom.workload.sources import workbook_bytes


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'n,x,flag,text,blank\n1,1.5,True,"a, ""b""",\n2,NA,false, padded ,NULL\n3,2,TRUE,n/a,\n')
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "text": "string", "blank": "string"}
    rows = [tuple(r) for r in df.orderBy("n").collect()]
    assert rows == [(1, 1.5, True, 'a, "b"', None), (2, None, False, " padded ", None), (3, 2.0, True, None, None)]
    assert set(dict(read_csv(spark, path, infer=False).dtypes.__iter__()).values()) == {"string"}


def test_csv_headers(spark, tmp_path):
    path = write(tmp_path / "h.csv", "a,a,,b.c,Actual gross\n1,2,3,4,5\n")
    assert raw_header(spark, path) == ["a", "a", "", "b.c", "Actual gross"]
    df = read_csv(spark, path)
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b.c", "Actual gross"]
    assert tuple(df.first()) == (1, 2, 3, 4, 5)
    assert unique_names(["a", "a.1", "a"]) == ["a", "a.1", "a.2"]
    assert unique_names(["id", "ID"]) == ["id", "ID.1"]
    assert read_csv(spark, write(tmp_path / "c.csv", "id,ID\n1,2\n")).columns == ["id", "ID.1"]


def test_csv_keeps_all_digits(spark, tmp_path):
    path = write(tmp_path / "w.csv", "n,wide,wider,mixed\n1234567890123456789,99999999999999999999,1" + "0" * 45 + ",99999999999999999999\n-5,1,2,1.5\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "wide": "decimal(38,0)", "wider": "string", "mixed": "string"}
    assert [str(v) for v in df.first()] == ["1234567890123456789", "99999999999999999999", "1" + "0" * 45, "99999999999999999999"]


def test_csv_rows_of_other_lengths_and_headers(spark, tmp_path):
    short = write(tmp_path / "s.csv", "a,b,c\n1,2,3\n4,5\n")
    assert sorted(map(tuple, read_csv(spark, short).collect())) == [(1, 2, 3), (4, 5, None)]
    long = write(tmp_path / "l.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, long, infer=False).collect()
    (tmp_path / "two").mkdir()
    write(tmp_path / "two" / "1.csv", "a,b\n1,2\n")
    write(tmp_path / "two" / "2.csv", "b,a\n3,4\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        read_csv(spark, str(tmp_path / "two"), infer=False).collect()


def test_row_keys_follow_the_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    for part in range(3):
        write(tmp_path / "k" / f"{part}.csv", "n,t\n" + "".join(f"{part * 100 + i},x\n" for i in range(50)))
    df, key = read_keyed(spark, str(tmp_path / "k"))
    assert [r.n for r in df.orderBy(*key).collect()] == [p * 100 + i for p in range(3) for i in range(50)]
    lines = write(tmp_path / "l.jsonl", '{"a": {"b": 1}}\n{"a": {"b": 2}}\n')
    df, key = read_keyed(spark, lines)
    assert df.columns == ["a.b", *key] and [r[0] for r in df.orderBy(*key).collect()] == [1, 2]


def test_csv_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'k,t\n1,"two\nlines"\n')
    assert read_csv(spark, path, multiline=True).first().t == "two\nlines"


def test_json_documents_and_lines(spark, tmp_path):
    records = [{"a": 1, "b": {"c": "x", "d": {"e": 2}}, "l": [1, 2]}, {"a": 2, "b": None, "l": []}]
    document = write(tmp_path / "d.json", "\n  " + json.dumps(records, indent=1))
    lines = write(tmp_path / "l.json", "\n".join(json.dumps(r) for r in records))
    pretty = write(tmp_path / "p.json", json.dumps(records[0], indent=1))
    assert not is_json_lines(spark, document) and is_json_lines(spark, lines) and not is_json_lines(spark, pretty)
    for path in (document, lines):
        df = read_json(spark, path)
        assert df.columns == ["a", "b.c", "b.d.e", "l"] and df.count() == 2
    assert read_json(spark, pretty).count() == 1
    assert read_json(spark, lines, flatten=False).columns == ["a", "b", "l"]
    with pytest.raises(ValueError, match="not readable"):
        read_json(spark, write(tmp_path / "bad.json", "not json"))


def test_a_document_on_one_line_is_not_lines(spark, tmp_path):
    records = [{"a": i, "t": "x" * 50} for i in range(2000)]
    path = write(tmp_path / "one.json", json.dumps(records))
    assert not is_json_lines(spark, path) and read_json(spark, path).count() == 2000
    assert is_json_lines(spark, write(tmp_path / "bom.json", "\ufeff" + json.dumps(records[0]) + "\n"))


def test_workbooks(spark, tmp_path):
    a = pd.DataFrame({"k": [1, 2], "t": ["x <y>", None], "v": [1.5, 2.0]}).astype(object)
    b = pd.DataFrame({"t": ["z"], "k": [3]}).astype(object)
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(a))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(b))
    one = read_auto(spark, str(tmp_path / "a.xlsx"))
    assert dict(one.dtypes) == {"k": "bigint", "t": "string", "v": "double"}
    assert [tuple(r) for r in one.orderBy("k").collect()] == [(1, "x <y>", 1.5), (2, None, 2.0)]
    both = read_auto(spark, str(tmp_path / "*.xlsx"))
    assert {tuple(r[c] for c in ("k", "t", "v")) for r in both.collect()} == {(1, "x <y>", 1.5), (2, None, 2.0), (3, "z", None)}
    with pytest.raises(Exception, match="no sheet"):
        read_auto(spark, str(tmp_path / "a.xlsx"), excel_sheet="Nope").count()


def test_workbook_shared_strings_dates_gaps_and_sheets(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{relation}"><sheets><sheet name="First" r:id="r1"/>'
                                         '<sheet name="Second" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/>'
                                                    '<Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>day</t></si><si><r><t>fl</t></r><r><t>ag</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm"/></numFmts>'
                                       '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData/></worksheet>")
        book.writestr("xl/worksheets/two.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                      '<row r="2"><c r="A2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c></row>'
                      '<row r="4"><c r="A4" s="2"><v>45000.5</v></c><c r="C4" t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>')
    df = read_auto(spark, str(tmp_path / "s.xlsx"), excel_sheet=1)
    assert df.columns == ["day", "Unnamed: 1", "flag"]
    assert [tuple(r) for r in df.collect()] == [("2023-03-15 00:00:00", None, True), (None, None, None), ("2023-03-15 12:00:00", None, None)]


def test_dispatch_and_errors(spark, tmp_path, guests_csv):
    assert read_auto(spark, guests_csv).count() == 18
    folder = scratch_path(spark, "parquet")
    spark.range(3).write.parquet(folder)
    assert read_auto(spark, folder).count() == 3
    upper = write(tmp_path / "U.CSV", "a\n1\n")
    (tmp_path / "sales.v1").mkdir()
    write(tmp_path / "sales.v1" / "part.csv", "a\n1\n2\n")
    for path in ("sales.v1", "sales.v1/*", "sales.*"):
        assert read_auto(spark, str(tmp_path / path)).count() == 2
    assert read_auto(spark, upper).count() == 1
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_auto(spark, str(tmp_path / "gone.csv"))
    for name in ("x.txt", "x.xls"):
        with pytest.raises(ValueError, match="support"):
            read_auto(spark, str(tmp_path / name))


def test_sinks(spark, tmp_path):
    now = dt.datetime(2024, 1, 31, 12, 0, 0)
    assert timestamped("d/in.csv", "cleaned", now) == "d/in_cleaned_20240131_120000"
    df = spark.createDataFrame([(1, ' a "q" ', 1), (2, None, -1)], "k int, t string, Outlier int")
    path = write_cleaned(df, str(tmp_path / "in.csv"), now=now)
    assert {tuple(r) for r in read_csv(spark, path).collect()} == {(1, ' a "q" '), (2, None)}
    with pytest.raises(AnalysisException):
        write_cleaned(df, str(tmp_path / "in.csv"), now=now)
    assert spark.read.parquet(write_log(df, str(tmp_path / "in.csv"), "parquet", now)).count() == 2


BROKEN_JSON = {
    "two documents": '{\n"a":1}\n{\n"a":2}', "two arrays": '[{"a":1},\n{"a":2}]\n[{"a":3}]', "a broken line": '{"a":1}\n{"a":\n{"a":3}\n',
    "two records on a line": '{"a":1}\n{"a":2} {"a":3}\n', "a comma between": '{"a":1}\n{"a":2},{"a":3}\n', "a closed bracket": '{"a":1}\n{"a":2}],[{"a":3}\n',
    "a closed brace": '{"a":1}\n{"a":2}},{"r":{"a":3}\n', "a further key": '{"a":1}\n{"a":2},"r":{"a":3}\n', "an array line": '{"a":1}\n[{"a":2},{"a":3}]\n',
    "a number line": '{"a":1}\n7\n', "text behind an array": '[\n{"a":1}] x',
}


@pytest.mark.parametrize("name", BROKEN_JSON)
def test_broken_json_fails_whatever_is_read(spark, tmp_path, name):
    df = read_json(spark, write(tmp_path / "in.json", BROKEN_JSON[name]))
    for asked in (df, df.select("a"), df.select(), df.agg({"*": "count"})):
        with pytest.raises(Exception, match="not one JSON"):
            asked.collect()


def test_whole_json_keeps_all_rows(spark, tmp_path):
    lines = write(tmp_path / "l.json", '\ufeff{"a":1,"b":{"c":"]}"}}\r\n\n  {"a":2} \n{"b":{"c":"{[\\""}}')
    assert [tuple(r) for r in read_json(spark, lines).orderBy("a").collect()] == [(None, '{["'), (1, "]}"), (2, None)]
    document = write(tmp_path / "d.json", ' [\n{"a":1,"b":[{"c":1}]},\n{"a":2}]\n ')
    df = read_json(spark, document, keyed=True)
    assert df.columns == ["a", "b", "__file", "__block", "__row"]
    assert [r["a"] for r in df.orderBy("__row").collect()] == [1, 2] and df.select("__row").distinct().count() == 2
    assert read_json(spark, write(tmp_path / "o.json", '{\n"a": {"x": 1}}\n')).columns == ["a.x"]
    assert read_json(spark, lines, schema=read_json(spark, lines, flatten=False).schema).count() == 3


def test_a_row_with_too_many_cells_fails_whatever_is_read(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "wide.csv", "a,b\n1,2\n3,4,5\n6\n"), infer=False)
    for asked in (df, df.select("b"), df.select("a"), df.select(), df.agg({"*": "count"})):
        with pytest.raises(Exception, match="more cells"):
            asked.collect()
    assert read_csv(spark, write(tmp_path / "fine.csv", "a,b\n1,2\n6\n"), infer=False).select("b").count() == 2

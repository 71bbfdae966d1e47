import json

import pytest

from tabulens import pipeline
from tabulens.operators import legacy, mixed, raw_profile, row_order
from tabulens.plans import charts, evidence
from tabulens.plans.planner import plan_legacy
from tabulens.sources import encodings, ingest, sinks


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(p)

    return write


def test_csv_with_repeated_header(spark, put):
    got = ingest.ingest(spark, put("a.csv", "value,value,city\n1,2,x\n"))
    assert got.frame.columns == ["value", "value_2", "city"] and not got.report["errors"]
    assert got.frame.first()[:2] == (1, 2)


def test_blank_cells_keep_a_column_text(spark, put):
    got = ingest.ingest(spark, put("a.csv", "a,b\n1,2\n,3\n5,6\n"))
    assert got.frame.schema["a"].dataType.simpleString() == "string" and got.frame.schema["b"].dataType.simpleString() == "bigint"
    assert [r[0] for r in got.frame.select("a").collect()] == ["1", "", "5"]


@pytest.mark.parametrize(("name", "content", "sep"), [("a.csv", "a;b\n1;2\n3;4\n", ";"), ("a.csv", "a|b\n1|2\n3|4\n", "|"), ("a.tsv", "name\tamount\nx\t1\ny\t2\n", "\t")])
def test_delimiters(spark, put, name, content, sep):
    got = ingest.ingest(spark, put(name, content))
    assert got.report["delimiter"] == sep and got.frame.count() == 2


def test_ragged_rows(spark, put):
    assert ingest.ingest(spark, put("a.csv", "a,b\n1,2\n3\n")).frame.count() == 2
    assert "more cells" in ingest.ingest(spark, put("b.csv", "a,b\n1,2\n3,4,5\n")).report["errors"][0]


def test_encodings_and_empty_files(spark, put):
    assert encodings.by_mark(b"\xef\xbb\xbfa") == "utf-8-sig" and encodings.by_mark("a".encode("utf-16")) == "utf-16" and encodings.by_mark("é".encode()) is None
    assert ingest.ingest(spark, put("u.csv", "name,v\né,1\nb,2\n".encode("utf-8-sig"))).report["encoding"] == "utf-8-sig"
    assert ingest.ingest(spark, put("w.csv", "name,v\né,1\nb,2\n".encode("utf-16"))).frame.first()["name"] == "é"
    got = ingest.ingest(spark, put("a.csv", "name,v\n\xe9,1\nb,2\nc,3\n".encode("latin-1")))
    assert got.frame.first()["name"] == "é"
    assert ingest.ingest(spark, put("b.csv", "")).report["errors"] == ["The file is empty."]
    assert ingest.ingest(spark, put("c.doc", "x")).report["errors"]
    assert ingest.ingest(spark, put("d.xlsx", "PK")).report["errors"]


def test_json_parquet_and_facts(spark, put, tmp_path):
    assert ingest.ingest(spark, put("a.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))).frame.count() == 2
    path = str(tmp_path / "t.parquet")
    spark.sql("select double('NaN') as v, 1 as w union all select 2.0, 2").write.parquet(path)
    got = ingest.ingest(spark, path)
    assert got.profile["columns"][0]["null_count"] == 1
    assert ingest.file_facts(spark, put("x.csv", "abc"))["size"] == 3


def test_index_like_column(spark, put):
    got = ingest.ingest(spark, put("a.csv", ",name\n0,a\n1,b\n2,c\n"))
    assert got.structure["index_like_columns"] == ["column_1"]


def test_pipeline(spark, put, tmp_path):
    rows = "\n".join(f"c{i},{i * 10},{'yes' if i % 2 else 'no'},{'AB'[i % 2]},2024-01-{i % 28 + 1:02d}" for i in range(40))
    out = pipeline.run(spark, put("a.csv", "customer_id,amount,active,label,day\n" + rows + "\n"))
    assert out["pipeline_error"] is None and out["raw_snapshot_unchanged"]
    assert out["statistics"]["numeric"]["amount"]["count"] == 40
    assert out["statistics"]["boolean"]["active"]["true_count"] == 20
    assert out["statistics"]["datetime"]["day"]["duration_days"] == 27.0
    assert "customer_id" not in out["statistics"]["columns"]
    assert {c["rule_id"] for c in out["chart_candidates"]} >= {"NUMERIC_HISTOGRAM", "CATEGORICAL_BAR", "DATETIME_NUMERIC_LINE", "LOW_CARDINALITY_PIE"}
    assert all(d["chart_type"] not in charts.REPORTED for d in out["chart_decisions"])
    assert out["markdown"].count("\n## ") == 8 and len(out["sections"]) == 5
    sinks.write_text(spark, str(tmp_path / "r.md"), out["markdown"])
    sinks.write_table(out["cleaned_frame"], str(tmp_path / "out"))
    assert (tmp_path / "r.md").read_text() == out["markdown"]


def test_pipeline_reports_its_stage(spark, put):
    assert pipeline.run(spark, put("a.pdf", "x"))["pipeline_error"]["stage"] == "ingestion"
    assert pipeline.run(spark, put("a.csv", "a,b\n1,2\n3,4\n"), data_loss_threshold=2)["pipeline_error"]["stage"] == "preprocessing"


def test_selection_keeps_its_limits():
    columns = {n: {"semantic_type": "numeric", "missing_count": 0, "unique_count": 30} for n in "abc"} | {n: {"semantic_type": "categorical", "missing_count": 1, "unique_count": 4} for n in "xy"}
    found = charts.candidates({"n_rows": 50, "columns": columns, "categorical": {}})
    assert len([c for c in found if c.rule_id == "NUMERIC_NUMERIC_SCATTER"]) == 3 and len(found) == 31
    kept = [d for d in charts.select(found) if d["decision"] == "accepted"]
    assert len(kept) <= 7 and sum(d["chart_type"] == "scatter_plot" for d in kept) <= 2


def test_evidence_is_scrubbed():
    x = {"a": [{"sample_values": [1], "b": 2}], "html": "x", "deep": {"outlier_values": [3], "frame": 4}}
    assert evidence.scrub(x) == {"a": [{"b": 2}], "deep": {}}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_bytes_far_into_a_file(spark, put):
    """A byte past the head decides the encoding of an ASCII file; among valid UTF-8 it is replaced with a warning."""
    rows = "name,v\n" + "".join(f"plain,{i}\n" for i in range(150_000))
    assert len(rows) > ingest.HEAD_BYTES
    got = ingest.Ingested()
    df, _ = ingest.read(spark, put("a.csv", rows.encode() + "café,1\n".encode("latin-1")), got.report)
    assert got.report["encoding"] == "iso-8859-1" and df.where("c0 = 'café'").count() == 1
    got = ingest.Ingested()
    df, _ = ingest.read(spark, put("b.csv", rows.encode() + ("café,1\n" * 5).encode() + b"caf\xe9,1\n"), got.report)
    assert got.report["encoding"] == "utf-8" and got.report["warnings"] == ["1 lines hold bytes that are no UTF-8; these were replaced."]
    assert df.where("c0 = 'café'").count() == 5


SAMPLES = {
    "windows-1251": "Съешь же ещё этих мягких французских булок, да выпей чаю. Привет, Москва и Россия",
    "koi8-r": "Съешь же ещё этих мягких французских булок, да выпей чаю. Привет, Москва и Россия",
    "iso-8859-5": "Съешь же ещё этих мягких французских булок, да выпей чаю. Привет, Москва и Россия",
    "windows-1250": "Příliš žluťoučký kůň úpěl ďábelské ódy, zażółć gęślą jaźń w Łodzi",
    "windows-1252": "Der Bürger aß heiße Brühe für zehn € – déjà vu à l’hôtel, ça coûte où tu sais",
    "iso-8859-1": "Der Bürger aß heiße Brühe für zehn Mark, déjà vu à la fenêtre, el niño comió",
    "windows-1253": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και θέλω να πάω στην Ελλάδα",
}


@pytest.mark.parametrize("charset", sorted(SAMPLES))
def test_eight_bit_character_sets(spark, put, charset):
    content = "text;n\n" + "".join(f"{SAMPLES[charset]};{i}\n" for i in range(5))
    got = ingest.ingest(spark, put("a.csv", content.encode(charset)))
    assert got.report["encoding"] == charset
    assert {r["text"] for r in got.frame.collect()} == {SAMPLES[charset]}
    assert 0 < got.report["encoding_confidence"] <= 1


def test_quoted_line_breaks_and_splits(spark, put, small_splits):
    plain = "id,name\n" + "".join(f"{i},name {i}\n" for i in range(10_000))
    df, _ = ingest.read(spark, put("a.csv", plain), {"errors": [], "warnings": []})
    assert df.rdd.getNumPartitions() > 3 and df.count() == 10_000
    quoted = plain + '10000,"two\nlines"\n'
    df, _ = ingest.read(spark, put("b.csv", quoted), {"errors": [], "warnings": []})
    assert df.count() == 10_001 and df.where("c1 = 'two\nlines'").count() == 1


def test_row_order_over_splits(spark, put, tmp_path, small_splits):
    content = "Unnamed: 0,v,w\n" + "".join(f"{i},{'' if i < 4000 else (i * 7919) % 10_007},x{9_999 - i}\n" for i in range(10_000))
    got = ingest.ingest(spark, put("a.csv", content))
    numbers = row_order.numbered(got.frame)
    assert got.frame.rdd.getNumPartitions() > 3
    assert numbers.where("unnamed_0 <> __row_idx").count() == 0 and numbers.count() == 10_000 if "unnamed_0" in numbers.columns else numbers.where(f"`{got.frame.columns[0]}` <> __row_idx").count() == 0
    assert raw_profile.samples(got.frame)["w"] == [f"x{9_999 - i}" for i in range(5)]
    filled = got.frame.where("v <> ''")
    assert raw_profile.samples(filled)["v"] == [str((i * 7919) % 10_007) for i in range(4000, 4005)]
    assert [r[0] for r in row_order.numbered(filled).orderBy("__row_idx").select("w").take(2)] == ["x5999", "x5998"]
    assert got.structure["index_like_columns"] == [got.frame.columns[0]]
    shuffled = "Unnamed: 0,v\n" + "".join(f"{(i * 7919) % 10_007},a\n" for i in range(10_007))
    assert ingest.ingest(spark, put("b.csv", shuffled)).structure["index_like_columns"] == []
    # Two files: the rows of the first by name come first.
    folder = tmp_path / "t.parquet"
    for k in (1, 0):
        spark.range(k * 500, k * 500 + 500, numPartitions=1).write.mode("append").parquet(str(folder))
    many = row_order.numbered(spark.read.parquet(str(folder)))
    assert sorted(r["__row_idx"] for r in many.collect()) == list(range(1000))
    assert row_order.in_order(spark.range(5), row_order.F.col("id")) is None


def test_json_cells_of_several_types(spark, put):
    rows = [{"k": i, "v": v, "s": "x", "n.o": {"d": 1}} for i, v in enumerate([1, 2.5, "three", " na ", True, None, {"a": 1}, [1], "4"])]
    for content in (json.dumps(rows), "\n".join(map(json.dumps, rows))):
        got = ingest.ingest(spark, put("a.json", content))
        assert not got.report["errors"]
        by = {p["name"]: p for p in got.profile["columns"]}
        v = by["v"]
        assert (v["mixed_type_count"], v["has_mixed_types"], v["dtype"], v["null_count"]) == (6, True, "variant", 1)
        assert (v["string_count"], v["whitespace_count"], v["null_like_count"]) == (3, 1, 1)
        assert (by["s"]["mixed_type_count"], by["s"]["has_mixed_types"], by["k"]["has_mixed_types"]) == (1, False, False)
        assert got.frame.schema["v"].dataType.simpleString() == "string"
        assert [r["v"] for r in got.frame.orderBy("k").collect()] == ["1", "2.5", "three", " na ", "true", None, '{"a":1}', "[1]", "4"]
    out = pipeline.run(spark, put("b.json", json.dumps(rows)))
    assert out["pipeline_error"] is None


def test_variants_in_a_frame(spark):
    df = spark.sql("select id, parse_json(case when id % 3 = 0 then '1' when id % 3 = 1 then '\"a\"' else 'null' end) as v from range(9)")
    assert mixed.type_counts(df) == {"v": {"int": 3, "str": 3}}
    assert [p["has_mixed_types"] for p in legacy.profile(df)["columns"]] == [False, True]
    assert raw_profile.profile(df)["columns"][1]["null_count"] == 3
    numbers = spark.sql("select parse_json(if(id % 2 = 0, cast(id as string), concat('\"', id, '\"'))) as amount from range(40)")
    plan = plan_legacy(legacy.profile(numbers))
    assert [a.columns for a in plan.actions if a.action == "review_mixed_types"] == [["amount"]]


def workbook_bytes():
    """A small workbook, made by hand: two sheets, shared, inline and rich strings, a date, a flag, an error, gaps."""
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>amount</t></is></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="str"><v>flag</v></c></row>'
    body = "".join(f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>2</v></c>' + (f'<c r="B{i + 2}"><v>{i}.5</v></c>' if i != 3 else "") + f'<c r="C{i + 2}" s="1"><v>{45000 + i}</v></c><c r="D{i + 2}" t="{"e" if i == 5 else "b"}"><v>{"#N/A" if i == 5 else i % 2}</v></c></row>' for i in range(6))
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Notes" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Full Name</t></si><si><t>day</t></si><si><r><t>An</t></r><r><t>na é</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{head}{body}<row r="9"/></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData/></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark, put):
    got = ingest.ingest(spark, put("a.xlsx", workbook_bytes()))
    assert got.report["errors"] == [] and got.report["skipped_sheets"] == ["Notes"] and "Only the first sheet was read." in got.report["warnings"]
    assert [f.dataType.simpleString() for f in got.frame.schema] == ["string", "double", "string", "boolean"] and got.frame.columns[0] == "full_name"
    rows = [tuple(r) for r in got.frame.collect()]
    assert rows[0] == ("Anna é", 0.5, "2023-03-15", False) and rows[3][1] is None and rows[5][3] is None and len(rows) == 6
    assert {p["name"]: p["semantic_type"] for p in got.profile["columns"]}["day"] == "datetime"
    assert ".xlsx" in ingest.ingest(spark, put("b.xls", bytes.fromhex("D0CF11E0") + b"x" * 50)).report["errors"][0]
    assert ingest.ingest(spark, put("c", workbook_bytes())).report["file_type"] == "xlsx"

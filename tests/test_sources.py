import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.operators.pages import allowed, day_count, period_days
from tidewell.sources import files
from tidewell.sources.discharges import discharged_patients


def test_census_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("setor,qrt_leito,prontuario,nome,esp,idade,tempo\nUTI,1,123.0,Ana,CLM,13,4\nUTI,2,, em limpeza ,,,x\n", encoding="utf-8")
    rows = {r["leito"]: r for r in files.census_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["1"]["prontuario"] == "123" and rows["1"]["bed_status"] == "occupied" and rows["1"]["age_band"] == "age_12_or_over" and rows["1"]["tempo_internacao"] == 4
    assert rows["2"]["bed_status"] == "maintenance" and rows["2"]["age_band"] == "not_applicable" and rows["2"]["tempo_internacao"] is None and rows["2"]["setor_codigo"] == ""


def test_census_csv_lacks_a_column(spark, tmp_path):
    (tmp_path / "c.csv").write_text("setor,nome\nUTI,Ana\n")
    with pytest.raises(ValueError, match="qrt_leito"):
        files.census_csv(spark, str(tmp_path / "c.csv"))


def test_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Quarto/Leito,Prontuário,Paciente,x\n1,9.0,Ana,\n2,,,\n")
    assert [r["prontuario"] for r in files.sheet_text(spark, str(tmp_path / "s.csv")).collect()] == ["9"]
    (tmp_path / "a.csv").write_text("a,,c\n1, 2,\n")
    assert files.any_columns(spark, str(tmp_path / "a.csv")).collect() == [("1", "2", "")]


def test_semicolons_and_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("nome ; setor\n Josué ; A \n".encode())
    (tmp_path / "l.csv").write_bytes("nome;setor\nJosué;\n".encode("iso-8859-1"))
    assert files.detected_text(spark, str(tmp_path / "u.csv")).collect() == [("Josué", "A")]
    assert files.detected_text(spark, str(tmp_path / "l.csv")).collect() == [("Josué", "")]


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("other.txt", "no")
        z.writestr("censo_1.txt", b"a;b\n\xff;2")
    assert [r["text"] for r in files.zipped_text(spark, str(tmp_path / "z.zip"), "censo").collect()] == ["a;b\n�;2"]


def test_discharges_words_and_wards(spark):
    rows = spark.createDataFrame([("1", "77.0", " Ana ", "01/01/2024", "", "CLM", "", "L:UN08H", ""), ("2", None, "x", "", "", "", "", "", "")], [f"_{i}" for i in range(9)])
    out = files.discharge_rows(rows).collect()
    assert [(r["prontuario"], r["leito"]) for r in out] == [("77", "UN08H")]
    words = spark.createDataFrame([(1, 10.0, 2.0, "b"), (1, 11.0, 1.0, "a"), (1, 12.4, 1.0, "c")], "page int, x double, y double, text string")
    assert sorted((r["band"], r["line"]) for r in files.words_to_lines(words, ["page"]).collect()) == [(0, "a b"), (1, "c")]
    text = "x\nUnidade\n640\nUTI A\nLeito\nStatus\nAcomodação\nAtivo\n01\nLivre\nEnf\nSim\n02\nOcupado\nEnf\nSim\nTotal\n2\nUnidade\nnada\n"
    beds = files.ward_blocks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("position").collect()
    assert [(b["code"], b["ward"], b["bed"], b["status"]) for b in beds] == [("640", "UTI A", "01", "Livre"), ("640", "UTI A", "02", "Ocupado")]


def test_report_is_written_in_order(spark, tmp_path):
    rows = spark.range(100).select((99 - F.col("id")).alias("id"))
    files.write_report(rows, str(tmp_path / "r"), "id")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 100


def test_catalog_documents(spark):
    doc = '{"effective_from": "2024-01-01", "schema_version": "1", "groups": [{"stable_key": "g", "official_capacity": 4, "calculation_policy": "standard", "source_codes": [{"source_code": "c", "age_selector": "all"}]}]}'
    rows = files.catalog_documents(spark.createDataFrame([(doc,)], "d string"), "d").collect()
    assert [(r["stable_key"], r["official_capacity"], r["source_code"], r["age_selector"]) for r in rows] == [("g", 4, "c", "all")]


def test_parameters():
    assert (period_days("7d"), period_days("x")) == (7, 1)
    assert (allowed("30", (7, 30), 7), allowed("8", (7, 30), 7), allowed(None, (7,), 7)) == (30, 7, 7)
    assert (day_count("0"), day_count("5000"), day_count("a")) == (90, 5000, 90)


def test_workbooks(spark, tmp_path):
    """Values of all kinds, odd characters, blank cells and headers, sheets that are full, and overwriting."""
    path = str(tmp_path / "books")
    rows = [(1, 1.5, True, " a <b> & \x07 _x0041_ é\n", None), (2, None, False, "", "01/02/2024"), (2**60, -0.25, None, "x", "y")]
    df = spark.createDataFrame(rows, "n long, f double, b boolean, t string, ` ` string").coalesce(1)
    files.workbooks(spark)
    df.write.format("workbook").mode("overwrite").option("sheetRows", 3).save(path)
    assert len(list((tmp_path / "books").glob("*.xlsx"))) == 2
    back = spark.read.format("workbook").load(path)
    assert back.columns == ["n", "f", "b", "t", "col_4"]
    assert sorted(map(tuple, back.collect())) == sorted([("1", "1.5", "true", rows[0][3], None), ("2", None, "false", "", "01/02/2024"), (str(2**60), "-0.25", None, "x", "y")])
    files.write_workbook(df.limit(1), path)
    assert spark.read.format("workbook").load(path).count() == 1
    assert [r["t"] for r in spark.read.format("workbook").schema("t string, missing string").load(path).collect()] == [rows[0][3]]


def test_workbook_of_another_writer(spark, tmp_path):
    """Shared strings, cells without values, gaps by reference, and formulas' texts."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings = f"<sst {ns}><si><t>Leito</t></si><si><r><t>Pront</t></r><r><t>uário</t></r></si><si><t>Ana</t></si><si><t>Paciente</t></si></sst>"
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>3</v></c></row>'
    sheet += '<row r="2"><c r="A2" t="str"><v>L1</v></c><c r="C2"><v>123.0</v></c><c r="D2" t="s"><v>2</v></c></row><row r="3"><c r="A3" s="1"/></row><row r="4"><c r="B4"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", strings)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    rows = files.any_workbook(spark, str(tmp_path / "s.xlsx"))
    assert rows.columns == ["Leito", "col_1", "Prontuário", "Paciente"]
    assert rows.collect() == [("L1", "", "123", "Ana"), ("", "7", "", "")]
    census = files.census_workbook(spark, str(tmp_path / "s.xlsx")).collect()
    assert [(r["qrt_leito"], r["prontuario"], r["nome"]) for r in census] == [("L1", "123", "Ana")]


def test_each_file_in_its_encoding(spark, tmp_path):
    (tmp_path / "a[1].csv").write_bytes("nome;obs\nJosé;ação\n".encode())
    (tmp_path / "b.csv").write_bytes("﻿nome;obs\nÂngela;\n".encode())
    (tmp_path / "c.csv").write_bytes("nome;obs\nInês;não\n".encode("iso-8859-1"))
    assert sorted(map(tuple, files.detected_text(spark, str(tmp_path)).collect())) == [("Inês", "não"), ("José", "ação"), ("Ângela", "")]


def test_discharge_pages(spark):
    """Bands from the bottom up, names until a doctor's number, short years, a second column with one word, pages without a record."""
    at = lambda page, x, words, y=500: [(page, float(x), float(y - 10 * k), w) for k, w in enumerate(words)]
    words = at("p1", 100, ["123/4", "A", "MARIA", "DA", "SILVA", "12345", "DR", "X", "01/02/24", "tail"]) + at("p1", 101, ["UN08H", "UN08H", "01/02/24", "CLM"])
    words += at("p1", 110, ["99/1", "JOAO", "CRMba", "03/04/2025"]) + at("p1", 111, ["CIR"]) + at("p1", 120, ["77/2", "ANA"]) + at("p1", 121.2, ["L:9"])
    words += at("p2", 50, ["no", "record"]) + [("p1", 100.0, 1.0, None)]
    out = discharged_patients(spark.createDataFrame(words, "page string, x double, y double, text string")).orderBy("band").collect()
    assert [tuple(r)[2:] for r in out] == [("1234", "MARIA DA SILVA", "UN08H", "CLM", "01/02/2024"), ("991", "JOAO", "", "CIR", "03/04/2025"), ("772", "ANA", "L:9", "", "")]

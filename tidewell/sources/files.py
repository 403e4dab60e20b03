"""Readers of the files that hospitals hand over, and writers of reports. Paths are Spark's: any store that it reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.classes import age_band, bed_status
from tidewell.functions.strings import record_number
from tidewell.sources.sheets import workbooks

#: Columns of a census file: those that must be there, and those that are blank where they are not.
CENSUS_REQUIRED, CENSUS_OPTIONAL = ("setor", "qrt_leito", "prontuario", "nome", "esp"), ("codigo_setor", "dt_int", "tempo", "idade", "convenio")
#: Other headers of the sheet exported as text.
SHEET_ALIASES = {"qrt/leito": "qrt_leito", "quarto/leito": "qrt_leito", "leito": "qrt_leito", "prontuário": "prontuario", "paciente": "nome", "especialidade": "esp"}


def _texts(df: DataFrame, required: tuple[str, ...], optional: tuple[str, ...]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in required], *[(F.coalesce(F.trim(c), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in optional])


def census_csv(spark: SparkSession, path: str) -> DataFrame:
    """Census rows with status, age band and the length of stay as a number; null if it is none."""
    rows = _texts(spark.read.csv(path, header=True, multiLine=True, escape='"'), CENSUS_REQUIRED, CENSUS_OPTIONAL)
    status = bed_status(F.col("prontuario"), F.col("nome"))
    return rows.select(
        "setor", F.col("codigo_setor").alias("setor_codigo"), F.col("qrt_leito").alias("leito"), record_number(F.col("prontuario")).alias("prontuario"), "nome",
        F.col("esp").alias("especialidade"), F.col("dt_int").alias("data_internacao"), F.col("tempo").try_cast("int").alias("tempo_internacao"),
        status.alias("bed_status"), age_band(F.col("idade"), status).alias("age_band"),
    )


def census_sheet(rows: DataFrame) -> DataFrame:
    """A census sheet's rows, its headers by alias; rows with neither record nor name go."""
    named = {c: SHEET_ALIASES.get(c.strip().lower(), c.strip().lower()) for c in rows.columns}
    out = _texts(rows.withColumnsRenamed(named), ("qrt_leito", "prontuario", "nome"), ("esp", "idade"))
    return out.withColumn("prontuario", record_number(F.col("prontuario"))).filter("prontuario <> '' OR nome <> ''")


def sheet_text(spark: SparkSession, path: str) -> DataFrame:
    """As ``census_sheet``, of a sheet landed as CSV."""
    return census_sheet(spark.read.csv(path, header=True))


def census_workbook(spark: SparkSession, path: str) -> DataFrame:
    """As ``census_sheet``, of XLSX files."""
    return census_sheet(workbooks(spark).read.format("workbook").load(path))


def any_workbook(spark: SparkSession, path: str) -> DataFrame:
    """XLSX files without types: the first row is the header, blank ones are ``col_i``, all values are trimmed texts, none null."""
    rows = workbooks(spark).read.format("workbook").load(path)
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def discharge_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``discharge_rows`` of XLSX files: nine columns by place, without a header."""
    schema = ", ".join(f"_{i} string" for i in range(9))
    return discharge_rows(workbooks(spark).read.format("workbook").schema(schema).option("header", "false").load(path))


def any_columns(spark: SparkSession, path: str) -> DataFrame:
    """A sheet landed as CSV without types: the first row is the header, blank ones are ``col_i``, all values are texts."""
    rows = spark.read.csv(path, header=False)
    head = rows.limit(1).collect()  # the header
    names = [(str(v).strip() if v is not None else "") or f"col_{i}" for i, v in enumerate(head[0])] if head else []
    body = spark.read.csv(path, header=True).toDF(*names) if names else rows
    return body.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in body.columns])


def semicolon_text(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """``;`` between values, keys and values trimmed, nothing null."""
    rows = spark.read.csv(path, header=True, sep=";", encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def detected_text(spark: SparkSession, path: str) -> DataFrame:
    """As ``semicolon_text``, each file in its own encoding: UTF-8, with a mark or without, if it decodes as such, else ISO-8859-1, which never fails.

    Files may have other columns; a column that a file lacks is blank. What would come after ISO-8859-1 is never reached, so bytes that only
    another code page has a character for stay control characters.
    """
    raw = spark.read.format("binaryFile").load(path)
    kinds = raw.select("path", F.expr("is_valid_utf8(CAST(content AS STRING))").alias("utf8")).collect()  # a row for each file
    found = [semicolon_text(spark, [_literal(r["path"]) for r in kinds if r["utf8"] == ok], name) for ok, name in ((True, "UTF-8"), (False, "ISO-8859-1")) if any(r["utf8"] == ok for r in kinds)]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.na.fill("")


def _literal(path: str) -> str:
    """A path whose characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def zipped_text(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """path, text: the first ``prefix*.txt`` of each ZIP file; bytes that are not UTF-8 are replaced. No other member is opened."""
    import io
    import zipfile

    def unpack(batches):
        for pdf in batches:
            texts = []
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = sorted(n for n in z.namelist() if n.rsplit("/", 1)[-1].startswith(prefix) and n.lower().endswith(".txt"))
                    texts.append(z.read(names[0]).decode("utf-8", "replace") if names else None)
            yield pdf.assign(text=texts)[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, text string")


def discharge_rows(rows: DataFrame) -> DataFrame:
    """Nine columns by place: record, name, admission, specialty, discharge, place without its ``L:``, exit. Rows without a record go."""
    c = [F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in rows.columns]
    number = c[1].try_cast("double")
    record = F.when(number.isNotNull(), number.cast("long").cast("string")).otherwise(c[1])
    place = F.trim(F.regexp_replace(c[7], "^L:", ""))
    out = rows.select(record.alias("prontuario"), c[2].alias("nome"), c[3].alias("data_internacao"), c[5].alias("especialidade"), c[6].alias("alta_em"), place.alias("leito"), c[8].alias("saida_em"))
    return out.filter("prontuario <> ''")


def words_to_lines(words: DataFrame, keys: list[str], tolerance: float = 1.5) -> DataFrame:
    """keys, band, line: words (x, y, text) of a page in bands of x, each from top to bottom."""
    from tidewell.operators.series import bands

    banded = bands(words, keys, "x", tolerance)
    parts = F.array_sort(F.collect_list(F.struct("y", "text")))
    return banded.groupBy(*keys, "band").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line"))


def ward_blocks(texts: DataFrame, key: str, text: str, marker: str = "Unidade", header: tuple[str, ...] = ("Leito", "Status", "Acomodação", "Ativo")) -> DataFrame:
    """key, code, ward, position, bed, status, kind, active: the beds of each block behind ``marker``, four lines a bed until ``Total``.

    A block begins with its code, a number of six digits at most; the last line before the header is the ward's name.
    """
    block = texts.select(key, F.posexplode(F.split(F.col(text), marker)).alias("_b", "_t")).filter("_b > 0")
    lines = F.filter(F.transform(F.split("_t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    block = block.select(key, "_b", lines.alias("l")).filter(F.get("l", F.lit(0)).rlike("^[0-9]{1,6}$"))
    head = F.array_position("l", header[0])
    total = F.array_position("l", "Total")
    last = F.when(total > 0, total - 1).otherwise(F.size("l"))
    block = block.filter(head > 1).withColumns({"_h": head, "_n": F.floor(F.greatest(last - head - 3, F.lit(0)) / 4).cast("int")}).filter("_n > 0")
    bed = block.select(key, F.col("l")[0].alias("code"), F.when(F.col("_h") > 2, F.get("l", F.col("_h") - 2)).otherwise("").alias("ward"), "l", "_h", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("position"))
    value = lambda k: F.get("l", F.col("_h") + 3 + F.col("position") * 4 + k)
    return bed.select(key, "code", "ward", "position", value(0).alias("bed"), value(1).alias("status"), value(2).alias("kind"), value(3).alias("active"))


def write_workbook(rows: DataFrame, path: str, *order: str) -> None:
    """``write_report`` as XLSX files, one for each task."""
    workbooks(rows.sparkSession)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    rows.write.format("workbook").mode("overwrite").save(path)


def write_report(rows: DataFrame, path: str, *order: str) -> None:
    """One header a file; readers get the order from the columns, files are by ranges of it."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    rows.write.mode("overwrite").csv(path, header=True)


def search_results(rows: DataFrame, text: str, length: int = 300) -> DataFrame:
    """A column ``json`` of the row with its text cut."""
    return rows.withColumn(text, F.substring(text, 1, length)).select(F.to_json(F.struct(*rows.columns)).alias("json"))


def flattened(results: DataFrame, sector: str, patients: str) -> DataFrame:
    """A row for each patient of each sector; sectors without one stay out."""
    return results.select(sector, F.explode(patients).alias("_p")).select(sector, "_p.*")


def table_rows(pages: DataFrame, key: str, html: Column, row: str, cell: str, row_key: str) -> DataFrame:
    """key, position, row_key, cells of every table row of a page: patterns with one group each; a missing key is ``row-<position>``."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(0))).alias("position", "_row"))
    found = F.regexp_extract("_row", row_key, 1)
    cells = F.transform(F.regexp_extract_all("_row", F.lit(cell), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return rows.select(key, "position", F.when(found != "", found).otherwise(F.concat(F.lit("row-"), F.col("position").cast("string"))).alias("row_key"), cells.alias("cells"))


def embedded_json(html: Column, schema: str) -> Column:
    """The JSON of the page's first JSON script; null if there is none or it is broken."""
    body = F.regexp_extract(html, r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(body, F.lit("")), schema)


def preformatted(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?s)<pre[^>]*>(.*?)</pre>", 1), F.lit(""))


_ITEM = "map<string,string>"


def snapshot_items(json: DataFrame, column: str, required: tuple[str, ...] = ("admissionKey", "admissionStart")) -> DataFrame:
    """A row for each item of the JSON lists that has all required keys filled; a map of its fields as ``item``."""
    items = json.select(*json.columns, F.explode(F.from_json(column, f"array<{_ITEM}>")).alias("item"))
    for k in required:
        items = items.filter(F.coalesce(F.col("item")[k], F.lit("")) != "")
    return items


def event_item(item: Column) -> Column:
    """happened_at, signed_at, author, profession, content, signature of an item with camelCase or snake_case keys, the first filled."""
    from tidewell.functions.strings import first_filled

    pick = lambda *names: first_filled(*[item[n] for n in names])
    return F.struct(
        pick("happenedAt", "happened_at", "createdAt", "created_at").alias("happened_at"), pick("signedAt", "signed_at").alias("signed_at"), pick("authorName", "author_name", "createdBy", "created_by").alias("author"),
        pick("professionType", "profession_type", "type").alias("profession"), pick("contentText", "content_text", "content").alias("content"), pick("signatureLine", "signature_line").alias("signature"),
        F.to_json(item).alias("raw"),
    )


def catalog_documents(rows: DataFrame, column: str) -> DataFrame:
    """Catalog documents as groups and codes, with the digest of the very text."""
    schema = "effective_from date, schema_version string, groups array<struct<stable_key:string,display_name:string,official_capacity:int,calculation_policy:string,source_codes:array<struct<source_code:string,age_selector:string>>>>"
    doc = rows.select(F.sha2(column, 256).alias("digest"), F.from_json(column, schema).alias("d")).select("digest", "d.effective_from", "d.schema_version", F.explode("d.groups").alias("g"))
    return doc.select("digest", "effective_from", "schema_version", "g.stable_key", "g.official_capacity", "g.calculation_policy", F.explode_outer("g.source_codes").alias("c")).select("*", "c.*").drop("c")

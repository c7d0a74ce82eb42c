"""File queries: customers of a nation as a spreadsheet or as comma-separated values, some of them broken."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.plans.tables import read
from corpusloom.sources import office

MOST_ROWS = 40
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def spreadsheet(sheets: dict[str, list[list[str]]]) -> bytes:
    """A zipped workbook of inline strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{_RELATION}"><sheets>{named}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            cell = lambda c: f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>'
            body = "".join(f'<row r="{n}">{"".join(map(cell, r))}</row>' for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _files(spark, sf_dir):
    """A file of each nation, as the binary reader gives them: even ones spreadsheets, odd ones CSV, every seventh cut off."""

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        nation, rows = key[0], rows.sort_values("c_custkey")
        cells = [["key", "name", "segment"], *rows[["c_custkey", "c_name", "c_mktsegment"]].astype(str).values.tolist()]
        sheet = nation % 2 == 0
        content = spreadsheet({"customers": cells, "empty": []}) if sheet else "\n".join(",".join(r) for r in cells).encode()
        if nation % 7 == 0:
            content = content[: len(content) // 2] if sheet else content
        path = f"mem:/n{nation}.{'xlsx' if sheet else 'csv'}"
        return pd.DataFrame({"path": [path], "content": [content], "length": [len(content)], "modificationTime": [pd.Timestamp(0, tz="UTC")]})

    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    return c.groupBy("c_nationkey").applyInPandas(pack, "path string, content binary, length long, modificationTime timestamp")


def loaded_files(spark, sf_dir):
    d = office.documents(office.parsed(_files(spark, sf_dir), most_rows=MOST_ROWS))
    return d.select("source", "part", "title", "n_rows", F.array_join("headers", ",").alias("headers"), F.md5("text").alias("text_md5"))


def failed_files(spark, sf_dir):
    f = office.failures(office.parsed(_files(spark, sf_dir), most_rows=MOST_ROWS))
    return f.select("path", F.element_at(F.split("error", ":"), 1).alias("error"))


QUERIES = {f.__name__: f for f in (loaded_files, failed_files)}
ORACLES = {
    "loaded_files": f"""WITH c AS (SELECT c_nationkey AS n, '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)
SELECT 'n' || n || CASE WHEN n % 2 = 0 THEN '.xlsx' ELSE '.csv' END AS source, (k // {MOST_ROWS})::INT AS part, CASE WHEN n % 2 = 0 THEN 'customers' END AS title, count(*)::INT AS n_rows, 'key,name,segment' AS headers,
  md5('| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY k)) AS text_md5
FROM c WHERE n % 14 <> 0 GROUP BY n, k // {MOST_ROWS}""",
    "failed_files": "SELECT DISTINCT 'mem:/n' || c_nationkey || '.xlsx' AS path, 'BadZipFile' AS error FROM customer WHERE c_nationkey % 14 = 0",
}

"""Folders of files that the test writes come back as documents, broken ones as failures."""

import io
import zipfile

from corpusloom.plans.files_of import spreadsheet
from corpusloom.sources import office

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def workbook():
    """Shared strings, numbers, booleans, errors, gaps, merged cells, two sheets."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="u"><sheets><sheet name="A &amp; B" sheetId="7" r:id="x2"/><sheet name="two" sheetId="8" r:id="x1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R xmlns="u"><Relationship Id="x1" Target="/xl/s1.xml"/><Relationship Id="x2" Target="worksheets/s2.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>drug</t></si><si><r><t>do</t></r><r><t>se</t></r></si><si><t>asp|irin</t></si><si><t>日</t><rPh><t>nichi</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s2.xml", f"""<worksheet xmlns="{MAIN}"><sheetData>
            <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1"><v>4</v></c></row>
            <row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c><c r="AB3" t="b"><v>1</v></c></row>
            <row r="4"><c r="B4"><v>2</v></c><c r="D4" t="e"><v>#N/A</v></c></row>
            <row r="5"><c r="A5" t="s"><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="B4:B5"/></mergeCells></worksheet>""")
        z.writestr("xl/s1.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
    return out.getvalue()


def word():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
        cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
        table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("k", "v"), ("a", "1"), ("", "2"))) + "</w:tbl>"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{p("Title", "Heading1")}{p("One")}<w:p/>{table}{p("Two", "Heading 2")}</w:body></w:document>')
    return out.getvalue()


def test_folder(spark, tmp_path):
    files = {
        "a.txt": "héllo".encode(), "b.MD": "# x".encode(), "gbk.txt": "发热三天".encode("gbk"), "empty.txt": b" \n", "c.csv": "k,v,none\na,1,\n,2,\n\n".encode(),
        "latin.csv": "k\né\n".encode("latin-1"), "d.xlsx": workbook(), "e.docx": word(), "sub/f.xlsx": spreadsheet({"s": [["n"], *[[str(k)] for k in range(450)]]}),
        "broken.xlsx": workbook()[:200], "nodoc.docx": spreadsheet({}), "scan.pdf": b"%PDF", "pic.png": b"x", "other.exe": b"x", "bad.txt": b"\xff\xff\xff",
    }
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    loaded = office.load_folder(spark, f"file://{tmp_path}", {"pdf": lambda content, most: [office.Part(f"pages of {len(content)} bytes", "p1"), office.Part("more")]})
    got = {}
    for r in office.documents(loaded).collect():
        got.setdefault(r["source"], []).append(r)
    text = {n: [r["text"] for r in sorted(rs, key=lambda r: r["part"])] for n, rs in got.items()}
    assert text["a.txt"] == ["héllo"] and text["b.MD"] == ["# x"] and text["gbk.txt"] == ["发热三天"] and "empty.txt" not in text
    assert text["c.csv"] == ["| k | v |\n| --- | --- |\n| a | 1 |\n| a | 2 |"] and text["latin.csv"] == ["| k |\n| --- |\n| é |"]
    assert text["d.xlsx"] == ["| drug | dose | Unnamed: 27 |\n| --- | --- | --- |\n| asp\\|irin | 1.5 | True |\n| asp\\|irin | 2 | True |\n| 日 | 2 | True |"]
    assert got["d.xlsx"][0]["title"] == "A & B" and got["d.xlsx"][0]["headers"] == ["drug", "dose", "Unnamed: 27"]
    assert text["e.docx"] == ["# Title\n\nOne\n\n| k | v |\n| --- | --- |\n| a | 1 |\n| a | 2 |\n\n## Two"]
    assert [r["n_rows"] for r in sorted(got["f.xlsx"], key=lambda r: r["part"])] == [200, 200, 50]
    assert [line for t in text["f.xlsx"] for line in t.split("\n")[2:]] == [f"| {k} |" for k in range(450)]
    assert text["scan.pdf"] == ["pages of 4 bytes", "more"]
    r = got["a.txt"][0]
    assert (r["file_type"], r["file_size"], len(r["doc_hash"])) == ("txt", 6, 8) and r["modified_at"] is not None and not r["is_table"]
    failed = {r["path"].rpartition("/")[2]: r["error"] for r in office.failures(loaded).collect()}
    assert set(failed) == {"broken.xlsx", "nodoc.docx", "pic.png", "bad.txt"} and "no parser for .png" in failed["pic.png"]


def test_no_files(spark, tmp_path):
    assert office.load_folder(spark, f"file://{tmp_path}").collect() == []

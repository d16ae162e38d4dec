import io
import zipfile

from sievetide.sources import parsers


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in files.items():
            z.writestr(n, data)
    return bytearray(out.getvalue())


def test_docx(spark):
    body = "<w:document><w:body><w:p><w:r><w:t>One &amp;</w:t></w:r><w:r><w:t xml:space='preserve'> two</w:t></w:r></w:p><w:p ><w:t>three</w:t></w:p></w:body></w:document>"
    df = spark.createDataFrame([(zipped({"word/document.xml": body}),), (bytearray(b"no"),), (None,)], "content binary")
    assert [r[0] for r in df.select(parsers.docx_text("content")).collect()] == ["One & two\nthree", "", ""]


def test_workbook(spark):
    sheet = '<worksheet><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="str"><f>A1</f><v>lost &lt;x</v></c><c r="AA1"><v>7</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>in</t></is></c><c r="B2"/></row></worksheet>'
    book = zipped({"xl/sharedStrings.xml": "<sst><si><r><t>sha</t></r><r><t>red</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    df = spark.createDataFrame([("b.xlsx", book), ("bad.xlsx", bytearray(b"no")), ("none.xlsx", None)], "path string, content binary")
    got = {(r.row, r.col): r.value for r in parsers.workbook_cells(df).collect()}
    assert got == {(1, 1): "shared", (1, 2): "lost <x", (1, 27): "7", (2, 1): "in"}

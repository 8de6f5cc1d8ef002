"""Converters: HTML, sheets, PDF and OCR lines, code, RTF, binary files, dispatch and options."""

import io
import zipfile
import zlib

import pytest

from inkmill.functions import files, html, plain, sheets
from inkmill.options import Options


def test_html_headings_emphasis_links_and_lists():
    page = '<h1>Café &amp; thé</h1><p>Un <strong>mot</strong> <em>fin</em> <a href="https://x.y/z">lien</a></p><ul><li>un</li><li>deux</li></ul>'
    assert html.to_markdown(page) == "# Café & thé\n\nUn **mot** _fin_ [lien](https://x.y/z)\n\n- un\n- deux"


def test_html_drops_scripts_and_keeps_navigation():
    page = "<head><title>t</title></head><nav><a href=/a>A</a></nav><style>p{}</style><script>var t='</p>';</script><!-- c --><p>x<p>y<footer>f</footer>"
    assert html.to_markdown(page) == "[A](/a)\n\nx\n\ny\n\nf"


def test_html_nested_and_ordered_lists():
    assert html.to_markdown("<ol start=3><li>a<ul><li>b</li></ul></li><li>c</ol>") == "3. a\n   - b\n4. c"


def test_html_tables_code_and_images():
    assert html.to_markdown('<table><tr><th align="right">A</th><th>B</th></tr><tr><td>1|2</td></tr></table>') == "| A | B |\n| ---: | --- |\n| 1\\|2 |  |"
    assert html.to_markdown('<pre><code class="language-js">a *b*\n</code></pre>') == "```js\na *b*\n```"
    assert html.to_markdown('<img alt="Plan" src="data:image/png;base64,AA"><img src="a.png" alt="x">') == "[Image: Plan]![x](a.png)"
    assert html.to_markdown("<del>a</del> <code>b`c</code><hr>1 * 2_3") == "~~a~~ ``b`c``\n\n* * *\n\n1 \\* 2\\_3"
    assert html.to_markdown("<ul><li><input type=checkbox checked> fait</li></ul>") == "- [x] fait"


def test_html_of_nothing_and_of_broken_markup():
    assert html.to_markdown(None) == html.to_markdown("") == ""
    assert html.to_markdown("<p><b>gras<p>suite</i>") .count("suite") == 1


ROWS = [["Produit", "Prix", "Stock"], ["Clavier", "49.9", "12"], ["Souris", "19.9", "40"]]


def test_sheets():
    assert sheets.to_markdown([("Ventes", ROWS)]) == "|Produit|Prix|Stock|\n|---|---|---|\n|Clavier|49.9|12|\n|Souris|19.9|40|"
    assert sheets.to_markdown([("V", ROWS)], "table").startswith("| Produit | Prix | Stock |\n| --- | --- | --- |")
    records = sheets.to_markdown([("V", [["a", ""], ["1", "x|y"], ["", " "], ["3"]])], "records")
    assert records == "- [Ligne 1] **a**: 1 | **Col_2**: x|y\n- [Ligne 2] **a**: 3"
    two = sheets.to_markdown([("A", ROWS), ("B", [[" "]]), ("C", [])])
    assert two.startswith("## Feuille: A\n") and "## Feuille: B" in two and "Feuille: C" not in two
    long = sheets.to_markdown([("L", [["n"], *([str(i)] for i in range(1_200))])])
    assert "Table tronquée: 200 lignes" in long and "|999|" in long and "|1000|" not in long
    assert sheets.to_markdown([("P", [["a|b"], ["c\r\nd", "e"]])]) == "|a\\|b|Col_2|\n|---|---|\n|c d|e|"


def test_csv_and_xlsx():
    assert files.convert(b"a;b\n1;2\n", "t.csv")["markdown"] == "|a|b|\n|---|---|\n|1|2|"
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Nom</t></si></sst>')
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Prix</t></is></c></row><row r="3"><c r="A3"><v>3</v></c><c r="C3"><v>2.5</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    assert files.convert(out.getvalue(), "t.xlsx")["markdown"] == "|Nom|Col_2|Prix|\n|---|---|---|\n|3||2.5|"


def test_pdf_lines():
    text = "Page 1 of 3\nINTRODUCTION\nCeci est une phrase cou-\npée en deux\nlignes.\n• un\n3) trois\na) lettre\nx   y   z\n1a   2   b\n- 2 -\n2.1 Titre\nfin 1.5 million"
    assert plain.from_pdf_lines(text) == (
        "## INTRODUCTION\n\nCeci est une phrase coupée en deux lignes.\n- un\n3. trois\n- lettre\n|x|y|z|\n|---|---|---|\n|1a|2|b|\n\n### 2.1 Titre\n\nfin 1.5 million"
    )
    assert plain.from_pdf_lines("a   b") == "a | b" and plain.from_pdf_lines("Chapitre 1: Début") == "# Chapitre 1: Début"
    assert plain.from_pdf_lines(None) == ""


def test_ocr_lines():
    assert plain.from_ocr_lines("RAPPORT\n\n\n• a\nb", 87.5) == "> 📷 *Texte extrait par OCR (Confiance: 88%)*\n\n## RAPPORT\n\n- a\nb"


def test_code_json_and_rtf():
    assert plain.from_text("a ```` b\n\n", "x.ts") == "`````ts\na ```` b\n`````"
    assert plain.from_text('{"b":1.0,"a":[1,"é"]}', "x.json") == '```json\n{\n  "b": 1,\n  "a": [\n    1,\n    "é"\n  ]\n}\n```'
    assert plain.from_text("{bad", "x.json") == "```json\n{bad\n```" and plain.from_text("FROM x", "Dockerfile") == "```dockerfile\nFROM x\n```"
    assert plain.from_text("{\\rtf1\\b caf\\'e9}", "x.txt") == "café"


def pdf(lines: list[str], packed: bool = False) -> bytes:
    body = "BT /F1 12 Tf 72 720 Td " + " T* ".join(f"({x}) Tj" for x in lines) + " ET"
    data = zlib.compress(body.encode("cp1252")) if packed else body.encode("cp1252")
    head = f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>"
    return b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 1 >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj " + head.encode() + b"\nstream\n" + data + b"\nendstream endobj\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_files(packed):
    out = files.convert(pdf(["RAPPORT ANNUEL", "Une phrase \\(courte\\).", "- un", "- deux"], packed), "r.pdf")
    assert out["markdown"] == "## RAPPORT ANNUEL\n\nUne phrase (courte).\n- un\n- deux" and out["pages"] == 1 and out["error"] is None
    assert files.convert(b"%PDF-1.4\n<< /Type /Page >>", "scan.pdf")["warnings"] == [files.NO_TEXT]


def test_docx_files():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Titre</w:t></w:r></w:p>'
        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>gras</w:t></w:r><w:r><w:t> suite</w:t></w:r></w:p>"
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>un</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert files.convert(out.getvalue(), "a.docx")["markdown"] == "# Titre\n\n**gras** suite\n\n- un\n\n| a | b |\n| --- | --- |"


@pytest.mark.parametrize(
    ("name", "mime", "want"),
    [("x.pdf", "text/html", "pdf"), ("x.txt", "text/html", "html"), ("x.DOC", "", "doc"), ("x", "image/png", "image"), ("x.md", "", "text"), ("x.xlsx", "application/pdf", "pdf")],
)
def test_dispatch(name, mime, want):
    assert files.format_of(name, mime) == want


def test_files_that_cannot_be_read_are_errors():
    for name, content in (("a.doc", b"x"), ("a.docx", b"not a zip"), ("a.png", b"x"), ("a.xls", b"\xd0\xcf\x11\xe0"), ("a.pdf", b"x")):
        out = files.convert(content, name)
        assert out["markdown"] is None and out["error"].startswith(f"Failed to convert {name}: ")
    assert files.convert(None, None)["markdown"] == ""


def test_options():
    o = Options.from_mapping({"level": "odd", "chunkMaxTokens": "1", "chunkOverlapTokens": "0", "compactTables": "false", "chunkMinTokens": "12abc", "anonymizeMode": "x", "projectTitle": "t" * 300})
    assert (o.level, o.chunk_max_tokens, o.chunk_overlap_tokens, o.compact_tables, o.chunk_min_tokens, o.anonymize_mode, len(o.title)) == ("clean", 50, 0, False, 12, "pseudonymize", 200)
    assert Options.from_mapping({}) == Options() and Options.from_mapping({"chunkMaxTokens": "99999"}).chunk_max_tokens == 8000
    form = Options.from_form({"chunkMaxTokens": 400, "overlapPercent": 10, "compactTables": False})
    assert form.chunk_overlap_tokens == 40 and form.table_format == "table"

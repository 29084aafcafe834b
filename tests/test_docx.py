"""Word files built by hand: styles, list numbers, page breaks and banners up to the outline."""

import io
import zipfile

from quire.operators import documents as dc
from quire.sources import files as sf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr><w:sz w:val="22"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="Item"><w:basedOn w:val="Base"/><w:rPr><w:b/><w:sz w:val="30"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Loop"><w:basedOn w:val="Loop"/></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%2)"/></w:lvl><w:lvl w:ilvl="2"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>"""


def par(text, style="", num=None, run="", extra=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr>{extra}<w:t>{text}</w:t></w:r></w:p>"


def docx(*pars, styles=STYLES, numbering=NUMBERING):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(pars)}</w:body></w:document>")
        for name, part in (("styles", styles), ("numbering", numbering)):
            if part:
                z.writestr(f"word/{name}.xml", part)
    return bytearray(out.getvalue())


def blocks(spark, **docs):
    return sf.docx_blocks(spark.createDataFrame([(f"/{k}.docx", v, k) for k, v in docs.items()], "path string, content binary, doc_id string"))


def test_numbers_styles_and_pages(spark):
    first = docx(
        par("Scope", num=("1", 0)), par("by style", "Item"), par("again", "Item", run='<w:b w:val="0"/>'), par("", num=("1", 0)), par("dot", num=("1", 2)),
        par("Terms", num=("1", 0), extra='<w:br w:type="page"/>'), par("From five", num=("2", 0)), par("plain", "Loop"),
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    )
    second = docx(par("one"), par("two", extra="<w:lastRenderedPageBreak/>"), styles=None, numbering=None)
    got = {d: [r for r in blocks(spark, a=first, b=second).orderBy("block_no").collect() if r["doc_id"] == d] for d in "ab"}
    assert [(r["text"], r["number"], r["level"], r["list_format"]) for r in got["a"]] == [
        ("Scope", "1.", 1, "decimal"), ("by style", "a)", 2, "lowerLetter"), ("again", "b)", 2, "lowerLetter"), ("dot", None, 3, "bullet"), ("Terms", "2.", 1, "decimal"),
        ("From five", "5.", 1, "decimal"), ("plain", None, None, None), ("| a\\|b |\n| --- |", None, None, None),
    ]
    assert [(r["bold"], r["size"]) for r in got["a"]][:3] == [(False, 11.0), (True, 15.0), (False, 15.0)]
    assert [r["page"] for r in got["a"]] == [1, 1, 1, 1, 2, 2, 2, 2] and {r["page_source"] for r in got["a"]} == {"page_break"}
    assert [(r["page"], r["page_source"], r["size"]) for r in got["b"]] == [(1, "rendered", 0.0), (2, "rendered", 0.0)]


def test_outline_of_word_numbers_and_banners(spark):
    big = '<w:sz w:val="40"/>'
    doc = docx(
        par("GENERAL RULES", run=big), par("FOR ALL STAFF", run=big), par("Scope of it", num=("1", 0)), par("which lines say", "Item"), par("Some body text that is the longest of the lines here."),
        par("ĐIỀU 4 TERMS", num=("1", 0)), par("CLOSING NOTES", run=big), par("The end."),
    )
    out = dc.detect_headings(blocks(spark, a=doc)).orderBy("block_no").collect()
    heads = [(r["number"], r["title"], r["level"], r["heading_kind"]) for r in out if r["kind"] == "heading"]
    assert heads == [("", "GENERAL RULES FOR ALL STAFF", 1, "banner"), ("1.", "Scope of it", 3, "decimal"), ("a)", "which lines say", 4, "decimal"), ("ĐIỀU 4", "TERMS", 2, "article"), ("", "CLOSING NOTES", 1, "banner")]
    assert [r["text"] for r in out][:2] == ["GENERAL RULES FOR ALL STAFF", ""]
    assert dc.chunks(dc.detect_headings(blocks(spark, a=doc))).count() > 0
    assert dc.detect_headings(blocks(spark, a=docx())).count() == 0

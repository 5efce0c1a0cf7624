"""Word reports of single results, written with the standard library; for a corpus, inside mapInPandas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax import saxutils

#: Fixed values of the format.
MAIN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
STYLE_RELATION = RELATIONS.replace("officeDocument\" Target=\"word/document.xml", "styles\" Target=\"styles.xml")
#: Margins in twentieths of a point, font, size in half points.
MARGINS, FONT, SIZE = (1008, 1152), "Arial", 21


#: Paragraph styles: id, name, bold, size in half points, left indent in twentieths of a point.
STYLES = [("Normal", "Normal", False, SIZE, 0), ("Title", "Title", True, 32, 0), ("Heading1", "heading 1", True, 26, 0), ("ListBullet", "List Bullet", False, SIZE, 360), ("ListNumber", "List Number", False, SIZE, 360)]


#: Characters that XML cannot hold, escaped or not.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def escape(text: str) -> str:
    """Text as XML; what XML cannot hold is left out, so that no text makes a file that cannot be read."""
    return saxutils.escape(NOT_XML.sub("", text))


def styles() -> str:
    one = lambda i, name, bold, size, indent: (
        f'<w:style w:type="paragraph" w:styleId="{i}"{" w:default=" + chr(34) + "1" + chr(34) if i == "Normal" else ""}><w:name w:val="{name}"/><w:pPr>{f"<w:ind w:left={chr(34)}{indent}{chr(34)} w:hanging={chr(34)}{indent}{chr(34)}/>" if indent else ""}</w:pPr>'
        f'<w:rPr><w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}"/>{"<w:b/>" * bold}<w:sz w:val="{size}"/></w:rPr></w:style>'
    )
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:styles {MAIN}>{"".join(one(*s) for s in STYLES)}</w:styles>'


class Report:
    """Collects headings, paragraphs, bullets and tables, and gives the bytes of a .docx file."""

    def __init__(self, title: str):
        self.parts: list[str] = []
        self.paragraph(title, "Title")

    def paragraph(self, text: str, style: str = "Normal") -> Report:
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in str(text).split("\n"))
        self.parts.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r>{lines}</w:r></w:p>')
        return self

    def heading(self, text: str) -> Report:
        return self.paragraph(text, "Heading1")

    def bullets(self, values: Iterable[str], instead: str | None = None, numbered: bool = False) -> Report:
        values = list(values) or ([instead] if instead else [])
        for i, v in enumerate(values, 1):
            self.paragraph(f"{i}. {v}" if numbered else f"• {v}", "ListNumber" if numbered else "ListBullet")
        return self

    def table(self, rows: Iterable[Iterable[object]]) -> Report:
        edge = "".join(f'<w:{e} w:val="single" w:sz="4"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
        cells = lambda row: "".join(f"<w:tc><w:p><w:r><w:t xml:space=\"preserve\">{escape(str(c))}</w:t></w:r></w:p></w:tc>" for c in row)
        body = "".join(f"<w:tr>{cells(row)}</w:tr>" for row in rows)
        self.parts.append(f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>{body}</w:tbl><w:p/>")
        return self

    def save(self) -> bytes:
        top, side = MARGINS
        end = f'<w:sectPr><w:pgMar w:top="{top}" w:bottom="{top}" w:left="{side}" w:right="{side}"/></w:sectPr>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", TYPES)
            z.writestr("_rels/.rels", RELATIONS)
            z.writestr("word/_rels/document.xml.rels", STYLE_RELATION)
            z.writestr("word/styles.xml", styles())
            z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {MAIN}><w:body>{"".join(self.parts)}{end}</w:body></w:document>')
        return out.getvalue()


def outline_report(outline: dict, source: str) -> bytes:
    o = outline["service_overview"]
    r = Report("Business Requirements Document").paragraph(f"Source: {source}").paragraph("Preliminary; human review is required.")
    r.table([("Service name", o["service_name"]), ("Service purpose", o["service_purpose"]), ("Service scope", o["service_scope"])])
    named = ("stakeholders", "service_recipients", "functional_requirements", "non_functional_requirements", "business_rules", "process_steps", "required_data_and_documents", "integration_requirements", "missing_information", "human_review_notes")
    for i, key in enumerate(named, 2):
        r.heading(f"{i}. {key.replace('_', ' ').title()}").bullets(outline[key], "Requires confirmation", numbered=key == "process_steps")
    return r.save()


def review_report(review: dict, source: str) -> bytes:
    r = Report("Document Review").table([("Source", source), ("Document type", review["document_type"]), ("Mode", review["review_mode"]), ("Completeness", f"{review['completeness_indicator']}%")])
    r.heading("Section checklist").table([("Section", "Status", "Evidence"), *((c["section"], c["status"], ", ".join(c["evidence"]) or "No clear evidence detected") for c in review["section_checklist"])])
    for key in ("detected_sections", "missing_sections", "wording_issues", "recommendations", "human_review_notes"):
        r.heading(key.replace("_", " ").capitalize()).bullets(review[key], "None detected")
    return r.save()


def comparison_report(c: dict) -> bytes:
    r = Report("Document Comparison").table([("Document A", c["document_a_name"]), ("Document B", c["document_b_name"])])
    r.heading("Summary").table([("Items in A", c["document_a_item_count"]), ("Items in B", c["document_b_item_count"]), ("Coverage", f"{c['coverage_indicator']}%"), *((k.replace("_", " ").capitalize(), v) for k, v in c["summary"].items())])
    for key, name in (("matched_items", "Match"), ("partial_matches", "Partial match"), ("possible_conflicts", "Conflict")):
        r.heading(key.replace("_", " ").capitalize())
        for i, m in enumerate(c[key], 1):
            r.table([(f"{name} {i}", f"{m['similarity_score']:.0%}"), ("A", m["document_a_item"]), ("B", m["document_b_item"]), *((k, m[k]) for k in ("reason", "review_note") if m.get(k))])
        if not c[key]:
            r.paragraph("None detected")
    for key in ("missing_in_document_b", "additional_in_document_b"):
        r.heading(key.replace("_", " ").capitalize())
        r.bullets(c[key]) if c[key] else r.paragraph("None detected")
    return r.heading("Notes").bullets(c["human_review_notes"]).save()

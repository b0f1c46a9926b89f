"""Numbers of a one-page brief, from finished tables; every table that reaches the driver is bounded."""

from __future__ import annotations

import io
import textwrap
import unicodedata
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import first_and_last
from ..schema import SENTIMENTS


def shorten(value: str, limit: int) -> str:
    """One line within `limit` characters, cut at a sentence or a blank in its second half if there is one."""
    line = " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in value).split())
    if len(line) <= limit:
        return line
    head = line[: limit - 3]
    for mark in (". ", " "):
        at = head.rfind(mark)
        if at > len(head) // 2:
            head = head[:at]
            break
    return head.rstrip(" .") + "..."


def leading_themes(themes: DataFrame, n: int = 3) -> DataFrame:
    return themes.orderBy(F.desc("count"), "theme_id").limit(n)


def worst_gaps(gap_rows: DataFrame, n: int = 2) -> DataFrame:
    """The visible groups that are furthest below their reference."""
    fit = (F.col("flag") == "underrepresented") & ~F.col("suppressed") & (F.col("gap_percentage_points") < 0)
    return gap_rows.where(fit).orderBy("gap_percentage_points", "field", "group").limit(n)


def sentiment_shares(affect: DataFrame) -> DataFrame:
    """(scored, unscored, truncated and the percent of each label among scored rows)."""
    scored = F.col("status") == "scored"
    agg = affect.agg(F.count_if(scored).alias("scored"), F.count_if(~scored).alias("unscored"), F.count_if(scored & F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"), *[F.count_if(scored & (F.col("sentiment") == k)).alias(k) for k in SENTIMENTS])
    return agg.select("scored", "unscored", "truncated", *[F.when(F.col("scored") > 0, F.round(100 * F.col(k) / F.col("scored"), 0)).alias(f"{k}_percent") for k in SENTIMENTS])


def build(*, themes: DataFrame, quotes: DataFrame, affect: DataFrame, periods: DataFrame, mode: str, gap_rows: DataFrame, top_questions: DataFrame) -> dict[str, object]:
    """The brief as a plain dict."""
    first = {r["theme_id"]: r["quote"] for r in quotes.where(F.col("quote_no") == 1).select("theme_id", "quote").collect()}
    leading = [{"label": shorten(r["label"], 56), "count": r["count"], "share": r["share"], "quote": shorten(first[r["theme_id"]], 140) if r["theme_id"] in first else None} for r in leading_themes(themes).collect()]
    change = first_and_last(periods).first().asDict() if mode == "date" else None
    return {
        "themes": leading,
        "sentiment": sentiment_shares(affect).first().asDict(),
        "change": change if change and change["n_days"] >= 2 else None,
        "gaps": [{"field": r["field"], "group": shorten(r["group"], 24), "points_below": round(-r["gap_percentage_points"], 1)} for r in worst_gaps(gap_rows).collect()],
        "questions": [{"text": shorten(r["text"], 150), "count": r["comment_count"]} for r in top_questions.collect()],
    }


def paragraphs(brief: dict[str, object]) -> list[tuple[str, str]]:
    """(style, text) of each paragraph in reading order."""
    out = [("title", "Community feedback brief"), ("heading", "Leading themes")]
    for t in brief["themes"]:
        out.append(("text", f"{t['label']}: {t['count']:,} comments ({t['share']:.1%}). " + (f"“{t['quote']}”" if t["quote"] else "No quote available.")))
    s = brief["sentiment"]
    out.append(("heading", "Tone"))
    out.append(("text", ", ".join(f"{s[f'{k}_percent']:.0f}% {k}" for k in SENTIMENTS) + f" of {s['scored']:,} scored comments; {s['unscored']:,} unscored." if s["scored"] else "No sentiment scores are available."))
    c = brief["change"]
    if c:
        out.append(("text", f"Mean tone {c['first_score']:+.2f} on {c['first_day']} to {c['last_score']:+.2f} on {c['last_day']}; {c['undated_comments']:,} undated comments excluded."))
    out.append(("heading", "Representation"))
    out += [("text", f"{g['group']} ({g['field'].removeprefix('subgroup__')}): {g['points_below']:.1f} percentage points below reference") for g in brief["gaps"]] or [("text", "No visible group met the threshold.")]
    out.append(("heading", "Open questions"))
    return out + [("text", f"{i}. {q['text']} ({q['count']:,} comments)") for i, q in enumerate(brief["questions"], 1)]


def to_markdown(brief: dict[str, object]) -> str:
    marks = {"title": "# ", "heading": "## ", "text": ""}
    return "\n\n".join(marks[style] + text for style, text in paragraphs(brief)) + "\n"


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def docx_bytes(brief: dict[str, object]) -> bytes:
    """The brief as an editable document, built with the standard library alone."""
    size = {"title": 32, "heading": 26, "text": 22}
    body = "".join(f'<w:p><w:r><w:rPr>{"" if style == "text" else "<w:b/>"}<w:sz w:val="{size[style]}"/></w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>' for style, text in paragraphs(brief))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_MAIN}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_DOCUMENT}" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()


def _pdf_lines(brief: dict[str, object], width: int = 88) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for style, text in paragraphs(brief):
        out += [(style, line) for line in textwrap.wrap(text, width if style == "text" else width // 2) or [""]]
        out.append(("gap", ""))
    return out


def pdf_bytes(brief: dict[str, object]) -> bytes:
    """The brief as a PDF of A4 pages in a built-in font, made with the standard library alone.

    Characters that the font lacks are shown as question marks; the document and the Markdown have them.
    """
    size = {"title": 18, "heading": 13, "text": 10, "gap": 6}
    pages: list[list[str]] = [[]]
    y = 800
    for style, line in _pdf_lines(brief):
        step = int(size[style] * 1.4)
        if y - step < 40:
            pages.append([])
            y = 800
        y -= step
        shown = line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").decode("cp1252")
        if shown:
            pages[-1].append(f"BT /F{1 if style == 'text' else 2} {size[style]} Tf 50 {y} Td ({shown}) Tj ET")
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] >>"]
    objects += [f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>" for name in ("Helvetica", "Helvetica-Bold")]
    for i, page in enumerate(pages):
        content = "\n".join(page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(content.encode('cp1252'))} >>\nstream\n{content}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{body}\nendobj\n".encode("cp1252")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()

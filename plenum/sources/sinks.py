"""Exports: labelled CSV, JSON with a manifest, review packets; nothing is ever overwritten."""

from __future__ import annotations

import hashlib
import html
import io
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExportError
from ..functions import text
from ..operators.evaluate import concatenated, reservoir_sample


def guard_strings(df: DataFrame) -> DataFrame:
    """Every string column made safe for spreadsheets; numbers stay as they are."""
    return df.select(*[text.spreadsheet_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, folder: str, *, single_file: bool = False) -> None:
    """CSV with a header into a new folder; single_file only for results that one task can hold."""
    out = guard_strings(df)
    (out.coalesce(1) if single_file else out).write.mode("errorifexists").option("header", True).option("quoteAll", False).option("escape", '"').csv(folder)


def labelled_csv_bytes(df: DataFrame, limit: int = 200_000) -> bytes:
    """One CSV file with a byte order mark, for a bounded table."""
    rows = guard_strings(df).limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ExportError("The table is too large for one file; use write_csv.")
    return rows.to_csv(index=False).encode("utf-8-sig")


def _create(path: Path, content: bytes) -> None:
    descriptor = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(descriptor, "wb") as stream:
        stream.write(content)


def export_json(folder: str | Path, payloads: dict[str, object]) -> dict[str, str]:
    """Writes each payload as NAME.json into a new folder and manifest.json last, with the SHA-256 of every file.

    All payloads are serialised before the folder is made, so a failure leaves nothing behind.
    """
    try:
        contents = {f"{name}.json": (json.dumps(value, allow_nan=False, ensure_ascii=False, indent=1) + "\n").encode() for name, value in payloads.items()}
    except (TypeError, ValueError):
        raise ExportError("The results can't be written as JSON.") from None
    folder = Path(folder)
    if folder.exists():
        raise ExportError("The output folder exists already.")
    folder.mkdir(mode=0o700, parents=True)
    sums = {}
    for name, content in contents.items():
        _create(folder / name, content)
        sums[name] = hashlib.sha256(content).hexdigest()
    _create(folder / "manifest.json", (json.dumps({"files": sums}, indent=1) + "\n").encode())
    return sums


def verify_manifest(folder: str | Path) -> bool:
    """Whether every file of a manifest is there and unchanged."""
    folder = Path(folder)
    try:
        listed = json.loads((folder / "manifest.json").read_text())["files"]
        return all(hashlib.sha256((folder / name).read_bytes()).hexdigest() == digest for name, digest in listed.items())
    except (OSError, ValueError, KeyError):
        return False


def script_json(value: object) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(value, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def review_page(title: str, rows: list[dict[str, object]]) -> str:
    """A page that lets a reviewer answer each row and keeps the answers as JSON; the rows stand in it as script-safe JSON."""
    return (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><form id=f></form><pre id=o></pre>"
        f"<script>const rows={script_json(rows)};"
        "for(const [i,r] of rows.entries()){const p=document.createElement('p');p.textContent=Object.values(r).join(' | ');"
        "const a=document.createElement('input');a.name='a'+i;p.append(a);document.getElementById('f').append(p)}"
        "document.getElementById('f').oninput=()=>{document.getElementById('o').textContent=JSON.stringify(Object.fromEntries(new FormData(document.getElementById('f'))))}"
        "</script>"
    )


def _cell(reference: str, value: object) -> str:
    if isinstance(value, str) and value.startswith("="):
        return f'<c r="{reference}"><f>{html.escape(value[1:], quote=False)}</f></c>'
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{html.escape(str(value), quote=False)}</t></is></c>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook_bytes(sheets: dict[str, list[list[object]]]) -> bytes:
    """An XLSX workbook of the given sheets (rows of cells); a text that begins with = is a formula.  Standard library only."""
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    names = list(sheets)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/s{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(names))) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{html.escape(n)}" sheetId="{i + 1}" r:id="s{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>",
    }
    for i, name in enumerate(names):
        rows = "".join(f'<row r="{y}">' + "".join(_cell(f"{_letters(x)}{y}", v) for x, v in enumerate(row)) + "</row>" for y, row in enumerate(sheets[name], 1))
        parts[f"xl/worksheets/s{i}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>{rows}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for path, content in parts.items():
            book.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()


def gap_workbook(rows: DataFrame, limit: int = 20_000) -> bytes:
    """The visible gap rows with formulas that recompute share gap and ratio beside the values, and whether they agree to 1e-12.

    Hidden groups are not in the workbook.
    """
    shown = rows.where(~F.col("suppressed")).orderBy("field", "group").limit(limit + 1).collect()
    if len(shown) > limit:
        raise ExportError("The table is too large for a workbook.")
    sheet: list[list[object]] = [["field", "group", "count", "participation_share", "reference_share", "gap_percentage_points", "representation_ratio", "gap again", "ratio again", "agrees"]]
    for y, r in enumerate(shown, 2):
        again = [f"=(D{y}-E{y})*100", f"=D{y}/E{y}", f"=AND(ABS(H{y}-F{y})<1E-12,ABS(I{y}-G{y})<1E-12)"] if r["representation_ratio"] is not None else [None, None, None]
        sheet.append([*(r[c] for c in ("field", "group", "count", "participation_share", "reference_share", "gap_percentage_points", "representation_ratio")), *again])
    return workbook_bytes({"gaps": sheet})


def line_chart(series: dict[str, list[float | None]], labels: list[str], *, title: str, width: int = 800, height: int = 300) -> str:
    """Lines over ordered labels as SVG; a missing value breaks its line."""
    values = [v for line in series.values() for v in line if v is not None]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span = (high - low) or 1.0
    step = (width - 80) / max(1, len(labels) - 1)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title>']
    for k, (name, line) in enumerate(series.items()):
        runs: list[list[str]] = [[]]
        for x, v in enumerate(line):
            if v is None:
                runs.append([])
            else:
                runs[-1].append(f"{40 + x * step:.1f},{height - 40 - (v - low) / span * (height - 80):.1f}")
        colour = f"hsl({k * 67 % 360} 60% 40%)"
        parts += [f'<polyline fill="none" stroke="{colour}" points="{" ".join(run)}"/>' for run in runs if run]
        parts.append(f'<text x="{width - 36}" y="{20 + 14 * k}" font-size="10" text-anchor="end" fill="{colour}">{html.escape(name)}</text>')
    for x in {0, len(labels) - 1} if labels else ():
        parts.append(f'<text x="{40 + x * step:.1f}" y="{height - 20}" font-size="10">{html.escape(labels[x])}</text>')
    return "".join(parts) + "</svg>"


def stratified_packet(corpora: dict[str, DataFrame], n: int, *, key: str, seed: int, withheld: list[str]) -> DataFrame:
    """A blind packet of n rows of each corpus, drawn by a reservoir."""
    drawn = {name: reservoir_sample(df, n, key=key, seed=seed) for name, df in corpora.items()}
    return blind_packet(concatenated(drawn), withheld)


def blind_packet(df: DataFrame, withheld: list[str]) -> DataFrame:
    """The table for reviewers: without the columns that would give predictions away, with blank answer columns."""
    return df.drop(*withheld).withColumns({"answer": F.lit(""), "reviewer": F.lit(""), "notes": F.lit("")})

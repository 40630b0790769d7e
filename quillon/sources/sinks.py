"""Outputs: Parquet tables by Spark; small documents, sheets and pages by the driver, atomically."""

from __future__ import annotations

import base64
import csv
import html
import io
import itertools
import json
import math
import re
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession



def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """A Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def plain(value):
    """value as strict JSON can hold it: NaN and infinities become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        return plain(value.item())
    return value if value is None or isinstance(value, str | int | bool) else str(value)


def write_atomic(path: str | Path, data: bytes) -> None:
    """A small document through the session's file systems: written beside its place, then renamed over it."""
    spark = SparkSession.active()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    target = hadoop.Path(str(path))
    part = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    files = hadoop.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    over = gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    files.rename(part, target, over)


def write_json(value, path: str | Path) -> None:
    write_atomic(path, (json.dumps(plain(value), ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode())


def _rows(df: DataFrame, most: int) -> list[list]:
    """Header and rows of a small table; a larger one is an error, never cut."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write the table with df.write instead")
    return [list(df.columns), *[[plain(v) for v in r] for r in got]]


def write_csv(df: DataFrame, path: str | Path, most: int = 100_000) -> None:
    out = io.StringIO()
    csv.writer(out).writerows(_rows(df, most))
    write_atomic(path, out.getvalue().encode())


def _cell(value, at: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def write_workbook(sheets: Mapping[str, DataFrame], path: str | Path, row_limit: int = 100_000) -> None:
    """An .xlsx of small tables with a frozen header; a table of more than row_limit rows is an error."""
    names = list(sheets)
    if len({n[:31] for n in names}) != len(names):
        raise ValueError("sheet names clash within 31 characters")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, df) in enumerate(sheets.items(), 1):
            rows = _rows(df, row_limit)
            body = "".join(f'<row r="{r}">' + "".join(_cell(v, f"{_letters(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}">{pane}<sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
    write_atomic(path, buffer.getvalue())


def shown(value, digits: int = 4) -> str:
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "-"
    return f"{value:.{digits}g}" if isinstance(value, float) else str(value)


def _inline(text: str) -> str:
    text = html.escape(text)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    return re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)


def _kind(line: str) -> str:
    """What a line outside fenced code belongs to."""
    text = line.strip()
    if not text:
        return "gap"
    if text[0] == "|" and text[-1] == "|" and len(text) > 1:
        return "table"
    if text[:2] in ("- ", "* "):
        return "list"
    level = len(line) - len(line.lstrip("#"))
    return "heading" if 1 <= level <= 6 and line[level : level + 1] == " " else "paragraph"


def _table(lines: list[str]) -> str:
    cells = [[c.strip() for c in re.split(r"(?<!\\)\|", x.strip()[1:-1])] for x in lines]
    rows = [c for c in cells if not all(set(x) <= set(":- ") for x in c)]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{_inline(x)}</td>" for x in c) + "</tr>" for c in rows) + "</table>"


def _heading(line: str) -> str:
    marks, _, title = line.partition(" ")
    return f"<h{len(marks)}>{_inline(title)}</h{len(marks)}>"


RENDERERS = {
    "table": _table,
    "list": lambda lines: "<ul>" + "".join(f"<li>{_inline(x.strip()[2:])}</li>" for x in lines) + "</ul>",
    "heading": lambda lines: "\n".join(map(_heading, lines)),
    "paragraph": lambda lines: "\n".join(f"<p>{_inline(x)}</p>" for x in lines),
    "gap": lambda lines: "",
}


def markdown_html(text: str) -> str:
    """Headings, lists, tables, fenced code and paragraphs as HTML: fences are cut out, then runs of lines of one kind are rendered."""
    made = []
    for n, part in enumerate(re.split(r"(?m)^```.*$\n?", text)):
        if n % 2:
            made.append(f"<pre>{html.escape(part.removesuffix(chr(10)))}</pre>")
        else:
            made += [RENDERERS[kind](list(lines)) for kind, lines in itertools.groupby(part.split("\n"), _kind)]
    return "\n".join(x for x in made if x)


def gallery(images: list[Path], most_bytes: int) -> str:
    """Images inside the page; files that are too large are named instead."""
    parts = []
    for p in images:
        if p.stat().st_size > most_bytes:
            parts.append(f"<p>{html.escape(p.name)} is too large to show</p>")
        else:
            parts.append(f'<figure><img src="data:image/png;base64,{base64.b64encode(p.read_bytes()).decode()}"/><figcaption>{html.escape(p.name)}</figcaption></figure>')
    return "".join(parts)


def render_report(title: str, decided: DataFrame, path: str | Path, text: str = "", images: list[Path] | None = None, cards: Mapping[str, object] | None = None, most_image_bytes: int = 10_000_000) -> None:
    """One self-contained HTML page: cards, the table of metrics with verdicts, text and images."""
    rows = decided.select("key", "report_value", "reproduced_value", "rel_dev", "passed", "reason").collect()
    word = {True: "pass", False: "fail", None: "undecided"}
    table = "".join("<tr>" + "".join(f"<td>{html.escape(shown(v))}</td>" for v in (r[0], r[1], r[2], r[3], word[r[4]], r[5])) + "</tr>" for r in rows)
    top = "".join(f"<div class='card'><b>{html.escape(shown(v))}</b> {html.escape(k)}</div>" for k, v in (cards or {}).items())
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{top}<table><tr><th>metric</th><th>report</th><th>reproduced</th><th>deviation</th><th>verdict</th><th>rule</th></tr>{table}</table>{markdown_html(text)}{gallery(images or [], most_image_bytes)}"
    write_atomic(path, page.encode())

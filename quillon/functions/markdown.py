"""Markdown and front matter as rows, by regular expressions in the JVM; nested front matter by a small table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"


def front_matter(text: Column) -> Column:
    """map<string,string> of the simple `key: value` lines between the first two --- lines."""
    head = F.regexp_extract(text, HEAD, 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w.]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1))
    return F.map_from_entries(last)


KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s"'#\[\]{},:][^:#]*?)\s*:(?:\s+(.*))?$""")
BEFORE_QUOTE = " \t[{,:"  # a quote after anything else is an apostrophe


def uncommented(line: str) -> str:
    quote, before = "", " "
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and before in BEFORE_QUOTE:
            quote = c
        elif c == "#" and before.isspace():
            return line[:i]
        before = c
    return line


def scalar(text: str) -> tuple[str, str | None]:
    """kind and value of a scalar: string, number, boolean or null; quotes go."""
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return "string", text[1:-1]
    if text in ("", "~", "null", "Null", "NULL"):
        return "null", None
    if text.lower() in ("true", "false"):
        return "boolean", text.lower()
    return ("number" if re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text) else "string"), text


def inline_parts(text: str) -> list[str]:
    """What stands between the outer commas of a [...] or {...}."""
    parts, depth, quote, since = [], 0, "", 1
    for i, c in enumerate(text[1:-1], 1):
        if quote or (c in "\"'" and text[i - 1] in BEFORE_QUOTE):
            quote = "" if c == quote else quote or c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append(text[since:i])
            since = i + 1
    return [p.strip() for p in (*parts, text[since:-1]) if p.strip()]


def value_rows(path: str, text: str) -> Iterator[tuple[str, str, str | None]]:
    """Rows of a value on one line, be it a scalar, a list or a map."""
    if text[:1] + text[-1:] not in ("[]", "{}"):
        yield path, *scalar(text)
        return
    parts, is_list = inline_parts(text), text[0] == "["
    yield path, "list" if is_list else "map", str(len(parts))
    for i, part in enumerate(parts):
        name, _, rest = (str(i), "", part) if is_list else part.partition(":")
        yield from value_rows(f"{path}[{i}]" if is_list else f"{path}.{scalar(name.strip())[1]}", rest.strip())


def nested_rows(head: str) -> list[tuple[str, str, str | None]]:
    """(path, kind, value) of indented maps and lists, in order; a part's value is its number of items.

    Of a repeated path the last holds. Lines that are neither an item nor a key are left out, as are comments.
    """
    open_: list[tuple[int, str]] = []  # indentation and path of the parts that a line may belong to
    rows: dict[str, tuple[str, str | None]] = {}
    items: dict[str, int] = {}

    def put(parent: str, kind: str, path: str, text: str) -> None:
        if parent:
            items[parent] = items.get(parent, 0) + (path not in rows)
            rows[parent] = (kind, str(items[parent]))
        for old in [p for p in rows if p.startswith((f"{path}.", f"{path}["))] if path in rows else ():
            del rows[old]
        items.pop(path, None)
        rows.update({p: (k, v) for p, k, v in value_rows(path, text)})

    for line in head.split("\n"):
        text = uncommented(line).rstrip()
        at = len(text) - len(text.lstrip())
        text = text.strip()
        while text:
            is_item = text == "-" or text.startswith("- ")
            while open_ and (open_[-1][0] > at or (open_[-1][0] == at and not (is_item and not open_[-1][1].endswith("]")))):
                open_.pop()  # items may stand right below their key
            parent = open_[-1][1] if open_ else ""
            if is_item and parent:
                path = f"{parent}[{items.get(parent, 0)}]"
                rest = text[1:].lstrip()
                goes_on = bool(KEY.match(rest)) or rest.startswith("- ")
                put(parent, "list", path, "" if goes_on else rest)
                open_.append((at, path))
                at, text = at + len(text) - len(rest), rest if goes_on else ""
                continue
            key = KEY.match(text)
            if key:
                name = key[1].strip("\"'")
                path = f"{parent}.{name}" if parent else name
                put(parent, "map", path, (key[2] or "").strip())
                open_.append((at, path))
            text = ""
    return [(p, *kv) for p, kv in rows.items()]


class _Values:
    def eval(self, head: str):
        yield from nested_rows(head or "")


def front_matter_values(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, path (a.b, a[0].c), kind (map, list, string, number, boolean, null), value: every value of nested front matter.

    Only the head of each text goes to Python. Texts without one have no rows.
    """
    values = F.udtf(_Values, returnType="path string, kind string, value string")
    heads = df.select(*keys, F.regexp_extract(text_col, HEAD, 1).alias("_head")).where("_head <> ''")
    return heads.lateralJoin(values(F.col("_head").outer())).drop("_head")


def table_rows(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, line_no, cells: rows of pipe tables, an escaped pipe being part of its cell; separator lines don't count."""
    lines = df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    rows = lines.where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    return rows.select(*keys, "line_no", row_cells(F.col("line")).alias("cells"))


def row_cells(line: Column) -> Column:
    """The trimmed cells of a table's line; an escaped pipe is part of its cell."""
    inner = F.regexp_replace(line, r"^\s*\||\|\s*$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def table_records(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """keys, line_no, header, cells: the rows below each table's header and separator, to the first line that is no row.

    keys name a text. Lines with pipes but without a separator are no table. A null text has no rows.
    """
    lines = df.select(*keys, F.posexplode(F.split(text_col, r"\r?\n")).alias("line_no", "line"))
    own, no = Window.partitionBy(*keys).orderBy("line_no"), F.col("line_no")
    is_row = F.col("line").rlike(r"^\s*\|(.*\|)?\s*$")
    heads = is_row & F.lead(F.col("line").rlike(r"^\s*\|[\s:-]+(\|[\s:-]+)*\|\s*$"), 1, False).over(own)
    lines = lines.withColumns({"_row": is_row, "_heads": heads, "_run": F.sum((~is_row).cast("long")).over(own)})
    head = F.min(F.when(F.col("_heads") & F.col("_row"), F.struct("line_no", "line"))).over(Window.partitionBy(*keys, "_run"))
    rows = lines.withColumn("_head", head).where(F.col("_row") & (no > F.col("_head.line_no") + 1))
    return rows.select(*keys, "line_no", row_cells(F.col("_head.line")).alias("header"), row_cells(F.col("line")).alias("cells"))


def cell(name: str, header: Column | str = "header", cells: Column | str = "cells") -> Column:
    """The cell below a name, else below the first name that contains it; empty without one."""
    header, cells = (F.col(c) if isinstance(c, str) else c for c in (header, cells))
    at = F.coalesce(F.nullif(F.array_position(header, name), F.lit(0).cast("long")), F.array_position(F.transform(header, lambda h: F.contains(F.lower(h), F.lit(name.lower()))), True))
    return F.coalesce(F.when(at > 0, F.get(cells, at.cast("int") - 1)), F.lit(""))


def id_blocks(df: DataFrame, text_col: str, keys: list[str], level: int = 3) -> DataFrame:
    """keys, block_id, title, body: the parts under headings like `### [D1] title`."""
    mark = "#" * level
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), rf"\n{mark} (?=\[)")
    rows = df.select(*keys, F.posexplode(parts).alias("_at", "part")).where("_at > 0").drop("_at")
    return rows.select(
        *keys,
        F.regexp_extract("part", r"^\[([^\]]+)\]", 1).alias("block_id"),
        F.trim(F.regexp_extract("part", r"^\[[^\]]+\]([^\n]*)", 1)).alias("title"),
        F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"(?s)\n#{1,3} .*\z", "").alias("body"),
    )


def section(text: Column, title: str) -> Column:
    """The text under the first `## title`, up to the next heading of that level."""
    return F.regexp_extract(text, rf"(?s)(?:^|\n)## {title}[^\n]*\n(.*?)(?=\n## |\z)", 1)


def bare_objects(text: Column) -> Column:
    """The outermost {...} of a text, however deep they nest; braces inside JSON strings don't count."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("since"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.array().cast("array<struct<at:int,n:int>>").alias("found"))
    marks = F.regexp_extract_all(text, F.lit(r'[^{}"\\]+|[{}"\\]'), F.lit(0))  # runs without meaning are one mark

    def step(s: Column, mark: Column) -> Column:
        at = s["since"] + F.length(mark)
        opens, closes = ~s["quoted"] & (mark == "{"), ~s["quoted"] & (mark == "}") & (s["depth"] > 0)
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        last = F.element_at(s["found"], -1)
        found = F.when(opens & (s["depth"] == 0), F.concat(s["found"], F.array(F.struct(at.alias("at"), F.lit(0).alias("n"))))).when(
            closes & (depth == 0), F.concat(F.slice(s["found"], F.lit(1), F.size(s["found"]) - 1), F.array(F.struct(last["at"].alias("at"), (at - last["at"] + 1).alias("n"))))
        ).otherwise(s["found"])
        quoted = F.when((mark == '"') & ~s["escaped"] & (s["depth"] > 0), ~s["quoted"]).otherwise(s["quoted"])
        return F.struct(depth.alias("depth"), at.alias("since"), quoted.alias("quoted"), (s["quoted"] & (mark == "\\") & ~s["escaped"]).alias("escaped"), found.cast("array<struct<at:int,n:int>>").alias("found"))

    places = F.aggregate(marks, start, step, lambda s: s["found"])
    return F.transform(F.filter(places, lambda p: p["n"] > 0), lambda p: F.substring(text, p["at"], p["n"]))


def json_in(text: Column, field: str | None = None) -> Column:
    """The JSON of an answer: the whole, else the first fenced block, else the last object that stands bare. With field: one that has it."""

    def valid(c: Column) -> Column:
        doc = F.try_parse_json(c)
        return doc.isNotNull() & (F.length(c) > 0) & (F.try_variant_get(doc, f"$.{field}", "variant").isNotNull() if field else F.lit(True))

    fenced = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n(.*?)\n```"), F.lit(1)), valid)
    whole, bare = F.trim(text), F.filter(bare_objects(text), valid)
    return F.coalesce(F.when(valid(whole), whole), F.try_element_at(fenced, F.lit(1)), F.try_element_at(bare, F.lit(-1)))

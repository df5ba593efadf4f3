"""Parse operators: text columns to frontmatter, sections, tables, lists and code.

The frontmatter boundary is pure Catalyst; YAML and the block structure of a
body go through Arrow UDFs, one call a document. Header and body are separate
expressions, so a query that needs no body never parses one.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from mdlake.operators import _markdown as md

SECTION = (
    "struct<section_no:int,parent_no:int,last_no:int,heading_path:array<string>,id:string,block_id:string,heading:string,level:int,"
    "start_line:int,end_line:int,byte_start:int,byte_content:int,byte_end:int,content:string>"
)
TABLE = "struct<line:int,headers:array<string>,rows:array<struct<line:int,width:int,cells:array<string>>>>"
ITEM = "struct<line:int,raw:string,title:string,description:string>"
BLOCK = "struct<index:int,line:int,language:string,source:string,section:string,tag:string>"


class _Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 core scalars: no yes/no booleans, sexagesimals or dates. The
    parser of the C library where it is installed."""


_Core.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+\.[0-9]*|[0-9]+(?:\.[0-9]*)?[eE][-+]?[0-9]+)$", "-+.0123456789"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
):
    _Core.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def load_yaml(text: str):
    """A YAML document with the core resolvers."""
    return yaml.load(text, Loader=_Core)  # noqa: S506  a SafeLoader


def _mapped(f, kind: str, text: Column) -> Column:
    """``f`` over each non-null text in Arrow batches."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], arrow)

    return F.arrow_udf(run, kind).asNondeterministic()(text)


def split_frontmatter(raw: Column) -> dict[str, Column]:
    """``yaml`` (null without a block) and ``body`` of a text.

    A block opens with ``---`` as the whole first line, after a byte order
    mark at most, and closes at the first ``\\n---`` anywhere; one line end
    after it belongs to it.
    """
    text = F.regexp_replace(raw, r"\A\x{FEFF}", "")
    opened = F.rlike(text, F.lit(r"\A---\r?\n"))
    rest = F.substring(text, 4, 2_000_000_000)  # from the line end after the opening mark
    end = F.instr(rest, "\n---")
    has = opened & (end > 0)
    head = F.substr(rest, F.lit(1), end)
    body = F.regexp_replace(F.substr(rest, end + 4, F.length(rest)), r"\A\r?\n", "")
    return {"yaml": F.when(has, head), "body": F.when(has, body).otherwise(text), "text": text}


def _yaml_json(text: str) -> str | None:
    try:
        value = load_yaml(text)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else ("null" if value is None else None)
    except (yaml.YAMLError, ValueError, TypeError):
        return None


def with_header(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``fm_json``, ``fm_status`` (present, absent or malformed) and ``body``.

    Null and empty frontmatter count as absent; a malformed one leaves the
    whole text as the body.
    """
    parts = split_frontmatter(F.col(raw))
    out = docs.withColumns({"_yaml": parts["yaml"], "_body": parts["body"], "_text": parts["text"]})
    out = out.withColumn("_json", F.when(F.col("_yaml").isNotNull(), _mapped(_yaml_json, "string", F.coalesce("_yaml", F.lit("")))))
    status = F.when(F.col("_yaml").isNull() | (F.col("_json") == "null"), "absent").when(F.col("_json").isNull(), "malformed").otherwise("present")
    out = out.withColumn("fm_status", status)
    return out.withColumns(
        {
            "fm_json": F.when(F.col("fm_status") == "present", F.col("_json")),
            "body": F.when(F.col("fm_status") == "malformed", F.col("_text")).otherwise(F.col("_body")),
        }
    ).drop("_yaml", "_body", "_text", "_json")


def fm(path: str, kind: str = "string", column: str = "fm_json") -> Column:
    """A frontmatter value by a dotted path."""
    return F.try_variant_get(F.try_parse_json(column), "$." + path, kind)


def members(docs: DataFrame) -> DataFrame:
    """Documents of the corpus: those with a frontmatter block."""
    return docs.where("fm_status = 'present'")


def key_line(raw: Column, path: str) -> Column:
    """1-based line of a dotted key in the frontmatter, or null."""

    def find(text: str) -> int | None:
        keys, depth, indents = path.split("."), 0, [-1]
        for number, line in enumerate(text.split("\n")[1:], 2):
            if line.startswith("---"):
                return None
            indent = len(line) - len(line.lstrip(" "))
            name = line.strip().split(":", 1)[0].strip("'\"") if ":" in line else None
            if name is None:
                continue
            while depth and indent <= indents[-1]:
                indents.pop()
                depth -= 1
            if name == keys[depth]:
                if depth == len(keys) - 1:
                    return number
                depth += 1
                indents.append(indent)
        return None

    return _mapped(find, "int", raw)


def section_array(body: Column) -> Column:
    return _mapped(md.sections, f"array<{SECTION}>", body)


def sections(docs: DataFrame, body: str = "body", keep: tuple[str, ...] = ("doc_key",), level: int | None = None) -> DataFrame:
    """One row a section in document order, optionally of one level."""
    rows = docs.select(*keep, F.explode(section_array(F.col(body))).alias("s")).select(*keep, "s.*")
    return rows if level is None else rows.where(F.col("level") == level)


def preamble(body: Column) -> Column:
    return _mapped(md.preamble, "string", body)


def visible_lines(body: Column) -> Column:
    return _mapped(md.visible_lines, "array<struct<line:int,text:string>>", body)


def table_array(content: Column) -> Column:
    return _mapped(md.tables, f"array<{TABLE}>", content)


def table_cells(rows: DataFrame, content: str = "content", keep: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """``table_no, row_no, line, width, headers, cells`` of every table row."""
    t = rows.select(*keep, F.posexplode(table_array(F.col(content))).alias("table_no", "t"))
    return t.select(*keep, "table_no", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "r")).select(
        *keep, "table_no", "headers", "row_no", F.col("r.line").alias("line"), F.col("r.width").alias("width"), F.col("r.cells").alias("cells")
    )


def cell(headers: Column, cells: Column, name: str | int) -> Column:
    """A cell by the header's name or by index from 0; null if there is none."""
    if isinstance(name, int):
        return F.get(cells, F.lit(name))
    at = F.array_position(F.transform(headers, lambda h: F.lower(h)), F.lit(name.lower()))
    return F.when(at > 0, F.get(cells, (at - 1).cast("int")))


def bullet_array(content: Column, pattern: str = "plain") -> Column:
    return _mapped(lambda t: md.bullets(t, pattern), f"array<{ITEM}>", content)


def list_item_array(content: Column) -> Column:
    return _mapped(md.list_items, f"array<{ITEM}>", content)


def code_block_array(content: Column) -> Column:
    return _mapped(md.code_blocks, f"array<{BLOCK}>", content)

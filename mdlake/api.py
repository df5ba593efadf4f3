"""Front door: corpora, single documents, and SQL functions of a session."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from mdlake.operators import _markdown as md
from mdlake.operators import corpus, parse
from mdlake.operators.contract import Schema
from mdlake.operators.corpus import Corpus
from mdlake.plans.registry import Registry, validate_manifest
from mdlake.sources.files import load_repo

__all__ = ["Corpus", "Registry", "corpus_of", "extract_frontmatter", "from_members", "from_path", "parse_document", "register", "validate", "validate_manifest"]


def from_path(spark: SparkSession, root: str, member: str = "", **options) -> Corpus:
    """The corpus of the documents below a folder."""
    return Corpus.of(corpus.documents(load_repo(spark, root, **options)[0], member))


def corpus_of(table: DataFrame, member: str = "") -> Corpus:
    """The corpus of a table with ``path`` and ``raw``."""
    return Corpus.of(corpus.documents(table, member))


def from_members(members: dict[str, DataFrame]) -> Corpus:
    """One corpus of several members, by identity (``org/repo``); two or more need one each."""
    if len(members) > 1 and not all(re.fullmatch(r"[^/]+/[^/]+", m) for m in members):
        raise ValueError("members of a corpus need distinct identities org/repo")
    docs = [corpus.documents(t, m.lower()) for m, t in members.items()]
    out = docs[0]
    for d in docs[1:]:
        out = out.unionByName(d)
    return Corpus.of(out)


def extract_frontmatter(text: str) -> tuple[dict | None, str, str]:
    """``(fields, body, status)`` of one text; as :func:`mdlake.operators.parse.with_header`."""
    text = text.removeprefix("﻿")
    end = text.find("\n---", 3)
    if not re.match(r"---\r?\n", text) or end < 0:
        return None, text, "absent"
    loaded = parse._yaml_json(text[3 : end + 1])
    body = re.sub(r"\A\r?\n", "", text[end + 4 :])
    if loaded is None:
        return None, text, "malformed"
    fields = json.loads(loaded)
    return (fields, body, "present") if fields is not None else (None, body, "absent")


def parse_document(text: str) -> dict:
    """Frontmatter, preamble and flattened sections of one text."""
    fields, body, status = extract_frontmatter(text)
    return {"frontmatter": fields, "fm_status": status, "preamble": md.preamble(body), "sections": md.sections(body), "raw": text}


def validate(value, schema: dict) -> list[tuple[str, str]]:
    """``(pointer, message)`` of all violations of a schema."""
    return Schema(schema).errors(value)


def register(spark: SparkSession) -> None:
    """Add ``md_sections``, ``md_tables``, ``md_code_blocks``, ``md_bullets`` and
    ``md_list_items`` to the session's SQL functions, over a body's text."""
    for name, f, kind in (
        ("md_sections", md.sections, parse.SECTION),
        ("md_tables", md.tables, parse.TABLE),
        ("md_code_blocks", md.code_blocks, parse.BLOCK),
        ("md_bullets", md.bullets, parse.ITEM),
        ("md_list_items", md.list_items, parse.ITEM),
    ):
        spark.udf.register(name, F.arrow_udf(_batch(f, to_arrow_type(DataType.fromDDL(f"array<{kind}>"))), f"array<{kind}>"))


def _batch(f, arrow: pa.DataType):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], arrow)

    return run

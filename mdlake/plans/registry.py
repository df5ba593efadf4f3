"""Modules: YAML manifests read on the driver, merged first-wins into a registry.

Vocabulary is module data. The registry's tables mirror it for joins.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mdlake.operators.contract import Schema
from mdlake.operators.extract import check as check_rule
from mdlake.operators.parse import load_yaml

#: The keys of a manifest.
KEYS = {
    "manifest_version", "name", "version", "description", "grammars", "artifact_types", "object_types", "archetypes", "lint_rules", "edge_types", "roles", "lexicon", "grammar_severity",
    "observable_verbs", "vacuous_predicates", "property_idioms", "ambiguity_terms", "verification_catalog", "plain_language_profiles", "clause_sets", "semantic", "traceability",
}
TYPE_KEYS = {"name", "grammar_ref", "frontmatter_schema_ref", "allowed_links", "data_schema", "body_extraction", "examples", "lint_rules_ref", "roles", "id_pattern", "record_validation", "description", "semantic"}
MERGED = ("edge_types", "roles", "lexicon", "grammar_severity", "verification_catalog", "plain_language_profiles")


@dataclass
class Archetype:
    name: str
    module: str
    object: bool
    schema: Schema | None
    allowed_links: dict[str, list[str]] | None
    extraction: dict | None
    roles: tuple[str, ...]
    id_pattern: str | None
    raw: dict


@dataclass
class Registry:
    archetypes: dict[str, Archetype] = field(default_factory=dict)
    vocab: dict[str, dict] = field(default_factory=lambda: {k: {} for k in MERGED})
    traceability: list[dict] = field(default_factory=list)
    clause_sets: dict[str, dict] = field(default_factory=dict)
    lint_rules: list[dict] = field(default_factory=list)
    origins: dict[str, str] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, folders: list[str], strict: bool = False) -> Registry:
        """Merge the modules of folders in order; the first of a name wins. Strict:
        any diagnostic is an error."""
        r = cls()
        for folder in folders:
            r.add(folder)
        if strict and r.diagnostics:
            raise ValueError("; ".join(r.diagnostics))
        return r

    @classmethod
    def from_env(cls, variable: str = "MDLAKE_MODULE_PATH", strict: bool = False) -> Registry:
        """Modules below each folder of a search path; ``~`` expands, repeats count once."""
        folders, notes, seen = [], [], set()
        for part in filter(None, os.environ.get(variable, "").split(os.pathsep)):
            top = os.path.realpath(os.path.expanduser(part))
            if top in seen:
                continue
            seen.add(top)
            if not os.path.isdir(top):
                notes.append(f"search-path-{'not-a-directory' if os.path.exists(top) else 'missing'} {part}")
                continue
            folders += [e.path for e in sorted(os.scandir(top), key=lambda e: e.name) if os.path.isfile(os.path.join(e.path, "manifest.yaml"))]
        r = cls.load(folders)
        r.diagnostics = notes + r.diagnostics
        if strict and r.diagnostics:
            raise ValueError("; ".join(r.diagnostics))
        return r

    def add(self, folder: str) -> None:
        try:
            with open(os.path.join(folder, "manifest.yaml"), encoding="utf-8-sig") as f:
                self.add_manifest(load_yaml(f.read()), folder)
        except (OSError, ValueError) as error:
            self.diagnostics.append(f"module {folder}: {error}")

    def add_manifest(self, m: dict, folder: str | None = None) -> None:
        """One manifest; ``folder`` is where its schemas are, None where it has none."""
        problems = validate_manifest(m)
        if problems:
            raise ValueError("; ".join(problems))
        name = m["name"]
        if name in self.origins:
            self.diagnostics.append(f"duplicate-module-name {name}")
            return
        self.origins[name] = folder or ""
        for is_object, key in ((False, "artifact_types"), (False, "archetypes"), (True, "object_types")):
            for x in m.get(key) or []:
                if x["name"] in self.archetypes:
                    self.diagnostics.append(f"duplicate-archetype {x['name']}")
                    continue
                ref = x.get("frontmatter_schema_ref")
                links = x.get("allowed_links")
                rule = (x.get("body_extraction") or {}).get("yield_pattern")
                self.archetypes[x["name"]] = Archetype(
                    x["name"], name, is_object, Schema(_read_schema(folder, ref)) if ref else None,
                    {v: ["*"] for v in links} if isinstance(links, list) else links, rule, tuple(x.get("roles") or ()), x.get("id_pattern"), x,
                )
        for key in MERGED:
            for k, v in (m.get(key) or {}).items():
                if k in self.vocab[key]:
                    self.diagnostics.append(f"duplicate-{key.replace('_', '-')} {k}")
                else:
                    self.vocab[key][k] = v
        for c in m.get("clause_sets") or []:
            if c["id"] in self.clause_sets:
                self.diagnostics.append(f"duplicate-clause-set {c['id']}")
            else:
                self.clause_sets[c["id"]] = c
        self.lint_rules += m.get("lint_rules") or []
        if m.get("traceability"):
            self.traceability.append(m["traceability"])

    def names(self) -> list[str]:
        return sorted(self.archetypes)

    def inverse_verbs(self) -> dict[str, str]:
        return {k: v["inverse"] for k, v in self.vocab["edge_types"].items() if isinstance(v, dict) and v.get("inverse")}

    def allowed_links(self, type_: str, object_: str | None = None) -> dict[str, list[str]] | None:
        """Verbs of the type and the object type together; None where neither declares any."""
        found = [a.allowed_links for n in (type_, object_) if n and (a := self.archetypes.get(n)) and a.allowed_links is not None]
        return {v: sorted({t for f in found for t in f.get(v) or []}) for v in sorted({v for f in found for v in f})} if found else None

    def allowed_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, verb, list(tokens or [])) for n, a in self.archetypes.items() for verb, tokens in (a.allowed_links or {}).items()]
        return spark.createDataFrame(rows, "type string, edge_type string, tokens array<string>")

    def role_map(self) -> dict[str, list[str]]:
        return {n: list(a.roles) for n, a in self.archetypes.items() if a.roles}

    def input_contract(self, name: str) -> dict:
        """What a document of a type must have: fields, sections and columns."""
        a = self.archetypes[name]
        root = a.schema.root if a.schema else {}
        rule = a.extraction or {}
        sections = {x["after_heading"]: bool(x.get("required")) for x in {**rule.get("match", {}), **rule.get("per_match", {})}.values() if x.get("after_heading")}
        return {"type": name, "required": root.get("required", []), "fields": sorted(root.get("properties", {})), "sections": sections, "links": a.allowed_links}

    def input_skeleton(self, name: str) -> str:
        c = self.input_contract(name)
        consts = (self.archetypes[name].schema.root.get("properties", {}) if self.archetypes[name].schema else {}) or {}
        head = [f"{f}: {json.dumps(consts.get(f, {}).get('const', name if f == 'type' else 'TODO'))}" for f in c["required"] or ["type"]]
        body = [f"## {s}\n\nTODO\n" for s in c["sections"]]
        return "---\n" + "\n".join(head) + "\n---\n# TODO\n\n" + "\n".join(body)


def validate_manifest(m) -> list[str]:
    """Problems of a manifest: unknown keys are refused, not ignored."""
    if not isinstance(m, dict):
        return ["the manifest is no mapping"]
    out = [f"unknown key {k}" for k in sorted(set(m) - KEYS)]
    if not m.get("name"):
        out.append("manifest-missing-name")
    for key in ("artifact_types", "archetypes", "object_types"):
        if key in m and m[key] is None:
            out.append(f"{key} is null")
        for x in m.get(key) or []:
            out += [f"{key} {x.get('name')}: unknown key {k}" for k in sorted(set(x) - TYPE_KEYS)]
            rule = (x.get("body_extraction") or {}).get("yield_pattern")
            out += [f"{x.get('name')}: {p}" for p in check_rule(rule)] if rule else []
    return out


def _read_schema(folder: str | None, ref: str) -> dict:
    path = os.path.realpath(os.path.join(folder or "", ref))
    if folder is None or not path.startswith(os.path.realpath(folder) + os.sep):
        raise ValueError(f"path-traversal {ref}")
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)

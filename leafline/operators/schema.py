"""Schemas: parsing, inheritance along directories, match filters, compatibility and health. Driver-side; the result is small."""

from __future__ import annotations

import posixpath
import re
from dataclasses import asdict, dataclass, field, replace

from ..functions.expressions import ExpressionError, free_names, parse
from ..functions.scalars import glob_regex

try:
    import yaml
except ImportError:
    yaml = None

TYPES = ("string", "list", "enum", "sequence", "link", "boolean", "integer")
RULES = ("non_empty", "exists", "requires", "enum")
SEVERITY = {"off": 0, "warn": 1, "error": 2}
SECTIONS = ("version", "root", "scope", "schema", "validate", "derive", "aggregate", "links", "structural")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    type: str = ""
    required: bool = False
    required_match: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    default: str | None = None
    severity: str = "error"
    source: str = ""
    prefix: str = ""
    digits: int = 0
    excludes: str = ""
    match: tuple[str, ...] = ()
    match_config: tuple[tuple[str, tuple[str, int]], ...] = ()
    defined_in: str = ""


@dataclass(frozen=True)
class Rule:
    field: str
    rule: str
    if_: tuple[tuple[str, str], ...] = ()
    then: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    severity: str = "error"
    source: str = ""


@dataclass(frozen=True)
class LinkRule:
    target: str = ""
    field: str = ""
    value_field: str = ""


@dataclass(frozen=True)
class Links:
    allowed: tuple[str, ...] = ()
    styles: tuple[str, ...] = ()
    basename_fallback: bool = False
    checks: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)
    unknown_checks: tuple[str, ...] = ()
    unknown_rule_keys: tuple[str, ...] = ()

    @property
    def effective_styles(self) -> tuple[str, ...]:
        return self.styles or ("wikilink",)

    @property
    def resolves(self) -> bool:
        return self.checks.get("resolve") is not False


@dataclass(frozen=True)
class Schema:
    path: str = ""
    version: int = 2
    root: bool = False
    scope: str = ""
    fields: dict = field(default_factory=dict)
    validate: tuple[Rule, ...] = ()
    derive: dict = field(default_factory=dict)
    aggregate: dict = field(default_factory=dict)
    links: Links = field(default_factory=Links)
    structural: dict = field(default_factory=dict)

    @property
    def index_base(self) -> str:
        return self.structural.get("require_index") or "README.md"


def strings(v) -> tuple[str, ...]:
    return () if v is None else tuple(str(x) for x in v) if isinstance(v, (list, tuple)) else (str(v),)


def parse_field(name: str, raw, path: str) -> Field:
    if raw is None:
        raise SchemaError(f"field {name!r} is null")
    if isinstance(raw, str):
        raw = {"type": raw}
    required, match = raw.get("required", False), raw.get("match")
    config = tuple((str(p), (str((c or {}).get("prefix", "")), int((c or {}).get("digits", 0)))) for p, c in match.items()) if isinstance(match, dict) else ()
    excludes = raw.get("excludes") or {}
    return Field(
        type=str(raw.get("type") or ""), required=required is True or isinstance(required, dict), required_match=strings(required.get("match")) if isinstance(required, dict) else (),
        values=strings(raw.get("values")), default=None if raw.get("default") is None else str(raw["default"]), severity=raw.get("severity") or "error", source=str(raw.get("source") or ""),
        prefix=str(raw.get("prefix") or ""), digits=int(raw.get("digits") or 0), excludes=str(excludes.get("match", "") if isinstance(excludes, dict) else excludes),
        match=tuple(p for p, _ in config) if config else strings(match), match_config=config, defined_in=path,
    )


def parse_links(raw) -> Links:
    raw = raw or {}
    known = ("allowed", "styles", "checks", "basename_fallback")
    checks = raw.get("checks") or {}
    rules = {k: LinkRule(*(str((v or {}).get(n, "") or "") for n in ("target", "field", "value_field"))) for k, v in raw.items() if k not in known and isinstance(v, (dict, type(None)))}
    return Links(
        strings(raw.get("allowed")), strings(raw.get("styles")), bool(raw.get("basename_fallback")), {k: v for k, v in checks.items() if k in ("resolve", "anchors", "encoding", "cycles")}, rules,
        tuple(k for k in checks if k not in ("resolve", "anchors", "encoding", "cycles")), tuple(f"{t}.{k}" for t, v in raw.items() if t not in known and isinstance(v, dict) for k in v if k not in ("target", "field", "value_field")),
    )


def parse_schema(text: str | dict, path: str = "") -> Schema:
    raw = (yaml.safe_load(text) if isinstance(text, str) else text) or {}
    if not isinstance(raw, dict):
        raise SchemaError(f"{path}: a schema is a mapping")
    version = raw.get("version", 0)
    if version in (0, 1, None):
        raise SchemaError(f"{path}: version {version} is not supported; use 2")
    rules = []
    for r in raw.get("validate") or ():
        if r.get("rule") not in RULES:
            raise SchemaError(f"{path}: unknown rule {r.get('rule')!r}")
        then = r.get("then") or {}
        rules.append(Rule(str(r.get("field", "")), r["rule"], tuple((str(k), str(v).lower() if isinstance(v, bool) else str(v)) for k, v in (r.get("if") or {}).items()), strings(then.get("fields") if isinstance(then, dict) else then), strings(r.get("values")), r.get("severity") or "error", path))
    return Schema(
        path, int(version), bool(raw.get("root")), str((raw.get("scope") or {}).get("match") or ""), {str(k): parse_field(k, v, path) for k, v in (raw.get("schema") or {}).items()}, tuple(rules),
        dict(raw.get("derive") or {}), dict(raw.get("aggregate") or {}), parse_links(raw.get("links")), dict((raw.get("structural") or {}).get("subdirs") or {}),
    )


def stricter(a: str, b: str) -> str:
    return a if SEVERITY.get(a, 2) >= SEVERITY.get(b, 2) else b


def merge_two(parent: Schema, child: Schema) -> Schema:
    fields = dict(parent.fields)
    for n, f in child.fields.items():
        if n in fields:
            f = replace(f, source=f.source or fields[n].source, severity=stricter(f.severity, fields[n].severity))
        fields[n] = f
    deep = lambda a, b: {**a, **{k: v for k, v in b.items() if v is not None}}
    p, c = parent.links, child.links
    checks = {**p.checks, **{k: v for k, v in c.checks.items() if v is not None}} if "resolve" not in c.checks and c.checks else c.checks or p.checks
    if c.checks and "resolve" not in c.checks:
        checks = {**c.checks, **({"resolve": p.checks["resolve"]} if "resolve" in p.checks else {})}
    links = Links(c.allowed or p.allowed, c.styles or p.styles, p.basename_fallback or c.basename_fallback, checks, {**p.rules, **c.rules}, p.unknown_checks + c.unknown_checks, p.unknown_rule_keys + c.unknown_rule_keys)
    return Schema(child.path, child.version, child.root, child.scope or parent.scope, fields, parent.validate + child.validate, deep(parent.derive, child.derive), deep(parent.aggregate, child.aggregate), links, child.structural or parent.structural)


def merge(chain: list[Schema]) -> Schema:
    """Root to leaf: later fields replace whole fields but for source and stricter severity; rules accumulate."""
    out = chain[0] if chain else Schema()
    for s in chain[1:]:
        out = merge_two(out, s)
    return out


def up(directory: str) -> list[str]:
    parts = directory.split("/") if directory else []
    return ["/".join(parts[:n]) for n in range(len(parts), -1, -1)]


def chain_for(schemas: dict[str, Schema], directory: str) -> list[Schema]:
    """Schemas that govern a directory, root first: up to the first that declares itself the root; gaps don't end it."""
    out = []
    for d in up(directory):
        if d in schemas:
            out.append(schemas[d])
            if schemas[d].root:
                break
    return out[::-1]


def matches_any(path: str, patterns) -> bool:
    regexes = [r for p in patterns if (r := glob_regex(p))]
    return any(re.match(r, c) for c in path.split("/") for r in regexes)


def for_record(merged: Schema, path: str) -> Schema:
    """The merged schema as it holds for one path: fields by match, required by its own, sequence settings of the deepest match."""
    fields = {}
    for n, f in merged.fields.items():
        if f.match and not matches_any(path, f.match):
            continue
        if f.required_match:
            f = replace(f, required=matches_any(path, f.required_match))
        if f.match_config:
            hits = [(i, p, c) for i, comp in enumerate(path.split("/")) for p, c in sorted(f.match_config) if (r := glob_regex(p)) and re.match(r, comp)]
            if hits:
                deepest = max(h[0] for h in hits)
                prefix, digits = next(c for i, _, c in hits if i == deepest)
                f = replace(f, prefix=prefix or f.prefix, digits=digits or f.digits)
        fields[n] = f
    return replace(merged, fields=fields)


def in_scope(name: str, schema: Schema) -> bool:
    regex = glob_regex(schema.scope) if schema.scope else None
    return regex is None or bool(re.match(regex, name))


def declaration_issue(f: Field) -> str | None:
    if not f.type:
        return "incomplete-type"
    if f.type in ("bool", "section", "heading", "ordered"):
        return "legacy-type"
    if f.type not in TYPES:
        return "unknown-type"
    if f.type == "enum" and not f.values:
        return "incomplete-enum"
    if f.type == "sequence" and not (f.prefix and f.digits > 0) and not f.match_config:
        return "incomplete-sequence"
    return None


def compatibility(parent: Field, child: Field) -> list[str]:
    """What a child field loosens against its parent."""
    out = []
    if parent.source and child.source and parent.source != child.source:
        out.append("source")
    if parent.type and child.type and parent.type != child.type and (parent.type, child.type) != ("string", "enum"):
        out.append("type")
    if parent.values and child.values and set(child.values) - set(parent.values):
        out.append("values")
    if parent.required and not child.required:
        out.append("required")
    if SEVERITY.get(child.severity, 2) < SEVERITY.get(parent.severity, 2):
        out.append("severity")
    return out


def health(texts: dict[str, str], names: list[str] = ()) -> list[dict]:
    """Checks of all schema files: rows of check, status (pass, warn, fail, info), schema, field and message, in a fixed order."""
    out: list[dict] = []
    add = lambda check, status, path="", name="", message="": out.append({"check": check, "status": status, "schema": path, "field": name, "message": message})
    if not texts:
        add("stem-files-exist", "fail", message="no schema file")
    schemas: dict[str, Schema] = {}
    for d, text in sorted(texts.items()):
        path = posixpath.join(d, ".stem")
        try:
            yaml.safe_load(text)
        except Exception as e:  # noqa: BLE001
            add("yaml-valid", "fail", path, message=str(e).split("\n")[0])
            continue
        try:
            schemas[d] = parse_schema(text, path)
        except (SchemaError, AttributeError, TypeError, ValueError) as e:
            add("schema-valid", "fail", path, message=str(e))
    for d, s in sorted(schemas.items()):
        if s.scope and names and not any(in_scope(posixpath.basename(n), s) for n in names if n == d or n.startswith(d + "/" if d else "")):
            add("scope-match", "warn", s.path, message=f"scope {s.scope!r} matches no file")
        above = chain_for(schemas, d)[:-1]
        for n, f in s.fields.items():
            if issue := declaration_issue(f):
                add("field-declaration", "fail", s.path, n, issue)
            for p in above:
                if n in p.fields:
                    add("field-override", "info", s.path, n, f"overrides {p.path}")
                    for what in compatibility(p.fields[n], f):
                        add("type-consistency" if what == "type" else "monotonic-violations", "fail", s.path, n, f"{what} is looser than in {p.path}")
        merged = merge([*above, s])
        for r in s.validate:
            if r.field and r.field not in merged.fields and r.field not in merged.derive and r.field not in merged.aggregate:
                add("rule-field-exists", "warn", s.path, r.field, f"rule {r.rule} names an undeclared field")
        for n, e in s.aggregate.items():
            if n in merged.fields and merged.fields[n].required:
                add("aggregated-required", "warn", s.path, n, "required and aggregated")
            missing = [v for v in merged.fields[n].values if f"'{v}'" not in str(e) and f'"{v}"' not in str(e)] if n in merged.fields else []
            if missing:
                add("aggregate-formula-coverage", "warn", s.path, n, f"values without a case: {', '.join(missing)}")
            try:
                free_names(parse(str(e)))
            except ExpressionError as x:
                add("schema-valid", "fail", s.path, n, str(x))
        for k in s.links.unknown_checks:
            add("unknown-check-keys", "warn", s.path, k)
        for k in s.links.unknown_rule_keys:
            add("unknown-link-rule-keys", "warn", s.path, k)
        if s.root and any(x in schemas for x in up(d)[1:]):
            add("nested-root-marker", "info", s.path)
    return sorted(out, key=lambda r: (r["check"], r["schema"], r["field"], r["status"], r["message"]))


def diff(before: Schema | None, after: Schema | None) -> list[dict]:
    """Changes from one schema to another: kind, field, breaking, before, after; breaking ones first."""
    b, a = before or Schema(), after or Schema()
    out: list[dict] = []
    add = lambda kind, name, breaking, x="", y="": out.append({"kind": kind, "field": name, "breaking": breaking, "before": str(x), "after": str(y)})
    for n in sorted({*b.fields, *a.fields}):
        if n not in a.fields:
            add("field_removed", n, True, b.fields[n].type)
        elif n not in b.fields:
            add("field_added", n, False, "", a.fields[n].type)
            if a.fields[n].required:
                add("required_added", n, True, False, True)
        else:
            x, y = b.fields[n], a.fields[n]
            if x.type != y.type:
                add("type_changed", n, True, x.type, y.type)
            for v in sorted(set(x.values) - set(y.values)):
                add("enum_value_removed", n, True, v)
            for v in sorted(set(y.values) - set(x.values)):
                add("enum_value_added", n, False, "", v)
            if x.required != y.required:
                add("required_added" if y.required else "required_removed", n, y.required, x.required, y.required)
            for attr, breaking in (("source", True), ("prefix", True), ("digits", True), ("match", True), ("required_match", True), ("excludes", True), ("default", False), ("severity", False)):
                if getattr(x, attr) != getattr(y, attr):
                    add(f"{attr}_changed", n, breaking, getattr(x, attr), getattr(y, attr))
    rules = lambda s: {(r.field, r.rule, r.if_, r.then, r.values) for r in s.validate}
    for r in sorted(rules(b) - rules(a)):
        add("rule_removed", r[0], True, r[1])
    for r in sorted(rules(a) - rules(b)):
        add("rule_added", r[0], False, "", r[1])
    for kind in ("derive", "aggregate"):
        x, y = getattr(b, kind), getattr(a, kind)
        for n in sorted({*x, *y}):
            if x.get(n) != y.get(n):
                add(f"{kind}_changed", n, False, x.get(n, ""), y.get(n, ""))
    return sorted(out, key=lambda c: (not c["breaking"], c["kind"], c["field"], c["before"], c["after"]))


def rows(schema: Schema) -> list[dict]:
    """The fields of a schema as rows."""
    return [{"field": n, **asdict(f)} for n, f in sorted(schema.fields.items())]

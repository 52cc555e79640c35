"""Records from Markdown text: metadata, sections, links, code blocks and tables. Plain Python; runs inside Arrow batches."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # metadata then falls back to "key: value" lines
    yaml = None

FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
WIKI = re.compile(r"\[\[([^\[\]]+)\]\]")
INLINE = re.compile(r"(?<!!)\[[^\[\]]*\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*|<[^<>]*>)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
BLOCK_START = re.compile(r"^ {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$)|^ {0,3}>|^ {0,3}<[A-Za-z!/?]|^(?: {4}|\t)")

if yaml is not None:

    class Loader(yaml.SafeLoader):
        """Only true and false are booleans and numbers are decimal: yes, no, on and off stay text."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$"), list("-+.0123456789"))

    def _int(loader, node):
        v = loader.construct_scalar(node).replace("_", "")
        return int(v, 8 if "0o" in v else 16 if "0x" in v else 10) if not re.match(r"[-+]?0o", v) else int(v.replace("0o", ""), 8)

    Loader.add_constructor("tag:yaml.org,2002:int", _int)


def frontmatter_bounds(text: str) -> tuple[int, int, int] | None:
    """(start of the metadata, its end, start of the body); None without metadata, end -1 if it is never closed."""
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return None
    at, fence = len(lines[0]) + 1, None
    start = at
    for line in lines[1:]:
        bare = line.rstrip("\r")
        if fence is None and bare == "---":
            return start, at, min(at + len(line) + 1, len(text))
        m = FENCE.match(bare)
        if m and not m[1]:
            if fence is None:
                fence = m[2]
            elif m[2][0] == fence[0] and len(m[2]) >= len(fence) and not m[3].strip():
                fence = None
        at += len(line) + 1
    return start, -1, -1


def fallback_metadata(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip() and not key.startswith((" ", "\t", "#", "-")) and (value := value.strip().strip("\"'")):
            out[key.strip()] = value
    return out


def decode_metadata(text: str) -> tuple[dict, list[dict]]:
    """The mapping and the errors; malformed metadata is read line by line."""
    if yaml is None:
        return fallback_metadata(text), []
    try:
        got = yaml.load(text, Loader)
    except Exception as e:  # noqa: BLE001
        line = getattr(getattr(e, "problem_mark", None), "line", 0)
        return fallback_metadata(text), [{"line": line + 2, "message": f"malformed YAML: {getattr(e, 'problem', None) or e}"}]
    if got is None:
        return {}, []
    if not isinstance(got, dict):
        return fallback_metadata(text), [{"line": 2, "message": "malformed YAML: metadata is no mapping"}]
    return {str(k): v for k, v in got.items()}, []


def fenced(lines: list[str]) -> list[bool]:
    """Of each line whether a fenced code block holds it, fences included."""
    out, fence = [], None
    for line in lines:
        m = FENCE.match(line)
        if fence is None:
            fence = m[2] if m and not ("`" in m[3] and m[2][0] == "`") else None
            out.append(fence is not None)
        else:
            out.append(True)
            if m and m[2][0] == fence[0] and len(m[2]) >= len(fence) and not m[3].strip():
                fence = None
    return out


def sections(body: str) -> list[dict]:
    """Sections by top-level headings (ATX and Setext), each up to the next heading of any level; one of level 0 without headings."""
    lines = body.split("\n")
    code = fenced(lines)
    heads: list[tuple[int, int, int, str]] = []  # first line, line after, level, text
    paragraph: list[int] = []
    container = False  # in a list, quote, HTML block or indented code
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r")
        if code[i] or not line.strip():
            paragraph = []
            container = container and not code[i] and i + 1 < len(lines) and lines[i + 1][:1] in (" ", "\t")
            continue
        m = ATX.match(line)
        if m:
            heads.append((i, i + 1, len(m[1]), (m[2] or "").strip()))
            paragraph, container = [], False
            continue
        u = SETEXT.match(line)
        if u and paragraph and not container:
            text = " ".join(lines[k].strip() for k in paragraph)
            heads.append((paragraph[0], i + 1, 1 if u[1][0] == "=" else 2, text))
            paragraph = []
            continue
        if BLOCK_START.match(line) and not (paragraph and line[:4].isspace()):
            container, paragraph = True, []
        elif not container:
            paragraph.append(i)
    if not heads:
        return [{"heading": "", "level": 0, "path": [], "content": body.strip(), "start_line": 1}]
    out, stack = [], []
    for k, (first, after, level, text) in enumerate(heads):
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        stack.append({"level": level, "text": text})
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        out.append({"heading": text, "level": level, "path": [dict(p) for p in stack], "content": "\n".join(lines[after:end]).strip(), "start_line": first + 1})
    return out


def sections_map(found: list[dict]) -> dict[str, str]:
    return {"#" * s["level"] + " " + s["heading"]: s["content"] for s in found if s["level"]}


def wiki_link(inner: str) -> tuple[str, str, str]:
    """(target, type, anchor) of [[type:target#anchor]]."""
    kind, colon, rest = inner.partition(":")
    kind, rest = (kind.strip(), rest) if colon and re.fullmatch(r"\s*[A-Za-z_][\w-]*\s*", kind) else ("", inner)
    rest = rest.partition("|")[0]
    target, _, anchor = rest.strip().partition("#")
    return target.strip(), kind, anchor.strip()


def body_links(body: str) -> list[dict]:
    out = []
    lines = body.split("\n")
    for n, (line, code) in enumerate(zip(lines, fenced(lines)), 1):
        if code:
            continue
        line = re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", lambda m: " " * len(m[0]), line)
        for m in WIKI.finditer(line):
            target, kind, anchor = wiki_link(m[1])
            if target or anchor:
                out.append({"target": target, "type": kind, "line": n, "source": "body", "style": "wikilink", "anchor": anchor})
        for m in INLINE.finditer(line):
            dest = m[1].strip().removeprefix("<").removesuffix(">")
            if not dest or dest.startswith("#") or "://" in dest or dest.startswith("mailto:"):
                continue
            target, _, anchor = dest.partition("#")
            out.append({"target": target, "type": "", "line": n, "source": "body", "style": "markdown", "anchor": anchor})
    return out


def metadata_links(fm: dict) -> list[dict]:
    out = []
    for key in sorted(fm):
        for v in fm[key] if isinstance(fm[key], list) else [fm[key]]:
            for m in WIKI.finditer(v) if isinstance(v, str) else ():
                target, kind, anchor = wiki_link(m[1])
                out.append({"target": target, "type": kind, "line": 0, "source": f"frontmatter:{key}", "style": "wikilink", "anchor": anchor})
    return out


def code_blocks(body: str) -> list[dict]:
    """language, content and first content line of fenced blocks."""
    out, lines, i = [], body.split("\n"), 0
    code = fenced(lines)
    while i < len(lines):
        m = FENCE.match(lines[i]) if code[i] else None
        if m:
            end = i + 1
            while end < len(lines) and code[end] and not (FENCE.match(lines[end]) and FENCE.match(lines[end])[2][0] == m[2][0] and len(FENCE.match(lines[end])[2]) >= len(m[2]) and not FENCE.match(lines[end])[3].strip()):
                end += 1
            out.append({"language": (m[3].split() or [""])[0], "content": "\n".join(lines[i + 1 : end]), "start_line": i + 2})
            i = end
        i += 1
    return out


def tables(body: str) -> list[dict]:
    """headers and rows of pipe tables."""
    out, lines = [], body.split("\n")
    code = fenced(lines)
    cells = lambda s: [c.strip() for c in re.split(r"(?<!\\)\|", s.strip().removeprefix("|").removesuffix("|"))]
    i = 0
    while i + 1 < len(lines):
        if not code[i] and "|" in lines[i] and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]) and len(cells(lines[i])) == len(cells(lines[i + 1])):
            rows, k = [], i + 2
            while k < len(lines) and "|" in lines[k]:
                row = cells(lines[k])
                rows.append((row + [""] * len(cells(lines[i])))[: len(cells(lines[i]))])
                k += 1
            out.append({"headers": cells(lines[i]), "rows": rows})
            i = k
        i += 1
    return out


def extract(content: str) -> dict:
    """fm, body, sections, body_sections, links, errors and the number of YAML documents of one file's text."""
    content = content.removeprefix("﻿")
    bounds = frontmatter_bounds(content)
    if bounds and bounds[1] < 0:  # never closed: all is body, and links and sections aren't read
        return {"fm": {}, "body": content, "sections": {}, "body_sections": [], "links": [], "errors": []}
    fm, errors, body = {}, [], content
    if bounds:
        fm, errors = decode_metadata(content[bounds[0] : bounds[1]])
        body = content[bounds[2] :].lstrip("\r\n")
    found = sections(body)
    return {"fm": fm, "body": body, "sections": sections_map(found), "body_sections": found, "links": [*metadata_links(fm), *body_links(body)], "errors": errors}


def frames(contents, chars: int):
    """Lists of what extract() gives for contents, a list for each so many characters: sections and links hold the text several times."""
    held, size = [], 0
    for c in contents:
        held.append(extract(c))
        size += len(c)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held

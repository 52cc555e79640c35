"""Secret scans by assignment-aware lexing.

A text is lexed for what source code and configuration files assign: name and literal, name and other name, concatenated literals,
strings in triple quotes, block scalars, elements and entries that give a name and a value.
Names carry their literals forward (constants are propagated in text order), and a literal scores by how sensitive the name is that
it ends up in and by how much it looks like a credential. What reaches the threshold becomes a span of kind "lexed", beside the
three base kinds, which always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, with_text

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 24 or more: leftmost runs of [0-9a-f]+ that are shorter fail and hold no longer one.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z_$][A-Za-z0-9_$]*+)*+"
TRIPLE = r'"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|\'{3}(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'{3}'
STRING = TRIPLE + r"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
#: name = value, name: value, "name": "value", name => value, with a string, concatenated strings, another name or a bare word.
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_$.-])["']?({NAME})["']?[ \t]*+(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+(?:({STRING})((?:[ \t]*\+[ \t]*(?:{STRING}))*+)|([^\s"'`,;(){{}}\[\]<>]++))"""
)
ONE_STRING = re.compile(STRING)
JOINED = re.compile(rf"(?:[ \t]*\+[ \t]*(?:{STRING}|{NAME}))+")
#: <name>literal</name>, and entries that give name and value side by side: <add key="name" value="literal"/>, {"name": .., "value": ..}.
ELEMENT = re.compile(rf"<({NAME})(?:\s[^<>]*+)?>\s*+([^<>\s]++)\s*+</\1\s*+>")
ENTRY = re.compile(rf"""(?<![A-Za-z0-9_$.-])["']?(?:key|name)["']?[ \t]*+[=:][ \t]*+["']?({NAME})["']?\s*+,?\s*+["']?value["']?[ \t]*+[=:][ \t]*+(?:({STRING})|([^\s"'`,;(){{}}\[\]<>]++))""")
#: The head of a block scalar; the lines below that are indented deeper are its value.
BLOCK = re.compile(rf"""^([ ]*+(?:-[ ]++)?)["']?({NAME})["']?:[ \t]*+[|>][-+0-9]{{0,2}}[ \t]*+$""", re.MULTILINE)
OPERAND = re.compile(rf"(?:{STRING})|({NAME})")
#: Parts of one literal that are told apart: constants that are joined to themselves again and again would double each time.
MOST_PARTS = 64
#: Words of names and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "authtoken": 1.0, "bearer": 0.8,
}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("client", "key"), ("account", "key"), ("connection", "string"), ("pass", "phrase")}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|example|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|\$[A-Z_]+|process\.env.*|os\.environ.*)$")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LEAST_SCORE = 0.6


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    single = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max(single, 1.0 if any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])) else 0.0)


def plausibility(literal: str) -> float:
    """0 to 1: length, mixed characters and entropy; spaces, placeholders and short literals count 0."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, 0.3 + 0.15 * kinds + 0.1 * min(entropy, 4.0))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def alone_on_line(text: str, m: re.Match) -> bool:
    """A bare value of a line that is only indent, name, colon and value, and that isn't a plain word."""
    begin = text.rfind("\n", max(0, m.start() - 200), m.start()) + 1
    end = text.find("\n", m.end(), m.end() + 200)
    if begin == 0 and m.start() > 200 or end < 0 and len(text) - m.end() > 200:
        return False
    rest = text[m.end() : len(text) if end < 0 else end].strip()
    return not text[begin : m.start()].strip(" \t-") and (not rest or rest.startswith("#")) and not m[4].isalpha()


def literal(text: str, a: int, b: int) -> tuple[int, int, str]:
    """(start, end, value) of what a string at a to b holds; one of several lines is read without the white space around its lines."""
    q = 3 if b - a >= 6 and text[a : a + 3] in ('"' * 3, "'" * 3) else 1
    value = text[a + q : b - q]
    return a + q, b - q, value if q == 1 else of_lines(value.split("\n"))


def of_lines(lines: list[str]) -> str:
    """Lines as one value; those of several words, such as the frame of a key, say nothing of it unless there is no other."""
    lines = [x.strip() for x in lines]
    words = [x for x in lines if x and not any(map(str.isspace, x))]
    return "".join(words) or " ".join(lines).strip()


def blocks(text: str):
    """(start, name, literal) of block scalars; a block isn't read again for blocks inside it."""
    at = 0
    while m := BLOCK.search(text, at):
        deep, lines, begin, at = len(m[1]), [], None, m.end()
        while at < len(text):
            stop = text.find("\n", at + 1)
            stop = len(text) if stop < 0 else stop
            line = text[at + 1 : stop]
            if line.strip():
                indent = len(line) - len(line.lstrip(" "))
                if indent <= deep:
                    break
                begin = at + 1 + indent if begin is None else begin
                end = at + 1 + len(line.rstrip())
                lines.append(line)
            at = stop
        if begin is not None:
            yield m.start(), m[2], (begin, end, of_lines(lines))


def assignments(text: str):
    """(start, name, literals, name of a constant or None, end) of all that is assigned, by start."""
    out = []
    for m in PAIR.finditer(text):
        if m[2] is not None:
            at = m.start(2)
            out.append((m.start(), m[1], [literal(text, at + p.start(), at + p.end()) for p in ONE_STRING.finditer(text[at : m.end(3)])], None, m.end()))
        else:
            bare = not m[4].startswith(("$", "&", "*", "@")) and ("=" in text[m.end(1) : m.start(4)] or alone_on_line(text, m))
            out.append((m.start(), m[1], [(m.start(4), m.end(4), m[4])] if bare else [], m[4], m.end()))
    if "</" in text:
        out += [(m.start(), m[1], [(m.start(2), m.end(2), m[2])], None, len(text)) for m in ELEMENT.finditer(text)]
    if "value" in text:
        for m in ENTRY.finditer(text):
            parts = [literal(text, *m.span(2))] if m[2] is not None else [(m.start(3), m.end(3), m[3])]
            out.append((m.start(), m[1], parts, m[3], m.end()))
    if "|" in text or ">" in text:
        out += [(at, name, [part], None, len(text)) for at, name, part in blocks(text)]
    return sorted(out, key=lambda x: x[0])


def lexed_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of literals by the most sensitive name they reach, in text order."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    held: dict[str, list[tuple[int, int, str]]] = {}
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for _, name, parts, constant, end in assignments(text):
        parts = held.get(constant, parts)
        if parts and (more := JOINED.match(text, end)):  # a constant and more: what is joined to it belongs to the literal
            for p in OPERAND.finditer(more[0]):
                parts = [*parts, *(held.get(p[1], []) if p[1] else [literal(text, end + p.start(), end + p.end())])]
                if len(parts) > MOST_PARTS:
                    break
        if not parts:
            continue
        held[name] = parts
        if weight := sensitivity(name):
            score = weight * plausibility("".join(p[2] for p in parts))
            for a, b, _ in parts:
                if b > a and score > best.get((a, b), ("", 0.0))[1]:
                    best[a, b] = (name, score)
    return [(a, b, name, score) for (a, b), (name, score) in sorted(best.items())]


def scan(text: str | None, least_score: float = LEAST_SCORE) -> tuple[list, list]:
    """Base spans, and those that lexing adds: literals of enough score that no base span holds."""
    text = text or ""
    base = sorted(base_spans(text))
    added, k, reach = [], 0, 0  # reach: where the base spans that begin so far end at most
    for a, b, _, score in lexed_literals(text):
        while k < len(base) and base[k][0] <= a:
            reach, k = max(reach, base[k][2]), k + 1
        if score >= least_score and b > reach:
            added.append((a, 3, b))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def find_secrets(docs: DataFrame, text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default), counts by kind, base_sha256 and spans (kind:start:end by start, comma-joined).

    Null and empty texts have no spans; repeated rows are each scanned; an empty table gives no rows; offsets count code points and ends are exclusive.
    """

    def work(texts):
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for t in texts:
            base, added = scan(t)
            counts = Counter(k for _, k, _ in (*base, *added))
            for i, k in enumerate(KINDS):
                out[f"n_{k}"].append(counts[i])
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined([*base, *added]))
        return out

    return with_text(docs, text_col, work, FIELDS, keep=keep)


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    if text is None:
        return None
    base, added = scan(text)
    out, at = [], 0
    for a, _, b in sorted([*base, *added]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; nulls, empty texts and repeats as find_secrets has them."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", *(f.name for f in FIELDS))


QUERIES = {"op4_secret_scan": op4_secret_scan}
ORACLES: dict[str, str] = {}

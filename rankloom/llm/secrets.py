"""Secret scans by assignment-aware lexing (operator 1).

Three base patterns find secrets anywhere. On top of them a lexer reads source and configuration syntax into
name-literal pairs. Targets: ``name = ...``, ``name: type = ...``, ``"name": ...``, ``name => ...``, ``:=``, ``export NAME=...``,
subscripts (``environ["NAME"] = ...``), and attributes that name another (``key="name" value="..."``). Values: quoted literals
with escapes, also triple-quoted and prefixed ones, over several operands (``+``, ``or``, ``||``, ``??``, side by side); bare
words of INI, environment files and YAML; YAML blocks (``name: |``). Calls and dotted names of code are no literals, nor is
what stands between a call's parentheses (but pairs there count).

Constants are propagated through ``name = other_name`` and ``name = other_name.method()`` within a text, and each literal is
scored by how sensitive the names are that it reaches. A literal at or above the threshold becomes a span of kind ``lexed``;
it never replaces a base span.

Spans are (kind, start, end) in code points of the whole match, end exclusive.

Defined cases: null text counts as empty (no span, redacted text stays null); very long texts are
scanned whole, in one pass; ties (spans that begin together) go by kind as listed, then by end; repeated rows give repeated
results; empty tables give empty results; other columns pass through redact() untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, cell, packed, quoted, sliced, slices, texts, unpacked, values

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Scores of name parts; a target's score is the largest of its parts.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "private": 0.6,
    "privatekey": 1.0, "accesskey": 1.0, "signing": 0.6, "cookie": 0.5, "session": 0.4, "salt": 0.5, "key": 0.4, "access": 0.4, "client": 0.2,
}
THRESHOLD = 1.2
MIN_LITERAL = 8
#: A target and its sign. A name is whole, however long: without quotes it is looked for only where a run of its characters begins, so one pass does.
_TARGET = re.compile(r"""(?:(?P<q>["'])|(?<![A-Za-z0-9_.\-])[0-9.\-]*)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)(?(q)(?P=q))\]?[ \t]*(?::=|=>|=(?![=~])|(?P<colon>:(?!:)))[ \t]*""", re.A)
_STRING = re.compile(r"""[rRbBfFuU]{0,2}(?P<open>\"{3}|'{3})(?P<lit>(?:(?!(?P=open))(?:\\.|[^\\]))*?)(?P=open)""", re.S)
_SHORT = re.compile(r"""[rRbBfFuU]{0,2}(?:"(?P<a>(?:[^"\\\n]|\\.)*)"|'(?P<b>(?:[^'\\\n]|\\.)*)'|`(?P<c>[^`\n]*)`)""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=]+(?:={1,2}(?![^\s"'`,;(){}\[\]<>]))?""")
_TYPED = re.compile(r"(?:\[[^\]\n]{0,200}\])?[ \t]*=(?!=)[ \t]*")
_NEXT = re.compile(r"""[ \t]*(?:\+|\|\||\?\?|or\b|(?=["'`]))[ \t]*""")
_CHAIN = re.compile(r"(?:\.[A-Za-z_]\w*)*\(", re.A)
_CODE = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+", re.A)
_INSIDE = re.compile(r"""[^()"'`\n]+|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|.""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*\n")
_NAMING, _VALUE = ("key", "name", "id", "param"), ("value", "default", "content")
#: Characters that a call's parentheses may span.
CALL = 200
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|changeme|example|none|null|true|false|todo|<.*|\$\{.*|%\(.*|\{\{.*)\Z")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three base patterns, by start and then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def name_score(name: str) -> float:
    """How sensitive a target name is, by its words (camel case, snake case, dots, dashes)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    return max((NAME_SCORES.get(p, 0.0) for p in parts + joined), default=0.0)


def literal_score(literal: str) -> float:
    """How much a literal looks like a secret: its length, character classes and entropy a character."""
    n = len(literal)
    if n < MIN_LITERAL or " " in literal or _PLACEHOLDER.match(literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.4 * (entropy > 2.5) + 0.3 * (classes >= 2) + 0.3 * (n >= 16) + 0.2 * (entropy > 3.5))


#: A value's operand: text, start, end, and whether it is a literal (quoted, block), a bare word, or a name that a call or code refers to.
Operand = tuple[str, int, int, str]


def _after_call(text: str, at: int) -> int | None:
    """Behind the parentheses that open at `at`; None if they don't close in the line, or CALL characters."""
    depth, stop = 0, min(len(text), at + CALL)
    while at < stop and (m := _INSIDE.match(text, at)):
        depth += (m[0] == "(") - (m[0] == ")")
        at = m.end()
        if not depth:
            return at
    return None


def _quoted(text: str, at: int) -> Operand | None:
    if m := _SHORT.match(text, at):
        if m[m.lastgroup] or text[m.end() : m.end() + 1] != m[0][-1]:  # an empty literal before its quote begins a triple one
            return m[m.lastgroup], m.start(m.lastgroup), m.end(m.lastgroup), "literal"
    m = _STRING.match(text, at)
    return (m["lit"], m.start("lit"), m.end("lit"), "literal") if m else None


def _block(text: str, at: int, name_at: int) -> list[Operand]:
    """The lines of a YAML block, which are indented more than its name's line."""
    begin = text.rfind("\n", 0, name_at) + 1
    indent = len(text[begin:name_at]) - len(text[begin:name_at].lstrip(" -"))
    found = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
            break
        if word := line.strip():
            found.append((word, at + line.index(word), at + line.index(word) + len(word), "literal"))
        at = end + 1
    return found


def operands(text: str, at: int, name_at: int, colon: bool) -> tuple[list[Operand], int]:
    """(operands of the value that begins at `at`, where to look for the next target: behind them, or within a call)."""
    if colon and (m := _BLOCK.match(text, at)):
        return _block(text, m.end(), name_at), m.end()
    found: list[Operand] = []
    onward = None
    while True:
        if one := _quoted(text, at):
            found.append(one)
            at = one[2] + 1
            while text[at : at + 1] in ('"', "'") and text[at - 1] == text[at]:
                at += 1  # the rest of three quotes
        elif m := _BARE.match(text, at):
            at, word = m.end(), m[0]
            if text[at : at + 1] == "(":
                found.append((word.split(".")[0], m.start(), at, "name"))
            elif colon and (more := _TYPED.match(text, at)):
                at, colon = more.end(), False  # a type; the value comes after it
                continue
            else:
                found.append((word, m.start(), at, "name" if _CODE.fullmatch(word) else "bare"))
                if text[at : at + 1] == "=":
                    return found, m.start() if onward is None else onward  # the word is a target itself
        else:
            return found, at if onward is None else onward
        while m := _CHAIN.match(text, at):
            onward = m.end() if onward is None else onward
            if (at := _after_call(text, m.end() - 1)) is None:
                return found, onward
        if not (m := _NEXT.match(text, at)):
            return found, at if onward is None else onward
        at = m.end()


def lexed_pairs(text: str) -> list[tuple[str, list[Operand]]]:
    """(name, operands of its value) of each assignment-like pair, in text order."""
    if "=" not in text and ":" not in text:
        return []
    found, given = [], None  # given: a name that an attribute gives to the next one's value
    at = 0
    while m := _TARGET.search(text, at):
        parts, onward = operands(text, m.end(), m.start("name"), m["colon"] is not None)
        name, at = m["name"], max(onward, m.end())
        if not parts:
            continue
        if given and name.lower() in _VALUE and "\n" not in text[given[1] : m.start()] and m.start() - given[1] < 80:
            name = given[0]
        given = (parts[0][0], parts[0][2]) if name.lower() in _NAMING and parts[0][3] == "literal" and re.fullmatch(r"[A-Za-z_][\w.\-]*", parts[0][0]) else None
        found.append((name, parts))
    return found


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name, directly or through constants of the same text."""
    reach: dict[tuple[int, int], tuple[str, float]] = {}  # of literals, by place
    holder: dict[str, list[tuple[int, int]]] = {}  # the literals that a name holds at this point of the text
    for name, parts in lexed_pairs(text):
        mine, score = [], name_score(name)
        for value, start, end, kind in parts:
            known = holder.get(value) or (holder.get(value.split(".")[0]) if kind != "literal" else None)
            if kind != "literal" and known:
                for place in known:
                    reach[place] = reach[place][0], max(reach[place][1], score)
                mine += known
            elif kind != "name":
                place = (start, end)
                reach[place] = value, max(score, reach.get(place, ("", 0.0))[1])
                mine.append(place)
        holder[name] = mine
    return [("lexed", s, e) for (s, e), (value, score) in reach.items() if score and (looks := literal_score(value)) and score + looks >= THRESHOLD]


def all_spans(text: str) -> tuple[list, list]:
    """Base spans, and all spans, each by start and then kind as listed."""
    base = base_spans(text)
    more = lexed_spans(text)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def redact_text(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each union of overlapping spans replaced by mark."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts a kind, digest of the base spans, all spans, and the structs of all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, spans string"
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in texts(b.column(1)):
                base, spans = all_spans(text)
                kinds = Counter(k for k, _, _ in spans)
                rows.append((*(kinds[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield batch(out, [b.column(0), *(zip(*rows, strict=True) if rows else [[]] * 6)])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with secrets in text_col replaced, and length_col (where there is one) brought up to date; only texts go to Python."""

    def clean(column: pa.Array) -> pa.Array:
        return sliced(column, lambda part: [t if t is None else redact_text(t, all_spans(t)[1]) for t in values(part)], pa.string())

    arrow_batches(df.sparkSession)
    rows = packed(df, clean=F.arrow_udf(clean, "string")(df[quoted(text_col)]))
    new = {text_col: F.col("clean")}
    if length_col in df.columns:
        size = F.when(F.col("clean") == cell(text_col), cell(length_col)).otherwise(F.length("clean").cast(df.schema[length_col].dataType))
        new[length_col] = F.coalesce(size, cell(length_col))
    return unpacked(rows, df.columns, new)


def op1_secret_scan(spark, sf_dir):
    from rankloom.llm.common import table

    return scan(table(spark, sf_dir, "documents"))

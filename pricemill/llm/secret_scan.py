"""Operator 8 — secret scans by assignment-aware lexing.

Three fixed patterns find the plain cases. On top of them, lines that assign are lexed into targets,
operators, string literals and names; constants are propagated through names and concatenations; and
what a sensitively named target ends up holding is scored by the target's words and by the look of
the value. The literals behind a flagged value are spans of kind ``literal``, wherever they stand.

A name has the value of its latest assignment before it is used, or of its first one if it is used before; chains
may be of any length. A statement runs over a line end at a joining sign and at a backslash.

A text is scanned whole and on its own, in Arrow batches; only texts that hold an assignment sign and
a telling stem are lexed.

Defined results: null and empty texts have no spans; repeated rows get the same spans; an empty table
gives no rows; other columns pass through, ``spans`` replaces a column of that name.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents

# The base patterns and the shortest secret of each kind.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "literal")
# Stems without which the assignment pattern can't match, and those without which no target is sensitive.
ASSIGN_STEMS = ("passw", "secret", "token", "apikey", "api_key")
TARGET_STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "private")
# Words of a target's name: those that tell by themselves, and those that tell in front of "key".
STRONG = {"password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials", "accesskey", "secretkey", "authtoken"}
BEFORE_KEY = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "service", "storage", "account"}
NOT_A_VALUE = {"true", "false", "none", "null", "changeme", "change_me", "example", "password", "secret", "token", "undefined", "redacted", "placeholder"}

TOKEN = (r"""(?P<text>"(?:[^"\\\n]|\\\r?\n|\\.)*"|'(?:[^'\\\n]|\\\r?\n|\\.)*'|`[^`\n]*`)"""
         r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*(?:\[["'][\w.\-]+["']\])?)"""
         r"""|(?P<assign>:=|=>|(?<![=!<>+*/|&^%~-])=(?![=~])|:(?![:/]))|(?P<join>\+(?!=)|\.(?=\s))|(?P<blank>(?:[ \t\r]|\\\r?\n)+)|(?P<line>\n)|(?P<other>.)""")
BARE = r"^[ \t]*(?:-[ \t]+)?(?:export[ \t]+|set[ \t]+|ENV[ \t]+)?([A-Za-z_][\w.\-]*)[ \t]*[=:][ \t]*([^\s\"'`;,(){}<>$]+)[ \t\r]*(?:#.*)?$"
RULES = {k: re.compile(p, f) for k, p, f in (("assign", ASSIGN, re.I | re.A), ("access", ACCESS, 0), ("hex", r"[0-9a-f]{24,}", 0),
                                             ("token", TOKEN, re.A), ("bare", BARE, re.A), ("part", r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A))}


def base_spans(text: str, low: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, secret's start, secret's end) of the fixed patterns, leftmost first."""
    found = []
    if any(stem in low for stem in ASSIGN_STEMS):
        found += [("assign", *m.span(), *m.span(2)) for m in RULES["assign"].finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in RULES["access"].finditer(text) if len(m[0]) >= LEAST["access"]]
    # A run of hex digits is maximal either way, so the length can stand in the pattern.
    found += [("hex", *m.span(), *m.span()) for m in RULES["hex"].finditer(text)]
    return found


def sensitivity(name: str) -> int:
    """2 for a name that promises a secret, 1 for one that may, 0 otherwise; name's last part counts."""
    words = [w.lower() for w in RULES["part"].findall(re.split(r"[.\[]", name.rstrip("\"']"))[-1].strip("\"'"))]
    if not words:
        return 0
    joined = {a + b for a, b in zip(words, words[1:])}
    if STRONG & (set(words) | joined) or any(w == "key" and words[i - 1] in BEFORE_KEY for i, w in enumerate(words) if i):
        return 0 if words[-1] in ("name", "length", "type", "field", "count", "url", "uri", "path", "file", "id", "label", "expiry", "ttl") else 2
    return 1 if {"key", "auth", "pass", "cred", "creds"} & set(words) else 0


HEAD = 32  # first characters of a value that tell a placeholder


def look(value: str) -> tuple[int, str, Counter]:
    """What ``secrecy`` needs of a value: its length, its head and how often it has each character."""
    return len(value), value[:HEAD], Counter(value)


def joined_look(looks: list) -> tuple[int, str, Counter]:
    """The look of a concatenation, without building it: a name may stand in it very often."""
    n, head, total = 0, "", Counter()
    for size, first, count in looks:
        if n < HEAD:
            head = (head + first)[:HEAD]
        n += size
        total.update(count)
    return n, head, total


def secrecy(value: str | tuple[int, str, Counter]) -> int:
    """Points for the look of a value: length, mixed characters, spread; 0 for a placeholder."""
    n, head, count = look(value) if isinstance(value, str) else value
    low, chars = head.lower(), "".join(count)
    if n < 6 or re.search(r"\s", chars) or n <= HEAD and low in NOT_A_VALUE or re.match(r"(your|my|some|the)[-_ ]|<|\$\{|\{\{|%\(", low) or len(set(chars.lower())) < 4:
        return 0
    bits = -sum(c / n * math.log2(c / n) for c in count.values() if c / n)
    kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 1 + (n >= 16) + (kinds >= 2) + (bits >= 3)


def literal_spans(text: str, low: str) -> list[tuple[str, int, int, int, int]]:
    """Literals that reach a sensitive target, by name-literal pairs and constants."""
    if not any(stem in low for stem in TARGET_STEMS):
        return []
    statements: list[tuple[str, list]] = []  # (target, terms); a term is a name or (start, end) of a literal
    bare: list[tuple[str, int, int]] = []
    lines = text.split("\n")
    start = begin = 0
    for i, line in enumerate(lines):
        if ("=" in line or ":" in line) and (m := RULES["bare"].match(line)):
            bare.append((m[1], start + m.start(2), start + m.end(2)))
        start += len(line) + 1
        # A statement goes on after a joining sign or a backslash at the end, or before a joining sign.
        if i + 1 == len(lines) or not line.rstrip().endswith(("+", ".", "\\")) and not lines[i + 1].lstrip().startswith(("+", ".")):
            block = text[begin:start - 1]
            if "=" in block or ":" in block:
                statements += _statements(block, begin)
            begin = start
    assigned: dict[str, list[int]] = {}  # the statements that assign a name, in order
    for i, (target, _) in enumerate(statements):
        assigned.setdefault(target, []).append(i)

    def source(name: str, use: int) -> int | None:
        """The statement that ``name`` has its value from in statement ``use``: the latest before it, else the first."""
        own = assigned.get(name)
        return own[max(bisect_left(own, use) - 1, 0)] if own else None

    needs = [[source(t, i) for t in terms if isinstance(t, str)] for i, (_, terms) in enumerate(statements)]
    known: dict[int, tuple | None] = {}  # look of each statement's value, None if it isn't a constant

    def value(wanted: int) -> tuple | None:
        stack, begun = [wanted], set()
        while stack:
            i = stack[-1]
            if i not in known:
                later = [n for n in needs[i] if n not in known]
                # An unknown name, or a circle: nothing is known about the value.
                if None in needs[i] or any(n in known and known[n] is None for n in needs[i]) or i in later or begun.intersection(later):
                    known[i] = None
                elif later:
                    begun.add(i)
                    stack += later
                    continue
                else:
                    of = iter(needs[i])
                    known[i] = joined_look([known[next(of)] if isinstance(t, str) else look(text[t[0]:t[1]]) for t in statements[i][1]])
            begun.discard(i)
            stack.pop()
        return known[wanted]

    flagged = []
    for i, (target, _) in enumerate(statements):
        if (sure := sensitivity(target)) and (has := value(i)) and (points := secrecy(has)) and sure + points >= (3 if sure == 2 else 5):
            flagged.append(i)
    spans, done = set(), set()
    while flagged:
        if (i := flagged.pop()) not in done:
            done.add(i)
            flagged += needs[i]
            spans |= {t for t in statements[i][1] if not isinstance(t, str) and t[1] > t[0]}
    for target, a, b in bare:
        held = text[a:b]
        if sensitivity(target) == 2 and held not in assigned and secrecy(held) >= 3 and re.search("[0-9]", held):
            spans.add((a, b))
    return [("literal", a, b, a, b) for a, b in sorted(spans)]


def _statements(block: str, start: int) -> list[tuple[str, list]]:
    """Assignments of lines that belong together: a name or quoted key, a sign, then literals and names joined by + or '.'."""
    tokens = [(m.lastgroup, m[0], m.start()) for m in RULES["token"].finditer(block) if m.lastgroup != "blank"]
    kinds = [t[0] for t in tokens] + ["end"] * 3

    def after_lines(j: int) -> int:
        while kinds[j] == "line":
            j += 1
        return j

    out = []
    for i in range(1, len(tokens) - 1):
        if kinds[i] != "assign" or kinds[i - 1] not in ("name", "text"):
            continue
        terms, j = [], i + 1
        while kinds[j] in ("name", "text"):
            kind, what, at = tokens[j]
            if kind == "name":
                terms.append(what)
            else:  # a literal that a backslash carries over a line end has a part on each line
                cuts = [(0, 1), *[m.span() for m in re.finditer(r"\\\r?\n", what)], (len(what) - 1, len(what))]
                terms += [(start + at + a, start + at + b) for (_, a), (b, _) in zip(cuts, cuts[1:])]
            join = after_lines(j + 1)
            if kinds[join] != "join":
                break
            more = after_lines(join + 1)
            # Over a line end, a sign that may belong to something else joins only a literal.
            unsure = join > j + 1 or more > join + 1 and tokens[join][1] == "."
            if unsure and (kinds[more] != "text" or kinds[more + 1] == "assign"):
                break
            j = more
        if terms:
            out.append((tokens[i - 1][1].strip("\"'`"), terms))
    return out


def find(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """All spans of a text by start, then kind; the last two numbers bound the secret itself."""
    if not text:
        return []
    low = text.lower()
    base = base_spans(text, low)
    more = literal_spans(text, low) if "=" in text or ":" in text else []
    if base:
        more = [s for s in more if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans(text: Column) -> Column:
    """Array of (kind, start, end), in code points, end exclusive."""
    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b, _, _ in find(t.as_py())] for t in texts], kind)

    return run(text)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``."""
    return docs.withColumn("spans", spans(F.col(text)))


def redacted(text: Column, mark: str = "[secret]") -> Column:
    """The text with every found secret replaced; null stays null."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            if hit := find(t):
                parts, at = [], 0
                for a, b in sorted((s[3], s[4]) for s in hit):
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return run(text)


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets of every document."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("literal").alias("n_literal"))

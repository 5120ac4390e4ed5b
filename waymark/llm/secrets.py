"""Operator 7: secret scans by assignment-aware lexing.

Base kinds are found by their patterns, leftmost and non-overlapping per kind; matches whose secret is too short are
dropped. The method adds spans of kind ``lex``: a lexer and reader for the syntax that source and
configuration share (names, quoted, triple-quoted, back-quoted and armoured strings with escapes, line continuation,
concatenation, brackets, calls, indentation, sections, tags) turns a text into name-literal pairs:

* ``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``map["name"] = "literal"``, ``--name literal``,
  ``<name>literal</name>``, ``<entry key="name" value="literal"/>``, block scalars, comparisons, the literal on the next line;
* several literals put together (``"a" + "b"``, or side by side) are judged as one, and calls around a literal are looked
  through; alternatives and elements of a list are judged apart;
* ``set_name("literal")``, ``put("name", "literal")``, and what a function called ``name`` returns;
* pairs inside comments and inside strings.

Constants are propagated (``KEY = "..."`` then ``password = KEY``, at any distance and in either order, chains, calls and
concatenations included) in the scope of the function where the name is assigned, else in the whole text. A literal is
scored by its target names: it counts where a name that it reaches has a sensitive word among its words and the literal
itself looks like a secret (eight characters or more, no spaces, letters and digits mixed or of high entropy, no placeholder;
line breaks, indents and armour of a key that has several lines, and a scheme such as ``Bearer`` aside). Under a sensitive
mapping, section or element (``credentials: {prod: ...}``) a literal must look more so. Names and literals have no greatest
length. A ``lex`` span is the literal without its quotes, and is left out where a base span covers it.

Texts in which no sensitive word occurs are passed over, which changes no result. Extra columns are not read, or kept by
``redact``.
Spans are code points, end exclusive. Nulls and empty texts have none. Rows are scanned one by one, nothing is
shuffled, and the whole of each text is read; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ship_package, table

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is a whole run, from its start
KINDS = ("assign", "access", "hex")
# words of names that make a literal sensitive (own list)
SENSITIVE = frozenset("password passwd pwd passphrase secret secrets token apikey credential credentials auth authorization bearer privatekey accesskey signature salt".split())
PAIRED = frozenset([("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key")])
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|changeme|example|placeholder|your[_-].*|<.*>|\$\{.*\}|none|null|true|false|undefined)$")
# a literal runs to its closing quote, whatever its length: triple-quoted, armoured key, escapes heeded, or as plainly as it stands
LITERALS = (
    r'"{3}(?P<d3>(?:[^"\\]++|\\.|"(?!""))++)"{3}', r"'{3}(?P<s3>(?:[^'\\]++|\\.|'(?!''))++)'{3}", r"""(?P<kq>["'])(?P<key>\s*-----BEGIN [^"'`]*?-----END [A-Z0-9 ]+-----\s*)(?P=kq)""",
    r'"(?P<d>(?:[^"\\\n]++|\\.)++)"', r"'(?P<s>(?:[^'\\\n]++|\\.)++)'", r"`(?P<b>(?:[^`\\]++|\\.)++)`", r"""(?P<pq>["'`])(?P<plain>[^"'`\n]+)(?P=pq)""", r"(?P<bare>[A-Za-z0-9_+/.=-]++)",
)
STRING = re.compile(r"""(?:[rRbBfFuU@$]{1,2}(?=["']))?(?:""" + "|".join(x for x in LITERALS if "bare" not in x) + ")", re.DOTALL)
BARE = re.compile(r"[A-Za-z0-9_+/.=-]++")
PLAIN = re.compile(r"""(["'`])([^"'`\n]+)\1""")
INSIDE = re.compile(r"""["'`\\\n]""")  # a literal with any of these may hold pairs of its own
ARMOUR = re.compile(r"-----(?:BEGIN|END)[^-]*-----")
BREAK = re.compile(r"\n|\\r|\\n")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
SCHEME = re.compile(r"(?i)(?:bearer|basic|token|digest)[ ]+(?=\S)")
#: What any sensitive name has in it, in lower case.
STEMS = re.compile("passw|pwd|passphrase|secret|token|api|credential|auth|bearer|private|access|signature|salt|signing|encryption")
# what the reader stops at
SCAN = re.compile(r"""
    (?P<line>\n[ \t]*+(?:-[ \t]++)?) | (?P<section>(?<![^\n])\[[ \t]*(?P<part>[A-Za-z_][\w. -]*)\][ \t]*(?=\n|\Z))
  | \b(?:def|function|func|fn|sub|method)[ \t]++(?P<function>[A-Za-z_$][\w$]*+) | (?P<returns>\breturn\b)
  | (?<![\w-])--(?P<flag>[A-Za-z][\w.-]*+)[ \t]++(?=[A-Za-z0-9+/_"'.]) | <(?P<tag>[A-Za-z_][\w.:-]*+)(?P<attributes>[^<>]*+)> | (?P<ended></[A-Za-z_][\w.:-]*+)
  | (?P<word>[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_][\w$]*+)*+) | [0-9.-]++(?P<after>[A-Za-z_][A-Za-z0-9_.-]*+)? | (?P<quote>["'`]) | (?P<open>[\[{(]) | (?P<close>[\]})])
""", re.VERBOSE)
ASSIGNS = re.compile(r"""[ \t]*+\]?[ \t]*+(?P<op>:=|\?=|\+=|=>|<-|={1,3}|!==?|:(?![:/]))[ \t]*+""")
GAP = re.compile(r"""(?:\\\n[ \t]*+|\n[ \t]*+(?=["'`]))?""")  # a literal on the next line
BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*\n(?P<first>[ \t]+)")
JOIN = re.compile(r"""[ \t]*+(?P<by>\+|\.{1,2}(?=[ \t"'`])|&(?!&))[ \t]*+(?:\\?\n[ \t]*+)?""")
BESIDE = re.compile(r"""[ \t]*+(?:\\\n[ \t]*+)?(?=[rRbBfFuU]{0,2}["'])""")
BESIDE_INSIDE = re.compile(r"""\s*+(?=[rRbBfFuU]{0,2}["'])""")  # in parentheses
ELSE = re.compile(r"[ \t]*+(?:\|\||\?\?|\bor\b)[ \t]*+")
CALL = re.compile(r"(?P<name>[A-Za-z_$][\w$.:]*+)[ \t]*+\(\s*+")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*)[ \t\n]*=[ \t\n]*(?:"([^"<>]*)"|'([^'<>]*)')""")
NAMING, VALUED = frozenset(("key", "name", "id", "property")), frozenset(("value", "val", "content", "data"))


@lru_cache(10_000)
def sensitive(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    return any(w in SENSITIVE for w in words) or any(p in PAIRED for p in zip(words, words[1:], strict=False))


def looks_secret(s: str, strictly: bool = False) -> bool:
    if "\n" in s or "-----BEGIN" in s:  # the lines of a key, without its armour
        s = "".join(x.strip() for x in BREAK.split(ARMOUR.sub("", s)))
    if len(s) < 8 or any(c.isspace() for c in s) or PLACEHOLDER.match(s):
        return False
    kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    if strictly:
        return len(s) >= 12 and bool(re.search("[A-Za-z]", s)) and bool(re.search("[0-9]", s)) and entropy >= 3.0 and "/" not in s[:1] and "://" not in s
    return (kinds >= 2 and bool(re.search("[0-9]", s)) and entropy >= 2.5) or entropy >= 4.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


class Reader:
    """Name-literal pairs of one text, and which names are assigned to which."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[int, str, bool, str, tuple[tuple[int, int], ...]]] = []  # scope, name, whether a name around is sensitive, literal, its spans
        self.copies: list[tuple[int, str, int, str]] = []  # from (scope, name) to (scope, name)
        self.scopes: list[tuple[int, str, int | None, int | None]] = [(-1, "", None, None)]  # parent, function, indent, bracket depth
        self.scope, self.waiting = 0, None  # and the function whose body is to come
        # each with whether it or one around it is sensitive
        self.brackets: list[tuple[str, str | None, str | None, bool]] = []  # kind, what it belongs to, the last string in it
        self.mappings: list[tuple[int, bool]] = []  # indent of mappings by indentation
        self.tags: list[tuple[str, bool]] = []
        self.open_tags: Counter = Counter()
        self.section, self.indent, self.line_end, self.by_indent = "", 0, -1, False

    def around(self) -> bool:
        return sensitive(self.section) or any(stack and stack[-1][-1] for stack in (self.mappings, self.brackets, self.tags))

    def bracket(self, kind: str, name: str | None) -> None:
        self.brackets.append((kind, name, None, bool(self.brackets and self.brackets[-1][3]) or (kind != "(" and name is not None and sensitive(name))))

    def literal(self, at: int) -> tuple[str, int, int, int] | None:
        """Of a string at a place: its text, where that starts and ends, and the end with the quotes."""
        if not (m := STRING.match(self.text, at)):
            return None
        return m[m.lastgroup], *m.span(m.lastgroup), m.end()

    def pair(self, name: str, value: str, *spans: tuple[int, int]) -> None:
        if (m := SCHEME.match(value)) and len(spans) == 1:
            value, spans = value[m.end() :], ((spans[0][0] + m.end(), spans[0][1]),)
        self.pairs.append((self.scope, name, self.around(), value, spans))

    def value(self, name: str, at: int) -> int:
        """Reads what is assigned to a name; where to read on: behind it, or inside the first string that may hold pairs."""
        text, depth, again = self.text, 0, None
        at = GAP.match(text, at).end()
        if m := BLOCK.match(text, at):
            return self.block(name, m)
        group: list[tuple[str, int, int]] = []

        def flush() -> None:
            if group:
                self.pair(name, "".join(v for v, _, _ in group), *((s, e) for _, s, e in group))
            group.clear()

        while at < len(text):
            c = text[at]
            if found := self.literal(at) if c in "\"'`" or (c in "rRbBfFuU@$" and text[at + 1 : at + 3].strip("rRbBfFuU")[:1] in ("\"", "'")) else None:
                v, s, e, end = found
                group.append((v, s, e))
                if INSIDE.search(v):
                    again = s if again is None else again
                    if not looks_secret(v) and (p := PLAIN.match(text, s - 1)):  # where a backslash is no escape
                        self.pair(name, p[2], p.span(2))
                at = end
            elif c in "[{" and not group and not depth:
                self.bracket(c, name)
                return at + 1
            elif c == "(":
                depth, at = depth + 1, BESIDE_INSIDE.match(text, at + 1).end() if BESIDE_INSIDE.match(text, at + 1) else at + 1
                continue
            elif m := CALL.match(text, at):
                self.copies.append((self.scope, m["name"], self.scope, name))
                depth, at = depth + 1, m.end()
                continue
            elif m := BARE.match(text, at):
                if NAME.fullmatch(m[0]) or "." in m[0]:
                    self.copies.append((self.scope, m[0], self.scope, name))
                if not depth and not group:
                    self.pair(name, m[0], m.span())
                at = m.end()
            elif c == "$" and (m := NAME.match(text, at)):
                self.copies.append((self.scope, m[0], self.scope, name))
                at = m.end()
            else:
                break
            # what follows: more of the same literal, another one, or the end
            while depth and (m := re.compile(r"\s*+\)").match(text, at)):
                depth, at = depth - 1, m.end()
            if m := JOIN.match(text, at):
                at = m.end()
            elif group and (m := (BESIDE_INSIDE if depth else BESIDE).match(text, at)) and m.end() < len(text):
                at = m.end()
            elif m := (re.compile(r"\s*+,\s*+").match(text, at) if depth else None) or ELSE.match(text, at):
                flush()
                at = m.end()
            else:
                break
        flush()
        return again if again is not None else at

    def block(self, name: str, m: re.Match) -> int:
        """Lines that are indented further, as one literal."""
        pad, at = m["first"], m.start("first")
        end = at
        while self.text.startswith(pad, end):
            stop = self.text.find("\n", end)
            end = len(self.text) if stop < 0 else stop + 1
        body = self.text[m.end() : end].rstrip()
        self.pair(name, body if "\n" in body else body.strip(), (m.end(), m.end() + len(body)))
        return m.end()

    def read(self) -> None:
        text, at = self.text, 0
        while m := SCAN.search(text, at):
            at, kind = m.end(), m.lastgroup
            if kind == "line":
                self.new_line(m)
            elif kind == "part" or kind == "section":
                self.section = m["part"]
            elif kind == "function":
                self.waiting = m["function"]
                if at > self.line_end:
                    end = text.find("\n", at)
                    self.line_end = len(text) if end < 0 else end
                    line = text[at : self.line_end].partition("#")[0].rstrip()
                    self.by_indent = line.endswith(":") and "{" not in line
                if self.by_indent:
                    self.leave(self.indent)
                    self.enter(self.indent, None)
            elif kind == "returns":
                if fn := self.scopes[self.scope][1]:
                    at = max(at, self.value(fn, re.compile(r"[ \t]*+").match(text, at).end()))
            elif kind == "flag":
                at = max(at, self.value(m["flag"], at))
            elif kind == "attributes" or kind == "tag":
                at = self.element(m)
            elif kind == "ended":
                while self.open_tags[m["ended"][2:]]:
                    name = self.tags.pop()[0]
                    self.open_tags[name] -= 1
                    if name == m["ended"][2:]:
                        break
            elif kind == "open":
                self.bracket(m[0], None)
                if m[0] == "{" and self.waiting:
                    self.enter(None, len(self.brackets))
            elif kind == "close":
                if self.brackets:
                    self.brackets.pop()
                    while self.scopes[self.scope][3] is not None and self.scopes[self.scope][3] > len(self.brackets):
                        self.scope = self.scopes[self.scope][0]
            elif kind in ("word", "after"):
                at = self.named(m[kind], at)
            elif kind == "quote":
                if found := self.literal(m.start()):
                    at = self.string(*found)

    def new_line(self, m: re.Match) -> None:
        self.indent = m.end() - m.start() - 1
        rest = self.text[m.end() : m.end() + 1]
        if rest in ("", "\n", "#"):
            return
        while self.mappings and self.mappings[-1][0] >= self.indent:
            self.mappings.pop()
        self.leave(self.indent)

    def leave(self, indent: int) -> None:
        """The functions by indentation that end where a line starts so far left."""
        while self.scopes[self.scope][2] is not None and self.scopes[self.scope][2] >= indent:
            self.scope = self.scopes[self.scope][0]

    def enter(self, indent: int | None, depth: int | None) -> None:
        self.scopes.append((self.scope, self.waiting, indent, depth))
        self.scope, self.waiting = len(self.scopes) - 1, None

    def named(self, name: str, at: int) -> int:
        if m := ASSIGNS.match(self.text, at):
            if m["op"] == ":" and (self.text[m.end() : m.end() + 1] in ("", "\n") and not re.compile(r"\n[ \t]*[\"'`]").match(self.text, m.end())):
                self.mappings.append((self.indent, sensitive(name) or bool(self.mappings and self.mappings[-1][1])))
                return m.end()
            return max(m.end(), self.value(name, m.end()))
        if self.text[at : at + 1] == "(":
            self.bracket("(", name)
            return at + 1
        if self.brackets and self.brackets[-1][0] == "(" and self.brackets[-1][1]:
            self.copies.append((self.scope, name, self.scope, self.brackets[-1][1]))
        return at

    def string(self, value: str, start: int, end: int, after: int) -> int:
        """A string that no name has taken: a name itself, an argument, or an element."""
        if (m := ASSIGNS.match(self.text, after)) and NAME.match(value) and "\n" not in value:
            return max(m.end(), self.value(value, m.end()))
        if self.brackets:
            kind, name, last, inner = self.brackets[-1]
            if name:
                self.pair(name, value, (start, end))
            if kind == "(" and last and re.compile(r"\s*,\s*[rRbBfFuU]{0,2}[\"'`]{1,3}\Z").search(self.text, max(0, start - 200), start):
                self.pair(last, value, (start, end))
            self.brackets[-1] = (kind, name, value if NAME.match(value) and " " not in value else None, inner)
        return start if INSIDE.search(value) else after

    def element(self, m: re.Match) -> int:
        """``<name>literal`` and the attributes of an element; those are read again as pairs of their own."""
        told, closed = {}, m["attributes"].endswith("/")
        for a in ATTRIBUTE.finditer(self.text, m.start("attributes"), m.end("attributes")):
            told[a[1].lower()] = (a[2] if a[2] is not None else a[3], a.span(2 if a[2] is not None else 3))
        for n in told.keys() & NAMING:
            for v in told.keys() & VALUED:
                self.pair(told[n][0], told[v][0], told[v][1])
        if not closed:
            body = re.compile(r"\s*+([^<>\s]++)\s*+(?=</)").match(self.text, m.end())
            if body:
                for n in (m["tag"], *(told[n][0] for n in told.keys() & NAMING)):
                    self.pair(n, body[1], body.span(1))
            else:
                self.tags.append((m["tag"], sensitive(m["tag"]) or bool(self.tags and self.tags[-1][1])))
                self.open_tags[m["tag"]] += 1
        return m.start("attributes")


def lexed(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name."""
    if not STEMS.search(text.lower()):
        return []
    reader = Reader(text)
    reader.read()
    if not reader.pairs:
        return []
    plain = lambda name: re.sub(r"^(?:[$@&*]+|self\.|this\.)", "", name)
    defined = {(scope, plain(n)) for scope, n, *_ in reader.pairs} | {(to, plain(n)) for _, _, to, n in reader.copies}
    names = {n for _, n in defined}

    def home(scope: int, name: str) -> tuple[int, str]:
        """Where a name is assigned, from the inside."""
        name = plain(name)
        if name not in names and "." in name:
            name = name.rsplit(".", 1)[1]
        while scope > 0 and (scope, name) not in defined:
            scope = reader.scopes[scope][0]
        return max(scope, 0), name

    onward: dict[tuple[int, str], set[tuple[int, str]]] = {}
    for scope, name, to, target in reader.copies:
        onward.setdefault(home(scope, name), set()).add(home(to, target))
    reached: dict[tuple[int, str], bool] = {}

    def reaches(start: tuple[int, str]) -> bool:
        if start not in reached:
            todo, seen = [start], {start}
            reached[start] = False
            while todo:
                x = todo.pop()
                if sensitive(x[1]):
                    reached[start] = True
                    break
                new = onward.get(x, set()) - seen
                seen |= new
                todo += new
        return reached[start]

    out = set()
    for scope, name, around, literal, spans_ in reader.pairs:
        if literal and literal not in names and (sensitive(name) or reaches(home(scope, name))) and looks_secret(literal):
            out.update(spans_)
        elif literal and literal not in names and around and looks_secret(literal, strictly=True):
            out.update(spans_)
    return sorted(out)


def covered(found: list[tuple[int, int]], by: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that no span of a list has in it, in one pass: the furthest end of those that start no later decides."""
    out, k, far = [], 0, -1
    for s, e in sorted(found):
        while k < len(by) and by[k][0] <= s:
            far, k = max(far, by[k][1]), k + 1
        if e > far:
            out.append((s, e))
    return out


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: by start, then kind as listed, ``lex`` last."""
    base = base_spans(text)
    more = [(s, e, "lex") for s, e in covered(lexed(text), base)]
    order = {k: i for i, k in enumerate((*KINDS, "lex"))}
    return base, sorted(base + more, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redacted(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, e, _ in sorted(found):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if found else text


def scanner():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(1).to_pylist():
                base, every = spans(t or "")
                n = Counter(k for *_, k in base)
                row = (n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: counts of base kinds, the base digest, all spans."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(scanner(), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def _redactor(text_at: int, chars_at: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lengths = list(batch.columns), batch.column(chars_at).to_pylist()
            out = []
            for i, t in enumerate(batch.column(text_at).to_pylist()):
                clean = t and redacted(t, spans(t)[1], mark)
                if clean != t:
                    lengths[i] = len(clean)
                out.append(clean)
            columns[text_at], columns[chars_at] = pa.array(out, pa.string()), pa.array(lengths, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def redact(docs: DataFrame, mark: str) -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced by the mark, and ``n_chars`` of changed texts counted anew."""
    ship_package(docs.sparkSession)
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(_redactor(docs.columns.index("text"), docs.columns.index("n_chars"), mark), schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))

"""Secret scan by assignment-aware lexing.

Three base patterns (assignments to well-known names, cloud access keys, long hex runs) always report.
On top of them source and configuration syntax is lexed around every assignment operator into (name,
expression) pairs: the name left of ``=``, ``:``, ``:=`` or ``=>`` (quoted keys, subscripts, type
annotations included), and on the right a chain of string literals (also triple-quoted or over several
lines), bare values and names joined by ``+``, a heredoc or a YAML block scalar.  Names are constants:
an expression that mentions one takes over its literals, from the nearest assignment before it, else the
first after it, through any number of steps.  A literal that reaches a sensitive name is scored by the
most sensitive name it reaches and by its own shape, and reported with kind ``lexed`` at its own place.
Constants are propagated once: weights go down from names to the literals they reach, the shape of a whole
concatenation (length, character counts) goes up from literals to names; where the whole scores, its parts are reported.

Work is per document on whole texts (Arrow batches of small lists of texts); nothing is shuffled.
Defined results: null text counts as empty and has no spans; repeated rows are scanned each on its
own; extra columns of the input are kept by :func:`scan` (but for those named like its outputs, which
it replaces) and :func:`redact`.  Ties (spans of several kinds at one place) go in the order of kinds; an empty table gives
no rows.  Whole texts are read, at a cost linear in the text and in the literals that reach sensitive names; only operators
and their expressions are lexed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
KEYWORD = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.ASCII)
MASK = "[SECRET]"

OPERATOR = re.compile(r"[=:]")
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$@")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
TERM = re.compile(
    r"""[ \t]*(?:[fFrRbBuU]{0,2}(?P<quote>\"{3}|'{3}|["'`])(?P<text>(?:\\(?s:.)|(?!(?P=quote))[^\\])*)(?P=quote)"""
    r"""|(?P<bare>[^\s"'`,;#&|<>(){}\[\]+]+(?:\+(?=[^\s"'`+])[^\s"'`,;#&|<>(){}\[\]+]+)*))""")
PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?:\\?\n[ \t]*)?")
BLOCK = re.compile(r"[ \t]*[|>][-+1-9]{0,2}[ \t]*(?:#[^\n]*)?\n")  # YAML
HEREDOC = re.compile(r"""[ \t]*(?:["']?\$\([ \t]*cat[ \t]*)?<<<?[-~]?[ \t]*(?P<mark>["'`]?)(?P<tag>[A-Za-z_]\w*)(?P=mark)[^\n]*\n""")
INDENT = re.compile(r"[ \t]*(?:-[ \t]+)*")
LINE_WORD = re.compile(r"^[ \t]*([A-Za-z_]\w*)", re.M)
# Weights of name words; two-word names count if both occur
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3,
             "credential": 3, "credentials": 3, "bearer": 2, "auth": 2, "authorization": 2, "privatekey": 3, "accesskey": 3,
             "secretkey": 3, "signingkey": 3, "jwt": 2, "dsn": 1, "pin": 1, "salt": 1}
SENSITIVE_PAIRS = {("api", "key"): 3, ("access", "key"): 3, ("private", "key"): 3, ("signing", "key"): 3, ("encryption", "key"): 3,
                   ("master", "key"): 3, ("connection", "string"): 2, ("client", "key"): 2}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|changeme|change_me|example.*|your[_-].*|dummy.*|todo|test|"
                         r"placeholder|redacted|secret|password|<.*>|\$\{.*|\{\{.*|%\(.*|\$[A-Za-z_].*)$")
PLACEHOLDER_START = re.compile(r"(?i)^(?:example|your[_-]|dummy|\$\{|\{\{|%\(|\$[A-Za-z_])")
SCORE_LIMIT = 4.0


@dataclass
class Assignment:
    name: str
    at: int
    literals: list[tuple[int, int, bool]] = field(default_factory=list)  # (start, end, quoted)
    names: list[str] = field(default_factory=list)


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start of the secret, its end) of the base patterns."""
    out = []
    if KEYWORD.search(text):
        out += [("assign", m.start(), m.end(), m.start(1), m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _name_before(text: str, end: int) -> tuple[str, int]:
    """The name that ends right before ``end`` (white space, quotes and subscript closers skipped), and its start."""
    i = end
    while i and text[i - 1] in " \t":
        i -= 1
    while i and text[i - 1] in "\"'`])":
        i -= 1
    j = i
    while j and text[j - 1] in NAME_CHARS:
        j -= 1
    return text[j:i].strip(".-"), j


def _indented(text: str, at: int, key: int) -> int:
    """End of the lines from ``at`` on that are empty or indented deeper than the key of the line that holds ``key``."""
    line = text.rfind("\n", 0, key) + 1
    depth = INDENT.match(text, line).end() - line
    while at < len(text):
        end = text.find("\n", at) % (len(text) + 1)  # not found: the text's end
        if text[at:min(end, at + depth + 1)].strip():
            return at
        at = end + 1
    return len(text)


NONSPACE = re.compile(r"\S")


def _trimmed(text: str, start: int, end: int, ends: dict[int, int]) -> tuple[int, int, bool]:
    """The literal without white space around it; ``ends`` remembers where text ends before an end."""
    m = NONSPACE.search(text, start, end)
    if not m:
        return end, end, True
    if end not in ends:
        k = end
        while text[k - 1].isspace():
            k -= 1
        ends[end] = k
    return m.start(), ends[end], True


def assignments(text: str) -> list[Assignment]:
    """(name, expression) pairs in order of their operators.  What a literal over several lines holds is
    lexed as well, unless the literal is bound to a name of weight 3 and so reported as a whole."""
    out: list[Assignment] = []
    skip = -1
    ends: dict[int, int] = {}
    marks: dict[str, list[int]] | None = None  # first words of lines: ends of heredocs
    for m in OPERATOR.finditer(text):
        p = m.start()
        if p < skip:
            continue  # inside a literal that belongs to an earlier pair
        before, after = text[p - 1] if p else "", text[p + 1] if p + 1 < len(text) else ""
        if before in ("=", "!", "<", ">", ":") or text.startswith(("==", "::", "://"), p):
            continue
        end = p + 1
        if text[p] == ":" and after == "=" or text[p] == "=" and after == ">":
            end = p + 2
        elif text[p] == ":" and before and text[p - 1] in " \t" and after not in ("=", " ", "\t"):
            continue
        name, start = _name_before(text, p)
        if not name:
            continue
        if text[p] == "=":  # "name: type = value"
            k = start
            while k and text[k - 1] in " \t":
                k -= 1
            if k and text[k - 1] == ":" and (owner := _name_before(text, k - 1)[0]):
                name = owner
        pair = Assignment(name, p)
        at = end
        block = None
        if text[p] == ":" and (t := BLOCK.match(text, end)):
            block = t.end(), _indented(text, t.end(), p)
        elif t := HEREDOC.match(text, end):
            if marks is None:
                marks = {}
                for w in LINE_WORD.finditer(text):
                    marks.setdefault(w[1], []).append(w.start(1))
            places = marks.get(t["tag"], [])
            if (k := bisect_left(places, t.end())) < len(places):
                block = t.end(), places[k]
        if block:
            pair.literals.append(_trimmed(text, *block, ends))
            if name_score(name) >= 3:
                skip = block[1]
            out.append(pair)
            continue
        while t := TERM.match(text, at):
            if t["text"] is not None:
                lines, long = "\n" in t["text"], len(t["quote"]) == 3
                if lines and t["quote"] in "\"'" and text[t.end():t.end() + 1].isalnum():
                    break  # an open quote, or an apostrophe
                pair.literals.append(_trimmed(text, *t.span("text"), ends) if lines or long else (*t.span("text"), True))
                if not lines and not long or t["quote"] not in "\"'" and name_score(name) >= 3:
                    skip = t.end()
            elif text[t.end():t.end() + 1] == "(":
                break  # a call
            else:
                pair.names.append(t["bare"].rstrip(".:"))
                pair.literals.append((t.start("bare"), t.start("bare") + len(t["bare"].rstrip(".:")), False))
            if not (plus := PLUS.match(text, t.end())):
                break
            at = plus.end()
        if pair.literals:
            out.append(pair)
    return out


def name_score(name: str) -> int:
    words = [w.lower() for w in WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0) for w in words), default=0)
    best = max([best, *(SENSITIVE.get(a + b, 0) for a, b in zip(words, words[1:]))])
    return max([best, *(w for (a, b), w in SENSITIVE_PAIRS.items() if a in words and b in words)])


def _shape(count: Counter, length: float, placeholder: bool, blank: bool, quoted: bool, weight: int) -> float:
    """Score of a literal by its character counts.  White space inside (pass phrases, key blocks) is only for quoted
    literals of names of weight 3."""
    spaced = any(c.isspace() for c in count)
    if length < 6 or placeholder or spaced and not (quoted and weight >= 3 and not blank):
        return -10.0
    entropy = -sum(n / length * math.log2(n / length) for n in count.values() if n)
    digits = any(c.isdigit() for c in count)
    kinds = digits + any(c.islower() for c in count) + any(c.isupper() for c in count) + any(not (c.isalnum() or c.isspace()) for c in count)
    score = (entropy >= 2.5) + (entropy >= 3.2) + (kinds >= 2) + (length >= 16)
    if not quoted and not digits:
        return -10.0  # a bare word is prose or a name
    return score - (0 if quoted else 0.5)


def literal_score(value: str, quoted: bool, weight: int) -> float:
    """Shape of a literal: length, entropy, mixed classes; placeholders and plain words score low."""
    return _shape(Counter(value), len(value), bool(PLACEHOLDER.match(value)), not value.strip(), quoted, weight)


HEAD = 64
LARGE = 2.0**60


@dataclass
class Whole:
    """What an expression's strings add up to: number of strings, character counts, first and last characters."""
    parts: int = 0
    length: float = 0.0
    count: Counter = field(default_factory=Counter)
    head: str = ""
    last: str = ""

    def add(self, parts: int, length: float, count: Counter, head: str, last: str) -> None:
        self.parts = min(2, self.parts + parts)
        if len(self.head) < HEAD and self.length < HEAD:
            self.head = (self.head + head)[:HEAD]
        self.last = last or self.last
        self.length += length
        for c, n in count.items():
            self.count[c] += n
        if self.length > LARGE:  # shares of characters are what counts
            self.length /= 2.0**30
            for c in self.count:
                self.count[c] /= 2.0**30

    def score(self, weight: int) -> float:
        """As :func:`literal_score` of the whole; of a long one the placeholder is told by its beginning and its end."""
        if self.length <= HEAD:
            placeholder = bool(PLACEHOLDER.match(self.head))
        else:
            one = len({c.lower() for c in self.count}) == 1 and self.head[0] in "xX*."
            placeholder = one or bool(PLACEHOLDER_START.match(self.head)) or self.head[0] == "<" and self.last == ">"
        return _shape(self.count, self.length, placeholder, all(c.isspace() for c in self.count), True, weight)


def _constants(pairs: list[Assignment]) -> list[list[tuple[str, int]]]:
    """Per pair its names that are constants, with the pair each stands for: the nearest before, else the first after."""
    by_name: dict[str, list[int]] = {}
    for i, a in enumerate(pairs):
        by_name.setdefault(a.name, []).append(i)
    out = []
    for k, a in enumerate(pairs):
        found = []
        for n in a.names:
            if (own := by_name.get(n)) and own != [k]:
                j = bisect_left(own, k)
                found.append((n, own[j - 1] if j else own[j] if own[j] != k else own[j + 1]))
        out.append(found)
    return out


def _wholes(text: str, pairs: list[Assignment], uses: list[list[int]], wanted: list[int]) -> dict[int, Whole]:
    """Wholes of the wanted pairs and of all that they use, each made once, used ones first; in a ring of constants the one
    that closes it adds nothing."""
    done: dict[int, Whole] = {}
    begun: set[int] = set()
    todo = [(i, False) for i in reversed(wanted)]
    while todo:
        k, ready = todo.pop()
        if not ready:
            if k not in begun:
                begun.add(k)
                todo.append((k, True))
                todo += [(j, False) for j in uses[k] if j not in begun]
            continue
        whole = Whole()
        for start, end, quoted in pairs[k].literals:
            if quoted and end > start:
                whole.add(1, end - start, Counter(text[start:end]), text[start:min(end, start + HEAD)], text[end - 1])
        for j in uses[k]:
            if (w := done.get(j)) and w.parts:
                whole.add(w.parts, w.length, w.count, w.head, w.last)
        done[k] = whole
    return done


def _reached(starts: list[int], uses: list[list[int]], seen: set[int]) -> list[int]:
    """Pairs that ``starts`` reach and that are not in ``seen`` yet; they are added to it."""
    out, todo = [], [i for i in starts if i not in seen]
    seen.update(todo)
    while todo:
        k = todo.pop()
        out.append(k)
        new = [j for j in uses[k] if j not in seen]
        seen.update(new)
        todo += new
    return out


def lexed_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    pairs = assignments(text)
    weights = [name_score(a.name) for a in pairs]
    if not any(weights):
        return []
    named = _constants(pairs)
    uses = [list(dict.fromkeys(j for _, j in found)) for found in named]
    out, seen = set(), set()
    for weight in sorted({w for w in weights if w}, reverse=True):  # the most sensitive name decides
        for k in _reached([i for i, w in enumerate(weights) if w == weight], uses, seen):
            constants = {n for n, _ in named[k]}
            for start, end, quoted in pairs[k].literals:
                value = text[start:end]
                if (quoted or value not in constants) and weight + literal_score(value, quoted, weight) >= SCORE_LIMIT:
                    out.add(("lexed", start, end, start, end))
    sensitive = [i for i, w in enumerate(weights) if w]
    wholes = _wholes(text, pairs, uses, sensitive)
    scoring = [i for i in sensitive if wholes[i].parts > 1 and weights[i] + wholes[i].score(weights[i]) >= SCORE_LIMIT]
    for k in _reached(scoring, uses, set()):
        out |= {("lexed", start, end, start, end) for start, end, quoted in pairs[k].literals if quoted and end > start}
    return list(out)


def find(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """All spans by start, then kind as listed, then end."""
    if not text:
        return []
    return sorted(base_spans(text) + lexed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def render(spans: list[tuple[str, int, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _, _ in spans)


def masked(text: str, spans: list[tuple[str, int, int, int, int]]) -> str:
    """The text with every secret (of an assignment: its value) replaced by one mask."""
    out, at = [], 0
    for start, end in sorted((a, b) for _, _, _, a, b in spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def _texts(column: pa.Array, step: int = 64) -> Iterator[list[str | None]]:
    for i in range(0, len(column), step):
        yield column.slice(i, step).to_pylist()


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus n_assign, n_access, n_hex, n_lexed (long), base_sha256, spans."""
    added = ["n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans"]
    names = [c for c in docs.columns if c.lower() not in (text_col.lower(), *added)]
    schema = docs.select(*names, *[F.lit(0).cast("long").alias(c) for c in added[:4]], *[F.lit("").alias(c) for c in added[4:]]).schema

    def run(batches):
        for b in batches:
            done = 0
            for texts in _texts(b.column(b.num_columns - 1)):
                found = [find(t) for t in texts]
                base = [[s for s in spans if s[0] != "lexed"] for spans in found]
                counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(render(s).encode()).hexdigest() for s in base])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(done, len(texts)) for c in b.columns[:-1]), *counts, sha, pa.array([render(s) for s in found])],
                    names=[*names, *added])
                done += len(texts)

    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text masked; texts without secrets, and null, stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            done = 0
            for texts in _texts(b.column(at)):
                part = b.slice(done, len(texts))
                clean = pa.array([masked(t, find(t)) if t else t for t in texts], pa.string())
                yield part.set_column(at, part.schema.field(at), pc.cast(clean, part.schema.field(at).type))
                done += len(texts)

    return docs.mapInArrow(run, docs.schema)

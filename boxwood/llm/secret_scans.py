"""Secret scans: patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads lines that hold an assignment sign, splits them into names,
signs, string literals, bare values and separators, and pairs names with
literals: ``name = "x"``, ``name: x``, ``"name" => 'x'``, ``export NAME=x``,
``name := x``. A type between the name and the sign (``name: str = "x"``) is
passed over, each name of a chain (``a = b = "x"``) is given the literal, and a
definition whose line ends after the sign, or after a bracket that follows it,
goes on in the next line that isn't blank. Names that are given a literal are constants of the document;
``b = a`` and ``b = a + "y"`` carry a's literals to b (later definitions
replace earlier ones, a chain is followed as it is read, and a name that isn't defined yet stands for its last definition).
Triple quotes, string prefixes (``b"x"``), ``name <- "x"`` and the first line of a block (``name: |``) are read, too.
Names also stand in subscripts (``env["name"] = "x"``), before array bounds, as
flags (``--name x``), as the first of two string arguments (``define("name", "x")``),
in setters (``setName("x")``), as labels of a ``value`` or ``default`` that follows
(``key="name" value="x"``, ``variable "name" { default = "x" }``), as elements
(``<name>x</name>``), in ``ENV name x`` and ``#define name "x"``, or directly before a string; ``a, b = "x", "y"`` is
read by place, lists give all their strings, and ``x or "y"`` both sides. The password of ``scheme://user:x@host`` counts as named so. A literal is
scored by the words of every name that it reaches and by its own look;
placeholders and plain words lose points. Spans are code points, end
exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwood.llm.common import quoted, table

#: The patterns of the query contract and the least lengths (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "value")

#: What any match of ASSIGN holds, in lower case.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of names, with the points that they give a literal.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3, "auth": 2, "bearer": 2,
    "authorization": 2, "signature": 1, "key": 1, "private": 1, "access": 1, "api": 1, "client": 1, "encryption": 1, "signing": 1,
}
#: What stands in for a secret.
PLACEHOLDERS = frozenset("changeme password passwd secret token example sample test dummy none null nil true false undefined redacted todo xxx your placeholder string str int default".split())

THRESHOLD = 5

#: Parts of names and forms that lines without a sign are read for, if they hold one of the marks, too.
_HINTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "identified")
_MARKS = re.compile(r"""["'`]|--[A-Za-z]|\b(?:ENV|ARG|define|setenv|SetEnv)\b""")
_SIGN = re.compile(r"[=:]|<-")
_SIGN_OR_HINT = re.compile(r"[=:]|<-|" + "|".join("".join(f"[{c}{c.upper()}]" for c in word) for word in _HINTS))
#: Words of declarations that a value follows without a sign, types that follow a name, schemes that stand before a credential, words between alternatives, names of values and of what names them.
_DECLARES = frozenset("ENV ARG define setenv SETENV SetEnv".split())
_TYPES = frozenset("string str String []byte byte".split())
_KEYWORDS = frozenset("const var let static final private public protected readonly export local my val".split())
_SCHEMES = frozenset("bearer basic token apikey".split())
_OR = frozenset("or else || ?? ?:".split())
_VALUES, _LABELS = frozenset("value default content val".split()), frozenset("key name id property param variable".split())
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>([^<>\n]+)</\1\s*>")
_USER = re.compile(r"""://[^\s/@:"'<>]*:([^\s/@"'<>]+)@""")
_HELD = re.compile(r"\{([A-Za-z_][\w.]*)\}")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.\-]*\Z")
#: Marks after which the lines below are the value, and triple quotes.
_BLOCK = re.compile(r"[|>][+-]?\Z")
_OPENS_BLOCK = re.compile(r":[ \t]+[|>][+-]?\s*\Z")
_TRIPLE = ('"""', "'''")
_TOKEN = re.compile(
    r"""(?P<string>(?:(?<!\w)(?:u8|[bBrRuUfFL]{1,2}|[@$]{1,2})(?=["']))?(?:"{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|\\"[^"\\\n]*\\"))
    |(?P<comment>\#|//(?!\S{0,256}[=:]))
    |(?P<sign>:=|=>|<-|\+=|\.=|\?\?=|\|\|=|\?=|[=!<>]=+|[=:])
    |(?P<plus>\+|\.\.)
    |(?P<name>(?:--?)?\$?\{?[A-Za-z_][\w.\-]*\}?)
    |(?P<bare>[*&]+(?=[A-Za-z_])|(?:\\[^\n]|[^\s"'`,;(){}\[\]\\]|\\(?=\n|\Z))+)
    |(?P<end>[,;(){}\[\]\n])""",
    re.X,
)
_OPENS_LIST = re.compile(r"""[=:][ \t]*[(\[][ \t]*[bBrRuUfF]{0,2}["'][^()\[\]]*\Z""")
_FULL = re.compile(r"\S")
_ASSIGNING = {":=", "=>", "<-", "=", ":", "+=", ".=", "??=", "||=", "?="}
#: No type is read deeper in brackets than this, so that a token is read for a few types at most; larger definitions have one string or known name for each piece.
_DEPTH, _PIECES, _CALL = 4, 8, 64
_CLOSING = {"[": "]", "(": ")", "{": "}"}
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contract's patterns; the texts of other documents cost a few searches."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # A run of [0-9a-f] is matched whole, so the long runs are those that a bounded repeat finds.
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


def name_points(name: str) -> int:
    words = [w.lower() for w in _NAME_WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    points = lambda w: SENSITIVE.get(w) or SENSITIVE.get(w.removesuffix("s"), 0)
    return max([points(w) for w in joined if points(w) >= 3] + [min(4, sum(points(w) for w in set(words)))])


def literal_points(value: str) -> int:
    """Length, mixture and entropy speak for a secret; placeholders, references and plain words against."""
    n = len(value)
    lower = value.lower()
    if n < 6 or lower.strip("<>{}[]$%*_- ") in PLACEHOLDERS or value[:1] in "<$%{" or len(set(value)) < 4:
        return -9
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    points = (n >= 8) + (n >= 20) + (classes >= 2) + (classes >= 3) + (entropy >= 3) + (entropy >= 3.8)
    if not re.search(r"[0-9]", value) and classes <= 2 and re.fullmatch(r"[A-Za-z]+[.,;:!?]*", value):
        points -= 4  # a word of prose
    if re.search(r"\s", value):
        points -= 1
    return points


def _lines(text: str, hinted: bool = False) -> Iterator[tuple[int, int]]:
    """Start and end of each line that holds an assignment sign or, if hinted, a part of a sensitive name and a mark of the forms without a sign, with the lines that it goes on in."""
    at = 0
    triple = [q for q in _TRIPLE if q in text]
    sign = _SIGN_OR_HINT if hinted else _SIGN
    while m := sign.search(text, at):
        begin = start = text.rfind("\n", at, m.start()) + 1 or at
        at = text.find("\n", m.end()) + 1 or len(text) + 1
        for q in list(triple):  # a string that is open at the line's end goes on to its closing quotes
            if text.count(q, start, at - 1) % 2:
                close = text.find(q, at - 1)
                if close < 0:
                    triple.remove(q)
                else:
                    begin, at = close, text.find("\n", close) + 1 or len(text) + 1
        if hinted and not (_SIGN.search(text, start, at - 1) or _MARKS.search(text, start, at - 1)):
            continue
        first = begin
        while at <= len(text) and (_goes_on(line := text[begin : at - 1]) or begin > first and line.rstrip().endswith(",")) and (following := _FULL.search(text, at)):
            begin, at = at, text.find("\n", following.end()) + 1 or len(text) + 1
        yield start, at - 1


def _goes_on(line: str) -> bool:
    if _OPENS_BLOCK.search(line) or _OPENS_LIST.search(line):
        return True
    line = line.rstrip()
    return (line[:-1].rstrip() if line.endswith(("(", "[", "{")) else line).endswith(("=", ":", "=>", "<-"))


Token = tuple[str, str, int, int]


def _assigns(tokens: list[Token], i: int) -> bool:
    """Whether a name (or a quoted one) and a sign stand at i."""
    return i + 1 < len(tokens) and tokens[i][0] in ("name", "string") and tokens[i + 1][0] == "sign" and tokens[i + 1][1] in _ASSIGNING


def _chained(tokens: list[Token], i: int) -> bool:
    """Whether the name at i is given the value too; 'x=y=' without a space may be a value with signs in it, unless a string follows."""
    if not _assigns(tokens, i) or tokens[i][0] != "name" or tokens[i + 1][1] not in ("=", ":=") or i + 2 >= len(tokens):
        return False
    return tokens[i + 2][0] == "string" or (tokens[i + 2][0] in ("name", "bare") and tokens[i][3] < tokens[i + 1][2])


def _past(tokens: list[Token], i: int) -> int:
    """The place after line ends, and after opening brackets or block marks that end a line, at i."""
    while i < len(tokens) and (tokens[i][1] == "\n" or ((tokens[i][1] in ("(", "[", "{") or _BLOCK.match(tokens[i][1])) and i + 1 < len(tokens) and tokens[i + 1][1] == "\n")):
        i += 1
    return i


def _typed(tokens: list[Token], i: int) -> tuple[int, bool]:
    """The place after the '=' that follows a type at i (behind 'name:'), or i if there is none; whether the type is one word (with what is in its brackets)."""
    depth, words = 0, 0
    for j in range(i, len(tokens)):
        kind, raw, start, _ = tokens[j]
        if kind == "sign" and not depth:
            return (j + 1, words == 1) if raw == "=" and words else (i, False)
        if kind == "end":
            depth += (raw in "([{") - (raw in ")]}")
            if not 0 <= depth <= _DEPTH or raw in ";\n" or (raw == "," and not depth) or (raw == "{" and not words):
                break
        elif kind not in ("name", "bare", "sign"):
            break
        else:
            words += not depth and (j == i or start > tokens[j - 1][3])
            if kind == "bare":
                depth += raw.count("<") - raw.replace("->", "").count(">")
                if not 0 <= depth <= _DEPTH:
                    break
    return i, False


def _inside(raw: str, start: int, end: int) -> tuple[int, int]:
    """The span of what stands between the quotes of a string."""
    first = next(k for k, c in enumerate(raw) if c in "\"'`")
    if raw[first : first + 3] in _TRIPLE and len(raw) - first >= 6:
        return start + first + 3, end - 3
    return start + first + 1, end - (2 if raw.startswith("\\") else 1)


def _plain(raw: str) -> str:
    """A name without its quotes, flags and marks of variables."""
    return raw.strip("\\\"'`${}-")


def _is(tokens: list[Token], i: int, *marks: str) -> bool:
    return 0 <= i < len(tokens) and tokens[i][1] in marks


def _kind(tokens: list[Token], i: int) -> str:
    return tokens[i][0] if 0 <= i < len(tokens) else ""


def _begins(tokens: list[Token], i: int) -> bool:
    """Whether a statement begins at i."""
    return i <= 0 or tokens[i - 1][1] in ("\n", ";", "{") or tokens[i - 1][0] == "comment" or tokens[i - 1][1] in _KEYWORDS


def _placed(tokens: list[Token], i: int) -> tuple[str, int] | None:
    """Name and place after the sign, where the name stands before brackets or in them: ``["name"] =``, ``name[] =``, ``name by lazy {``."""
    signed = lambda k: _kind(tokens, k) == "sign" and tokens[k][1] in _ASSIGNING
    if _is(tokens, i, "[") and _kind(tokens, i + 1) == "string" and _is(tokens, i + 2, "]") and signed(i + 3):
        return tokens[i + 1][1], i + 4
    if _kind(tokens, i) != "name":
        return None
    if _is(tokens, i + 1, "["):
        close = i + 2 if _is(tokens, i + 2, "]") else i + 3
        if _is(tokens, close, "]") and _kind(tokens, i + 2) != "string" and signed(close + 1):
            return tokens[i][1], close + 2
    if _is(tokens, i + 1, "by") and _is(tokens, i + 2, "lazy") and _is(tokens, i + 3, "{"):
        return tokens[i][1], i + 4
    return None


def _unsigned(tokens: list[Token], i: int) -> tuple[str, int] | None:
    """Name and place of its value, for forms without a sign."""
    kind, raw = tokens[i][:2]
    following = _kind(tokens, i + 1)
    if kind == "string":
        own = _plain(raw)
        if _is(tokens, i + 1, ",") and _kind(tokens, i + 2) == "string" and _is(tokens, i - 1, "(", "{", "[") and _IDENTIFIER.match(own) and name_points(own) >= 2:
            return own, i + 2
        return None
    if kind != "name":
        return None
    if raw in _DECLARES and _begins(tokens, i) and following == "name" and _kind(tokens, i + 2) in ("string", "name", "bare"):
        return tokens[i + 1][1], i + 2
    if raw.startswith("--") and following in ("string", "name", "bare") and not tokens[i + 1][1].startswith("-") and tokens[i + 1][2] > tokens[i][3]:
        return raw, i + 1
    if following == "string" and not _assigns(tokens, i + 1):
        if name_points(raw) >= 3 or raw.lower() == "by" and i and tokens[i - 1][1].lower() == "identified":
            return raw if raw.lower() != "by" else "password", i + 1
    if _is(tokens, i + 1, "(") and _kind(tokens, i + 2) == "string" and _is(tokens, i + 3, ")"):
        own = raw.rpartition(".")[2]
        words = [w.lower() for w in _NAME_WORDS.findall(own)]
        if words[:1] in (["set"], ["with"]) or words and "." in raw and all(w in SENSITIVE for w in words):
            return own, i + 2
    return None


@dataclass
class Definition:
    """A name with what it is given: spans of literals, in runs that plus signs join, definitions that it uses, and names that may be defined further on."""

    name: str
    spans: list[tuple[int, int]]
    uses: list[Definition]
    points: int = 0
    runs: list[list[tuple[int, int] | Definition]] = field(default_factory=list)
    later: list[str] = field(default_factory=list)


def _value(tokens: list[Token], i: int, known: dict[str, Definition], made: Definition) -> int:
    """Give made the literals and the known names at i, joined by plus signs or standing side by side, and the alternatives behind ``or``; of a list, all its strings. The place after them."""
    closing = None
    if _is(tokens, i, "[", "(", "{") and _kind(tokens, i + 1) == "string" and not _assigns(tokens, i + 1):
        closing, i = _CLOSING[tokens[i][1]], i + 1
    elif _is(tokens, i - 1, "\n"):
        back = i - 1
        while _is(tokens, back, "\n"):
            back -= 1
        closing = _CLOSING.get(tokens[back][1]) if back >= 0 else None
    run: list = []
    while i < len(tokens):
        kind, raw, start, end = tokens[i]
        if kind == "string":
            if _assigns(tokens, i) and (made.spans or made.uses):
                break
            span = _inside(raw, start, end)
            made.spans.append(span)
            run.append(span)
            if "{" in raw:
                made.uses += [known[x] for x in _HELD.findall(raw) if x in known]
        elif kind == "name" and (_plain(raw) in known):
            made.uses.append(known[_plain(raw)])
            run.append(known[_plain(raw)])
        elif kind == "name" and raw.lower() in _SCHEMES and _kind(tokens, i + 1) in ("name", "bare") and tokens[i + 1][2] > end:
            i += 1
            continue
        elif kind in ("bare", "name"):
            last = end  # a bare value goes on up to a space or a separator
            while i + 1 < len(tokens) and tokens[i + 1][2] == last and tokens[i + 1][0] not in ("end", "string"):
                i += 1
                last = tokens[i][3]
            if _is(tokens, i + 1, "(") and tokens[i + 1][2] == last:  # a call's result is unknown, but not what stands in for it
                close = next((k for k in range(i + 2, min(len(tokens), i + _CALL)) if tokens[k][1] in (")", "\n", "(")), i)
                if not (_is(tokens, close, ")") and _is(tokens, close + 1, *_OR)):
                    break
                i, run = close + 2, []
                continue
            made.spans.append((start, last))
            run.append((start, last))
            if kind == "name" and last == end:
                made.later.append(_plain(raw))
        else:
            break
        i += 1
        if _kind(tokens, i) == "plus":
            i += 1
        elif _is(tokens, i, *_OR) or closing and _is(tokens, i, ","):
            made.runs.append(run)
            run = []
            i += 1
        elif not (_kind(tokens, i) == kind == "string" and not _assigns(tokens, i)):
            if not (closing and _is(tokens, i, "\n")):
                break
        while closing and _is(tokens, i, "\n"):
            i += 1
        if closing and (_is(tokens, i, closing) or _assigns(tokens, i)):
            break
    made.runs.append(run)
    return i


def _together(tokens: list[Token], i: int) -> list[str]:
    """The names of ``a, b =`` whose last one stands at i, if a statement begins with them."""
    first = i
    while first >= 2 and tokens[first - 1][1] == "," and tokens[first - 2][0] == "name":
        first -= 2
    return [tokens[k][1] for k in range(first, i + 1, 2)] if first < i and _begins(tokens, first) else []


def assignments(text: str, hinted: bool = False) -> list[Definition]:
    """The definitions in reading order; a name that is used stands for its last definition so far, or, if there is none, for the last one of the text."""
    known: dict[str, Definition] = {}
    out: list[Definition] = []
    label = ""  # what a value or default that follows is the value of

    def add(own: Definition) -> None:
        nonlocal label
        if own.name in _VALUES and label:
            own.name, label = label, ""
        elif own.name in _LABELS and len(own.spans) == 1 and not own.uses and _IDENTIFIER.match(held := text[slice(*own.spans[0])]):
            label = held
        elif own.name not in ("type", "description"):
            label = ""
        if own.name:
            known[own.name] = own
        out.append(own)

    for first, last in _lines(text, hinted):
        tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, first, last)]
        i = 0
        while i + 1 < len(tokens):
            if not _assigns(tokens, i):
                found = _placed(tokens, i) or _unsigned(tokens, i)
                if found is None:
                    if tokens[i][0] == "name" and tokens[i + 1][0] == "string" and _is(tokens, i + 2, "{"):
                        label = _plain(tokens[i + 1][1])
                    i += 1
                    continue
                made = Definition(_plain(found[0]), [], [])
                on = _past(tokens, found[1])
                i = max(i + 1, _value(tokens, on, known, made))
                if made.spans or made.uses:
                    add(made)
                continue
            names, also = [tokens[i][1]], None
            if tokens[i][1] in _TYPES and i and tokens[i - 1][0] == "name" and tokens[i - 1][1] not in _KEYWORDS:
                names = [tokens[i - 1][1]]  # the type stands behind the name
            group = _together(tokens, i) if tokens[i + 1][1] in ("=", ":=") and tokens[i][0] == "name" else []
            colon = tokens[i + 1][1] == ":"
            i += 2
            if group:
                parts, at = [], i
                for name in group:
                    parts.append(Definition(_plain(name), [], []))
                    at = _value(tokens, at, known, parts[-1])
                    if not (parts[-1].spans or parts[-1].uses) or not _is(tokens, at, ","):
                        break
                    at += 1
                if len(parts) == len(group) and (parts[-1].spans or parts[-1].uses):
                    i = at
                    for own in parts:
                        add(own)
                    continue
            if colon:
                behind, one = _typed(tokens, i)
                if one:
                    i = behind
                elif behind > i:
                    also = behind  # a type of several words, or a value before another definition: both are read
            while _chained(tokens, i):
                names.append(tokens[i][1])
                i += 2
            on = _past(tokens, i)
            if on > i and _assigns(tokens, on):
                i = on  # nothing is given here: the next line has a definition of its own
                continue
            made = Definition(_plain(names.pop()), [], [])
            i = _value(tokens, on, known, made)
            if also is not None:
                _value(tokens, _past(tokens, also), known, made)
            if not (made.spans or made.uses):
                continue
            # The names before the last of a chain use its definition.
            for own in (made, *(Definition(_plain(x), [], [made]) for x in reversed(names))):
                if own.name or own is made and names:
                    add(own)
    for made in out:
        made.uses += [known[x] for x in made.later if x in known]
    return out


def _pieces(run: list) -> list[tuple[int, int]]:
    """The spans of a run; of a definition that it uses, its own ones, if they are few."""
    return [x for item in run for x in ([item] if isinstance(item, tuple) else item.spans if len(item.spans) <= _PIECES else [])]


def value_spans(text: str, threshold: int = THRESHOLD) -> list[tuple[int, int, str]]:
    """Literals whose best name and own look reach the threshold together; a name alone or a look alone does not. Literals that plus signs join are also looked at as one.

    Points go from a definition to those that it uses, last definition first;
    where a name is defined after its use, they go on until none changes. They only
    rise, by a few steps, so the work grows with the text, however names are chained or doubled.
    """
    lower = text.lower()
    hinted = any(x in lower for x in _HINTS)
    if not hinted and "=" not in text and ":" not in text and "<-" not in text:
        return []
    found = set()
    made_all = assignments(text, hinted)
    for made in reversed(made_all):
        made.points = max(made.points, name_points(made.name))
        for used in made.uses:
            used.points = max(used.points, made.points)
    rising = [made for made in made_all if any(used.points < made.points for used in made.uses)]
    while rising:
        made = rising.pop()
        for used in made.uses:
            if used.points < made.points:
                used.points = made.points
                rising.append(used)
    for made in made_all:
        if made.points >= 2:
            for run in made.runs:
                pieces = _pieces(run)
                whole = len(run) > 1 and made.points + literal_points("".join(text[a:b] for a, b in pieces)) >= threshold
                found |= {(a, b, "value") for a, b in (pieces if whole else [x for x in run if isinstance(x, tuple)]) if b > a and (whole or made.points + literal_points(text[a:b]) >= threshold)}
    given = [(m[1], m.span(2)) for m in _ELEMENT.finditer(text)] if hinted and "</" in text else []
    given += [("password", m.span(1)) for m in _USER.finditer(text)] if "://" in text and "@" in text else []
    found |= {(a, b, "value") for name, (a, b) in given if (points := name_points(name)) >= 2 and points + literal_points(text[a:b]) >= threshold}
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all): all holds the base spans and the literals that lie inside none of them, by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    starts, furthest = [s[0] for s in base], [0, *accumulate((s[1] for s in base), max)]
    more = [s for s in value_spans(text) if furthest[bisect_right(starts, s[0])] < s[1]]
    return base, sorted(base + more, key=order)


def redact(text: str, found: list[tuple[int, int, str]] | None = None, mark: str = "[secret]") -> str:
    """text with every span (found: those of all_spans, if known) replaced; spans that touch or overlap become one mark, and of an assign span the name and sign stay."""
    spans = []
    for a, b, kind in all_spans(text)[1] if found is None else found:
        if kind == "assign":
            a = ASSIGN.match(text, a).start(2)
        spans.append((a, b))
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """A row for each row of df: id, the columns also, spans array<struct<start,end,kind>> and, if with_text, the redacted text.

    A null text is scanned as an empty one (no spans) and stays null in
    ``redacted``; a very long one is scanned whole. Repeated rows stay. Columns
    may have any names; those that are neither given nor in also are not read.
    An empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for text in batch.column(0).to_pylist():
                found = all_spans(text or "")[1]
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                if with_text:
                    clean.append(redact(text, found) if found else text)
            columns = [*batch.columns[1:], pa.array(spans, span)] + [pa.array(clean, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "spans"] + ["redacted"] * with_text)

    held = df.select(F.col(quoted(text_col)).alias("_text"), *map(quoted, (id_col, *also)))
    found = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    return held.mapInArrow(scan, T.StructType([*held.schema.fields[1:], T.StructField("spans", found), *[T.StructField("redacted", T.StringType())] * with_text]))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), with_text=False)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    base = F.filter("spans", lambda s: s.kind != "value")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

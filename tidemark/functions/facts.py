"""Facts of one source text, found by regular expressions over the kinds of its tokens.

Every rule starts at a keyword and takes the tokens that belong to it; what a rule takes is not looked
at again. The results are those of a plain token scan, its known oddities included (``static`` for any
``X::``, comments that end an import, enums that declare nothing).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tidemark.functions.tokens import Token, kinds, tokenize

_NAMES = "nbqQ"
# Names of classes that depend on where they stand.
PSEUDO = ("self", "static", "parent")
#: What each keyword takes: its tokens, then the one that ends it.
_TAKES = {
    "N": re.compile(r"N(?:[nbqw]|[^a-zA-Z;{])*+.?"),
    "U": re.compile(r"U(?:[nbqQwFK]|A[^n]*+n|A[^n]*+$|[^a-zA-Z;])*+.?"),
    "u": re.compile(r"U(?:[nbqQw]|[^a-zA-Z;{])*+.?"),  # within a class
    "C": re.compile(r"[CIT][a-mo-zA-Z]*+.?"),
    "X": re.compile(r"X(?:[nbqQw]|[^a-zA-Z{])*+(?:(?=M)|.?)"),
    "M": re.compile(r"M(?:[nbqQw]|[^a-zA-Z{])*+.?"),
    "W": re.compile(r"W(?:[nbqQw]|[^a-zA-Z(])*+.?"),
    "i": re.compile(r"i(?:w|[^a-zA-Z;])*+(?P<literal>E?)[^;]*+;?"),
}
_TAKES["I"] = _TAKES["T"] = _TAKES["C"]
_STARTS = re.compile("[NUCITXMWiDv]")
_IDENTIFIER = re.compile("[^nXMUFC]*+n")
_PLAIN_VARIABLE = re.compile(r"\$[A-Za-z_]")


def _pieces(tokens: list[Token], code: str, start: int, end: int, marks: str) -> Iterator[tuple[str, str]]:
    """Names between ``start`` and ``end``, joined without blanks, each with the mark that ends it ('' at the end)."""
    name, k = "", start
    while k < end:
        if code[k] in marks:
            yield name, code[k]
            name = ""
        elif code[k] == "A":  # an alias is not part of a name
            k = code.find("n", k) if "n" in code[k:end] else end
        elif code[k] in _NAMES:
            name += tokens[k].text
        k += 1
    yield name, ""


def _imports(tokens: list[Token], code: str, start: int, end: int) -> Iterator[str]:
    prefix = None
    for name, mark in _pieces(tokens, code, start, end, ",;{}"):
        if mark == "{":
            prefix = name
        elif name and (mark in (",", ";") or (mark == "}" and prefix)):
            yield (f"{prefix.strip(chr(92))}\\{name.strip(chr(92))}" if prefix else name).lstrip("\\")
        if mark == "}":
            prefix = None


class _Scopes:
    """Whether a ``use`` stands in a class: the nearest enclosing class or trait, unless a namespace of the same depth comes first."""

    def __init__(self, code: str):
        self.marks, depth = [], 0
        self.depth_at = {}
        for m in re.finditer("[{}CTNU]", code):
            if m[0] == "U":
                self.depth_at[m.start()] = (depth, len(self.marks))
            elif m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
            else:
                self.marks.append((m[0], depth))

    def in_class(self, at: int) -> bool:
        depth, n = self.depth_at[at]
        for kind, d in reversed(self.marks[:n]):
            if kind == "N":
                if d == depth:
                    return False
            elif d < depth:
                return True
        return False


def _previous(tokens: list[Token], code: str, at: int) -> str:
    """The name that ends just before ``at``."""
    name, k = "", at - 1
    while k >= 0 and code[k] in _NAMES + "w":
        if code[k] != "w":
            name = tokens[k].text + name
        k -= 1
    return name


def facts(source: str) -> list[tuple[str, str]]:
    """(kind, name), each once, in the order found: use, declared, extends, implements, trait, new, static, var, include."""
    tokens = tokenize(source)
    code = kinds(tokens)
    scopes = _Scopes(code)
    found: dict[tuple[str, str], None] = {}
    space: str | None = None

    def full(name: str) -> str:
        if name.startswith("\\"):
            return name.lstrip("\\")
        return f"{space}\\{name}" if "\\" in name and space is not None else name

    at = 0
    while m := _STARTS.search(code, at):
        key, begin = m[0], m.start()
        at = begin + 1
        if key == "v":
            if _PLAIN_VARIABLE.match(tokens[begin].text):
                found["var", tokens[begin].text] = None
            continue
        if key == "D":
            name = _previous(tokens, code, begin)
            if name and name not in PSEUDO:
                found["static", full(name)] = None
            continue
        in_class = key == "U" and scopes.in_class(begin)
        taken = _TAKES["u" if in_class else key].match(code, begin)
        end = at = taken.end()
        if key == "N":
            space = "".join(t.text for t in tokens[begin + 1 : end] if t.kind in "nbq").strip("\\")
        elif in_class:
            for name, mark in _pieces(tokens, code, begin + 1, end, ",;{"):
                if name and mark:
                    found["trait", full(name)] = None
        elif key == "U":
            found.update(dict.fromkeys(("use", name) for name in _imports(tokens, code, begin + 1, end)))
        elif key in "CIT":
            if code[end - 1] == "n":
                found["declared", tokens[end - 1].text if space is None else f"{space}\\{tokens[end - 1].text}"] = None
        elif key in "XM":
            for name, _ in _pieces(tokens, code, begin + 1, end, ",{"):
                if name:
                    found["extends" if key == "X" else "implements", full(name)] = None
        elif key == "W":
            name = "".join(t.text for t in tokens[begin + 1 : end] if t.kind in _NAMES)
            if name and name not in PSEUDO:
                found["new", full(name)] = None
        elif taken["literal"]:
            found["include", tokens[taken.start("literal")].text.strip("'\"")] = None
    return list(found)


# ---- calls ----

_CALL_USE = re.compile(r"U(?:A.?|[^;A])*+;?")
_CALL_EVENTS = re.compile("[{}NUCITFDO]")
_MEMBER = re.compile("(?:w|[^a-zA-Z])*+n")


def _identifier(tokens: list[Token], code: str, after: int) -> str | None:
    m = _IDENTIFIER.match(code, after)
    return tokens[m.end() - 1].text if m else None


def _before(tokens: list[Token], code: str, at: int, wanted: str) -> str | None:
    """The text of the token before ``at``, blanks and punctuation not counted, if it is of a wanted kind."""
    k = at - 1
    while k >= 0 and (code[k] == "w" or not code[k].isalpha()):
        k -= 1
    return tokens[k].text if k >= 0 and code[k] in wanted else None


def calls(source: str) -> list[tuple[str, str]]:
    """(caller, callee) of each use of a member within a method, repeats included.

    Members of ``$this`` and of named classes get a class; those of other variables stay ``$v->m``.
    Imports count outside of braces only; an alias is also taken as part of the name it stands for.
    """
    tokens = tokenize(source)
    code = kinds(tokens)
    out: list[tuple[str, str]] = []
    space = owner = method = opened = None
    aliases: dict[str, str] = {}
    depth = at = 0

    def member_of(class_: str, name: str) -> str:
        return f"{class_}::{name}" if space is None else f"{space}\\{class_}::{name}"

    def resolved(name: str) -> str:
        head, sep, rest = name.partition("\\")
        if name in aliases:
            return aliases[name]
        if sep and head in aliases:
            return f"{aliases[head]}\\{rest}"
        return name if space is None else f"{space}\\{name}"

    while m := _CALL_EVENTS.search(code, at):
        key, here = m[0], m.start()
        at = here + 1
        if key == "{":
            depth += 1
            if method and opened is None:
                opened = depth
        elif key == "}":
            if depth == opened:
                method = opened = None
            depth -= 1
        elif key == "N":
            at = _TAKES["N"].match(code, here).end()
            space = "".join(t.text for t in tokens[here + 1 : at] if t.kind in "nbq").strip("\\")
        elif key == "U" and depth <= 0:
            at = _CALL_USE.match(code, here).end()
            marks = [k for k in range(here, at) if code[k] == "A"]
            name = "".join(tokens[k].text for k in range(here + 1, at) if code[k] in "nbq" and k - 1 not in marks)
            alias = _identifier(tokens, code, marks[-1] + 2) if marks else None
            if name and code[at - 1] == ";":
                aliases[alias or name.rpartition("\\")[2]] = name.lstrip("\\")
        elif key in "CIT":
            owner = _identifier(tokens, code, at)
        elif key == "F":
            name = _identifier(tokens, code, at)
            if name and owner:
                method, opened = member_of(owner, name), None
        elif key in "DO" and method and (hit := _MEMBER.match(code, at)):
            name = tokens[hit.end() - 1].text
            if key == "D":
                class_ = _before(tokens, code, here, "nq")
                if class_:
                    out.append((method, f"{resolved(class_)}::{name}"))
            else:
                variable = _before(tokens, code, here, "v")
                out.append((method, member_of(owner, name) if variable == "$this" and owner else f"{variable or ''}->{name}"))
    return out


# ---- lines ----


def method_lines(source: str) -> list[tuple[int, str]]:
    """(line, method) for each line on which a token of a method starts; punctuation alone marks no line, and the last token of a line decides.

    Methods have the short name of their class. Braces are counted anew from each ``function``.
    """
    tokens = tokenize(source)
    code = kinds(tokens)
    lines: dict[int, str] = {}
    owner = method = None
    depth = 0
    for k, (kind, _, line) in enumerate(tokens):
        if not kind.isalpha():
            depth += (kind == "{") - (kind == "}")
            if kind == "}" and depth == 0:
                method = None
            continue
        if kind in "CIT":
            owner = _identifier(tokens, code, k + 1)
        elif kind == "F" and (name := _identifier(tokens, code, k + 1)):
            method, depth = f"{owner}::{name}" if owner is not None else name, 0
        if method:
            lines[line] = method
    return sorted(lines.items())

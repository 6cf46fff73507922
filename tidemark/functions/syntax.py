"""Facts as a syntax tree gives them: only real static calls, receivers of method calls, blocks by their braces.

No tree is built. With blanks and comments gone each construct is a short pattern over token kinds, and
one pass with a stack of blocks tells imports from trait uses. A text whose brackets do not match has no
facts; other errors of syntax are not found. Relative names (``namespace\\X``) are not taken.
"""

from __future__ import annotations

import re

from tidemark.functions.tokens import EMBED, Token, kinds, tokenize

_NAME = "[nqQ]"
_EVENT = re.compile(
    rf"""(?P<space>N(?P<space_name>[nq]?)(?=[;{{]))
|(?P<uses>U(?!\()(?:[FK,{{}}bnqQ]|An)*;)
|(?P<traits>U(?!\()(?:{_NAME},?)+)
|(?P<header>(?<!D)[CIT](?P<class_>n?)|(?P<enum>z)(?=n))
|(?P<parents>[XM](?:{_NAME},?)+)
|(?P<made>W(?:{_NAME}|z))
|(?P<static>(?:{_NAME}|z)D[a-zA-Z]\()
|(?P<member>(?<![D$])vO[a-zA-Z]\()
|(?P<include>i\(*E\)*(?=[;,)\]}}]|z|$))
|(?P<open>[{{y])|(?P<close>\}})
""",
    re.X,
)
_CLOSES = {"}": "{y", ")": "(", "]": "["}


def _balanced(tokens: list[Token]) -> bool:
    stack = []
    for t in tokens:
        if t.kind in "{y([":
            stack.append(t.kind)
        elif t.text == "#[":
            stack.append("[")
        elif t.kind in _CLOSES and (not stack or stack.pop() not in _CLOSES[t.kind]):
            return False
    return not stack


def _imported(tokens: list[Token]) -> list[str]:
    """Names of an import: a plain list, or what the braces of a group hold behind their prefix."""
    names, prefix = [], ""
    for k, t in enumerate(tokens):
        if t.kind in "nqQ" and tokens[k - 1].kind != "A":
            following = tokens[k + 1].kind if k + 1 < len(tokens) else ""
            if following == "b":
                prefix = t.text.lstrip("\\") + "\\"
            else:
                names.append(prefix + t.text.lstrip("\\"))
    return names


def facts(source: str) -> list[tuple[str, str]]:
    """(kind, name), each once: use, declared, extends, implements, trait, new, static, var (receivers, without ``$``), include."""
    tokens = [t for t in tokenize(source) if t.kind not in "wc"]
    if not _balanced(tokens):
        return []
    code = kinds(tokens)
    found: dict[tuple[str, str], None] = {}
    space: str | None = None
    blocks: list[str] = []
    header = ""

    def full(t: Token) -> str:
        if t.kind == "Q":
            return t.text.lstrip("\\")
        return f"{space}\\{t.text}" if t.kind == "q" and space is not None else t.text

    at = 0
    while m := _EVENT.search(code, at):
        group, begin, at = m.lastgroup, m.start(), max(m.end(), m.start() + 1)
        taken = tokens[begin : m.end()]
        in_class = bool(blocks) and blocks[-1] == "class"
        if m["space"]:
            space = taken[1].text if m["space_name"] else None
        elif code[begin] == "U" and in_class:
            at = begin + 1
            while code[at] in "nqQ,":
                if code[at] != ",":
                    found["trait", full(tokens[at])] = None
                at += 1
        elif m["uses"]:
            found.update(dict.fromkeys(("use", name) for name in _imported(taken)))
        elif m["header"]:
            if m["enum"] and taken[0].text.lower() != "enum":
                at = begin + 1
                continue
            header = "enum" if m["enum"] else code[begin]
            if m["class_"]:
                name = taken[-1].text
                found["declared", name if space is None else f"{space}\\{name}"] = None
        elif m["parents"] and header in ("C", "I"):
            kind = "extends" if code[begin] == "X" else "implements"
            found.update(dict.fromkeys((kind, full(t)) for t in taken if t.kind in "nqQ"))
        elif m["made"]:
            if taken[1].kind != "z" or taken[1].text.lower() == "static":
                found["new", full(taken[1])] = None
                at = begin + 1
        elif m["static"]:
            if taken[0].kind != "z" or taken[0].text.lower() == "static":
                found["static", full(taken[0])] = None
        elif m["member"]:
            found["var", taken[0].text[1:]] = None
        elif m["include"]:
            after = tokens[at] if at < len(tokens) else None
            literal = next(t.text for t in taken if t.kind == "E")
            if after is None or after.kind != "z" or after.text.startswith("?>"):
                found["include", re.sub(r"\\([\\'])", r"\1", literal[1:-1]) if literal[0] == "'" else literal.strip('bB"')] = None
        elif group == "open":
            blocks.append("class" if header and code[begin] != EMBED else "other")
            header = ""
        elif group == "close":
            blocks.pop()
    return list(found)

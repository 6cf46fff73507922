"""A tokenizer for PHP source: each token gets a one-letter kind, so that grammar can be regular expressions over kinds.

Letters stand for tokens of the language with a name; any other character is a single punctuation
mark. ``code`` of a token list is the string of all kinds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

# Kinds of the tokens that extraction looks at; all other named tokens are OTHER.
BLANK, COMMENT, NAME, QUALIFIED, ABSOLUTE, SEPARATOR, VARIABLE, STRING, EMBED, OTHER = "w", "c", "n", "q", "Q", "b", "v", "E", "y", "z"
KEYWORDS = {"namespace": "N", "use": "U", "class": "C", "interface": "I", "trait": "T", "extends": "X", "implements": "M", "new": "W", "include": "i", "include_once": "i", "require": "i", "require_once": "i", "as": "A", "function": "F", "const": "K"}
STATIC_OP, MEMBER_OP = "D", "O"
# Words of the language that are no names.
RESERVED = frozenset(
    "abstract and array break callable case catch clone continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit final finally fn for foreach global goto if instanceof insteadof isset list match or print private protected public readonly return static switch throw try unset var while xor yield __halt_compiler __class__ __dir__ __file__ __function__ __line__ __method__ __namespace__ __trait__ __property__".split()
)
# Operators of more than one character, longest first.
OPERATORS = ("<=>", "**=", "...", "<<=", ">>=", "===", "!==", "??=", "?->", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "++", "--", "+=", "-=", "*=", "/=", "%=", ".=", "&=", "|=", "^=", "**", "<<", ">>", "=>", "&")

_WORD = r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff]*"
_SCRIPT = re.compile(
    rf"""(?P<blank>[ \t\r\n]+)
|(?P<attribute>\#\[)
|(?P<comment>/\*(?:.*?\*/|.*)|(?:\#|//)(?:(?!\?>)[^\r\n])*)
|(?P<close>\?>\r?\n?)
|(?P<heredoc>[bB]?<<<[ \t]*(?:'(?P<raw>{_WORD})'|"(?P<quoted>{_WORD})"|(?P<bare>{_WORD}))\r?\n)
|(?P<single>[bB]?'(?:[^'\\]|\\.)*(?:'|\Z))
|(?P<double>[bB]?"(?:[^"\\$\{{]|\\.|\$(?![A-Za-z_\x80-\U0010ffff\{{])|\{{(?!\$))*")
|(?P<quote>[bB]?"|`)
|(?P<variable>\${_WORD})
|(?P<absolute>\\{_WORD}(?:\\{_WORD})*)
|(?P<word>{_WORD}(?:\\{_WORD})*)
|(?P<separator>\\)
|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*\.?(?:[eE][+-]?[0-9]+)?)
|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)[ \t]*\))
|(?P<static>::)
|(?P<member>->)
|(?P<operator>{"|".join(re.escape(o) for o in OPERATORS)})
|(?P<mark>.)""",
    re.S | re.X | re.I,
)
_OPEN = re.compile(r"<\?(?:php(?=[ \t\r\n]|\Z)(?:[ \t]|\r?\n)?|=)", re.I)
#: Within quotes: plain text, a variable with one member or index, or the start of an embedded expression.
_INSIDE = re.compile(rf"(?P<variable>\${_WORD})(?:(?P<member>\??->)(?P<name>{_WORD})|(?P<index>\[)(?P<key>[^\]]*)(?P<shut>\]))?|(?P<curly>\{{(?=\$)|\$\{{)|(?P<text>(?:[^\\$\{{]|\\.|\$(?![A-Za-z_\x80-\U0010ffff\{{])|\{{(?!\$))+)", re.S)
_VARNAME = re.compile(rf"{_WORD}(?=[\[}}])")
_UP_TO = {quote: re.compile(rf"(?:[^\\{quote}]|\\.)*+", re.S) for quote in '"`'}
_LINE_WORD = re.compile(rf"^[ \t]*({_WORD})", re.M)
_KIND_OF = {"blank": BLANK, "comment": COMMENT, "single": STRING, "double": STRING, "variable": VARIABLE, "absolute": ABSOLUTE, "separator": SEPARATOR, "static": STATIC_OP, "member": MEMBER_OP}
_ENUM = re.compile(rf"[ \t\r\n]+(?!(?:extends|implements)\b){_WORD}", re.I)


class Token(NamedTuple):
    kind: str
    text: str
    line: int


class _Lexer:
    """Modes that hold one another (script, quoted text, heredoc) are generators that yield the mode within, so nesting needs no recursion."""

    def __init__(self, source: str):
        self.source, self.at, self.line, self.out = source, 0, 1, []
        self.starts: dict[str, list[int]] | None = None  # where lines begin with a word, by word

    def put(self, kind: str, text: str) -> None:
        self.out.append(Token(kind, text, self.line))
        self.line += text.count("\n")
        self.at += len(text)

    def run(self) -> list[Token]:
        while self.at < len(self.source):
            m = _OPEN.search(self.source, self.at)
            if (m.start() if m else len(self.source)) > self.at:
                self.put(OTHER, self.source[self.at : m.start() if m else None])
            if m:
                self.put(OTHER, m[0])
                modes = [self.script(None)]
                while modes:
                    inner = next(modes[-1], None)
                    if inner is None:
                        modes.pop()
                    else:
                        modes.append(inner)
        return self.out

    def script(self, until: str | None) -> Iterator:
        """Tokens up to a closing tag, or up to the brace that ends an embedded expression."""
        depth, member = 0, False
        while self.at < len(self.source):
            m = _SCRIPT.match(self.source, self.at)
            group, text = m.lastgroup, m[0]
            if group in ("raw", "quoted", "bare"):
                group = "heredoc"
            was_member, member = member, group == "member" or text == "?->" or (member and group in ("blank", "comment"))
            if group == "word":
                self.word(text, was_member)
            elif group == "heredoc":
                yield self.heredoc(m)
            elif group == "quote":
                self.put(text[-1], text)
                yield self.inside(None, text[-1])
            elif group == "close":
                self.put(OTHER, text)
                if until is None:
                    return
            elif group == "mark":
                self.put(text if text.isascii() and not text.isalnum() else OTHER, text)
                depth += (text == "{") - (text == "}")
                if until and depth < 0:
                    return
            else:
                self.put(_KIND_OF.get(group, OTHER), text)

    def word(self, text: str, member: bool) -> None:
        head, _, rest = text.partition("\\")
        low = text.lower()
        if rest:
            if member:  # only the first name belongs to the member
                self.put(NAME, head)
            else:
                self.put(OTHER if head.lower() == "namespace" else QUALIFIED, text)
        elif member:
            self.put(NAME, text)
        elif low == "enum":
            self.put(OTHER if _ENUM.match(self.source, self.at + 4) else NAME, text)
        else:
            self.put(KEYWORDS.get(low) or (OTHER if low in RESERVED else NAME), text)

    def heredoc(self, m: re.Match) -> Iterator:
        label = m["raw"] or m["quoted"] or m["bare"]
        self.put(OTHER, m[0])
        if self.starts is None:
            self.starts = {}
            for start in _LINE_WORD.finditer(self.source):
                self.starts.setdefault(start[1], []).append(start.start())
        places = self.starts.get(label, ())
        k = bisect_left(places, self.at)
        stop = places[k] if k < len(places) else len(self.source)
        if m["raw"]:
            if stop > self.at:
                self.put(OTHER, self.source[self.at : stop])
        else:
            yield self.inside(stop, None)
        if k < len(places) and self.at == stop:
            self.put(OTHER, _LINE_WORD.match(self.source, stop)[0])

    def inside(self, stop: int | None, end: str | None) -> Iterator:
        """Text with variables in it, up to ``stop`` or to the quote ``end``."""
        quote = -1  # where the quote is, if it is ahead; an expression may hold the one that was found before it
        while self.at < len(self.source) and (self.at < stop if end is None else self.source[self.at] != end):
            if end and quote < self.at:
                quote = _UP_TO[end].match(self.source, self.at).end()
            m = _INSIDE.match(self.source, self.at, max(stop if end is None else quote, self.at + 1))
            if not m:
                self.put(OTHER, self.source[self.at])
            elif m["text"]:
                self.put(OTHER, m["text"])
            elif m["curly"]:
                self.put(EMBED, m["curly"])
                if m["curly"] == "${" and (named := _VARNAME.match(self.source, self.at)):
                    self.put(OTHER, named[0])
                yield self.script("}")
            else:
                self.put(VARIABLE, m["variable"])
                if m["member"]:
                    self.put(MEMBER_OP if m["member"] == "->" else OTHER, m["member"])
                    self.put(NAME, m["name"])
                elif m["index"]:
                    self.put("[", "[")
                    if m["key"]:
                        self.put(VARIABLE if m["key"].startswith("$") else NAME if re.fullmatch(_WORD, m["key"]) else OTHER, m["key"])
                    self.put("]", "]")
        if end and self.at < len(self.source):
            self.put(end, end)


def tokenize(source: str) -> list[Token]:
    return _Lexer(source).run()


def kinds(tokens: list[Token]) -> str:
    return "".join(t.kind for t in tokens)

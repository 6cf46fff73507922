"""Globs, ignore rules and delimited regular expressions, compiled to Java patterns on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Patterns that ask for a full run when nothing is configured.
DEFAULT_FULL_SCAN = ("composer.json", "composer.lock")
#: Java's own metacharacters; each is written with a backslash.
_META = set("\\^$.|?*+()[]{}-#&~")


def _literal(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def _wild(glob: str, one: str) -> str:
    """``**`` is anything, ``*`` anything within a segment, ``?`` is ``one``."""
    steps = {"**": ".*", "*": "[^/]*", "?": one}
    return "".join(steps[part] if part in steps else _literal(part) for part in re.split(r"(\*\*|\*|\?)", glob))


def glob_regex(glob: str) -> str:
    """Matches a path, or its end after a slash."""
    return f"(?:^|/){_wild(glob, '.')}$"


@dataclass(frozen=True)
class IgnoreRule:
    ord: int
    regex: str
    negated: bool


def ignore_rules(lines: list[str]) -> list[IgnoreRule]:
    """Rules of an ignore file. A rule is open on the right unless it ends in a slash; ``/x`` keeps its slash
    after the start or another slash, and so does not match at the root (compatible, not as git does it)."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        directory = body.endswith("/")
        body = body.rstrip("/") if directory else body
        out.append(IgnoreRule(len(out), f"(?:^|/){_wild(body, '.')}" + ("(?:/|$)" if directory else "(?:/|$)?"), negated))
    return out


_FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x", "u": "u"}


def delimited_regex(pattern: str) -> str | None:
    """``/.../flags`` or ``#...#flags`` as a Java pattern; None if it is not well-formed."""
    end = pattern.rfind(pattern[0])
    if end <= 0 or any(f not in _FLAGS for f in pattern[end + 1 :]):
        return None
    body = pattern[1:end].replace("\\/", "/")
    flags = "".join(sorted(set(pattern[end + 1 :])))
    try:
        re.compile(body)
    except re.error:
        return None
    return (f"(?{flags})" if flags else "") + body


def is_delimited(pattern: str) -> bool:
    return pattern[:1] in ("/", "#")


def active_patterns(cli: str | None, configured: list[str] | None) -> tuple[str, ...]:
    """A pattern on the command line replaces all; then what is configured, even nothing; then the defaults."""
    if cli:
        return (cli,)
    return DEFAULT_FULL_SCAN if configured is None else tuple(configured)

"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find emails, IP addresses, card and phone numbers. The field adds what they do not see: emails with
a written-out or bracketed at sign or a bare host, addresses of version 6 and defanged ones, cards with other
marks between the digits, phones without a country code, and secrets such as tokens and keys, a kind of their
own that follows the four. Its features are word shapes only (character classes, lengths, counts of digits and
marks, changes between letters and digits) of a word and its neighbours; it is trained here by gradient ascent
on the likelihood of ``labelled_lines``, a small table of invented lines, and decoded by Viterbi over numpy
batches of lines. A span of the field stays if it can be of its kind (``plausible``) and no span of the
patterns overlaps it.

A line is a sequence. Lines without a digit, @ or short bracketed word are not decoded if the trained weights
prove (by bounding every feature and transition) that such a line has no span; else all lines are decoded.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; texts of any
length are read whole, the longest line bounds a batch; repeated rows come back repeated; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field finds come after those of the patterns.
ALL_KINDS = (*KINDS, "secret")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern. The local part is the run of its characters before an @, back to the last match."""
    out, done = [], 0
    if "@" not in text:
        return out
    for m in _AFTER_AT.finditer(text):
        at, step, start = m.start(), 64, m.start()
        while start > done:
            lo = max(done, at - step)
            start = lo + len(text[lo:at].rstrip(_LOCAL))
            if start > lo or lo == done:
                break
            step *= 4
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ---- the field -------------------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'[]{}<>#$%&*|="
_BRACKETED = re.compile(r"[(\[{][A-Za-z]{2,3}[)\]}]")
#: What a line of the field may need: lines without it are plain.
_TELLING = re.compile(rf"[0-9@]|{_BRACKETED.pattern}")
_CHANGE = re.compile("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def check_digit(digits: str) -> str:
    """The digit that makes a card number of the digits before it."""
    return next(c for c in "0123456789" if luhn(digits + c))


class Invented:
    """Lines with spans of every kind and lines without, made up from a seed; values are from ranges that are kept for examples."""

    names = ("ann", "bo", "carla", "dmitri", "eve", "farid", "gina", "hal", "ivy", "jon", "kim", "lena")
    hosts = ("example", "sample-site", "mail.example", "intranet", "testhost", "shop.example")
    ends = ("com", "org", "net", "co.uk", "test")
    fillers = ("please", "write", "to", "the", "office", "or", "call", "before", "noon", "about", "it", "Today", "we", "sent", "all", "papers", "und", "dann", "la", "casa", "avec", "nous", "Report", "stands", "for", "a", "long", "time", "no", "reply", "yet")

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def email(self) -> str:
        r = self.rng
        name = r.choice(self.names) + r.choice(["", ".", "_", "-"]) + r.choice(["", self.digits(2), r.choice(self.names)])
        host, end = r.choice(self.hosts), r.choice(self.ends)
        at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" {at} ", "."), (" (at) ", "."), (" [at] ", ".")])
        return r.choice([f"{name}@{host.partition('.')[0]}", f"{name}@{host}.{end}", f"{name}{at}{host}{dot}{end.partition('.')[0]}", f"{name}{at}{host.partition('.')[0]}{dot}{end.partition('.')[0]}"])

    def ip(self) -> str:
        r = self.rng
        four = r.choice(["192.0.2", "198.51.100", "203.0.113"]) + f".{r.randrange(1, 255)}"
        group = lambda: f"{r.randrange(1, 65536):x}"
        six = r.choice(["2001:db8::" + group(), "2001:db8:" + ":".join(group() for _ in range(6)), "fe80::" + ":".join(group() for _ in range(4)), f"2001:db8:{group()}::{group()}:{group()}"])
        return r.choice([four, four.replace(".", "[.]"), four.replace(".", "(.)"), six, six, six.upper()])

    def card(self) -> str:
        r = self.rng
        body = r.choice(["4", "51", "55", "6011"])
        body += self.digits(15 - len(body))
        body += check_digit(body)
        return r.choice([" ", "-", ".", ".", "/", "_", ""]).join(body[k : k + 4] for k in range(0, 16, 4))

    def phone(self) -> str:
        r = self.rng
        area, line = r.choice("23456789") + self.digits(2), "01" + self.digits(2)
        return r.choice([f"({area}) 555-{line}", f"({area}) 555 {line}", f"{area}-555-{line}", f"{area}.555.{line}", f"1-{area}-555-{line}", f"+1 ({area}) 555-{line}", f"+49 30 555{line}", f"0049 30 555{line}", f"({area})555-{line}", f"0{area}/555{line}", f"{area} 555 {line}"])

    def secret(self) -> str:
        r = self.rng
        mixed = lambda of, n: "".join(r.choice(of) for _ in range(n - 2)) + r.choice("abcdef") + r.choice("0123456789")
        hexes, letters = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
        return r.choice([mixed(hexes, 32), mixed(hexes, 40), mixed(hexes, 64), mixed(hexes, 40).upper(), "sk_test_" + mixed(letters, 24), "AKIA" + mixed(letters, 16).upper(), mixed(letters, r.randrange(24, 44)), "ghp_" + mixed(letters, 36)])

    def plain(self) -> str:
        """A word or two with digits or marks that are nobody's data."""
        r = self.rng
        n = self.digits
        return r.choice([
            f"{r.randrange(1, 5000)}", f"{r.randrange(1900, 2030)}", f"2024-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", f"{r.randrange(1, 29)}.0{r.randrange(1, 10)}.2019", f"0{r.randrange(1, 10)}/{r.randrange(10, 29)}/2021",
            f"{r.randrange(0, 24):02}:{n(2)}", f"{r.randrange(10, 24)}:{n(2)}:{n(2)}", f"${r.randrange(1, 900)}.{n(2)}", f"{r.randrange(1, 99)},{n(3)}", f"{r.randrange(1, 9)}.{n(3)}.{n(3)}", f"{r.randrange(0, 9)}.{r.randrange(0, 30)}", f"v{r.randrange(1, 9)}.{r.randrange(0, 9)}.{r.randrange(0, 9)}",
            f"{r.randrange(1, 99)}%", f"{r.randrange(1, 40)}-{r.randrange(41, 90)}", f"#{n(4)}", f"0x{n(2)}f{n(1)}e", f"id={n(8)}", n(6), n(8), n(11), f"{n(2)}-{n(4)}-{n(2)}", f"A{n(3)}-B{n(2)}", f"{r.randrange(2, 9)}x{r.randrange(2, 9)}", f"{r.randrange(1, 9)}th", f"R{n(3)}",
            "http://www.example.com/en/" + n(4), "https://shop.example.org/item?id=" + n(5), "@" + r.choice(self.names), "a @ b", "file_" + n(3) + ".txt", "3:2", "(1)", "[12]", "(" + n(4) + ")", "rgb(10,20,30)", "CO2", "H2O", "B2B", "q1", "1a2b", "ab12cd", "isbn " + n(3) + "-" + n(1), "No. " + n(2), "SHOUT!!", "w###", "|", "--", "..."])

    def line(self) -> tuple[list[str], list[int]]:
        """Words and tags."""
        words: list[str] = []
        tags: list[int] = []
        some = lambda most: [self.rng.choice(self.fillers) for _ in range(self.rng.randrange(most))]

        def put(text: list[str], first: int = 0, more: int = 0) -> None:
            for k, w in enumerate(text):
                words.append(w)
                tags.append(more if k else first)

        put(some(5))
        if self.rng.random() < 0.25:  # prose
            put([self.rng.choice(self.fillers) + self.rng.choice(["", "", "", ",", ".", "-"]) if self.rng.random() < 0.9 else self.rng.choice(["--", "...", "|", "so-called", "it's", "e.g."]) for _ in range(self.rng.randrange(1, 12))])
            return words, tags
        for _ in range(self.rng.choice([1, 1, 1, 2])):
            if self.rng.random() < 0.45:
                put(self.plain().split())
            else:
                kind = self.rng.choice(ALL_KINDS)
                said = getattr(self, kind)().split()
                before, after = self.rng.choice([("", ""), ("", ""), ("", "."), ("", ","), ('"', '"'), ("", "!!"), ("", "###"), ("'", "',")])
                said[0], said[-1] = before + said[0], said[-1]
                said[-1] += after
                put(said, TAGS.index(f"B-{kind}"), TAGS.index(f"I-{kind}"))
            put(some(4))
        if not words:
            put(["so"])
        return words, tags


def labelled_lines(seed: int = 1, n: int = 700) -> list[tuple[list[str], list[int]]]:
    """The labelled table: n invented lines as words and tags."""
    made = Invented(seed)
    return [made.line() for _ in range(n)]


def shape(word: str) -> tuple[str, ...]:
    """Features of a word by its shape alone. Words without digit, @ and brackets around a short word have one of three shapes."""
    core = word.strip(_EDGE)
    digits = len(_DIGIT.findall(core))
    bracketed = bool(_BRACKETED.search(word))
    if not digits and "@" not in core and not bracketed:
        return f"runs={'a' if core.isalpha() else 'none' if not core else 'other'}", "digits=0"
    runs = re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", core))
    changes, size = len(_CHANGE.findall(core)), len(core)
    found = [
        f"runs={runs if len(runs) <= 18 else 'long'}", f"digits={min(digits, 20)}", f"alnum={core.isalnum()}", f"at={'@' in core}{core[:1] == '@'}", f"size={min(size // 4, 12)}",
        f"bracketed={bracketed}{bool(_BRACKETED.fullmatch(word))}{'@' in core}", f"changes={min(changes, 8)}{size >= 20}", f"colons={min(core.count(':'), 3)}{'::' in core}", f"marks={''.join(sorted({c for c in core if not c.isalnum()}))[:6]}",
    ]
    if digits:
        found += [f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 4)}", "mixed" if re.search("[^\\W\\d_]", core) else "numeric", f"open={core[:1] in '(+'}{core[:1] == '+'}", f"hex={bool(re.fullmatch('[0-9a-fA-F:]+', core))}"]
    if "@" in core:
        found.append(f"host={'.' in core.partition('@')[2]}{bool(core.partition('@')[0])}")
    return tuple(found)


def _features(shapes: list[tuple[str, ...]]) -> list[list[str]]:
    """Of each place: its word's features and, marked, those of its neighbours."""
    pad = ("edge",)
    around = [pad, *shapes, pad]
    return [[f"0{x}" for x in around[k]] + [f"-{x}" for x in around[k - 1]] + [f"+{x}" for x in around[k + 1]] for k in range(1, len(around) - 1)]


class Field:
    """Weights of features by tag, and of steps between tags."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.names, self.emit, self.step, self.begin = names, emit, step, begin
        self.cache: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        edge = self._sum(["-edge"]), self._sum(["+edge"])
        self.edge_before, self.edge_after = edge
        self.plain_lines_are_empty = self._proof() < 0

    def _sum(self, names: list[str]) -> np.ndarray:
        rows = [self.names[x] for x in names if x in self.names]
        return self.emit[rows].sum(axis=0) if rows else np.zeros(len(TAGS))

    def _proof(self) -> float:
        """The most that any tags can gain over all-O in a line whose words are all plain, or infinity.

        Plain words have one of few shapes, so lines of them are paths over (shape, next shape, tag); the
        best path that leaves O and comes back is found by relaxation, as a longest path that must not grow.
        """
        forms = [shape(w) for w in ("word", "...", "a-b")]
        n, own = len(forms), [self._sum([f"0{x}" for x in f]) for f in forms]
        before = [self._sum([f"-{x}" for x in f]) for f in forms] + [self.edge_before]
        after = [self._sum([f"+{x}" for x in f]) for f in forms] + [self.edge_after]
        score = np.array([[[own[f] + before[p] + after[x] for x in range(n + 1)] for f in range(n)] for p in range(n + 1)])
        gain = (score - score[..., :1])[..., 1:]  # of each tag but O, by previous, own and next shape
        move = self.step - self.step[0, 0]
        first = np.concatenate([np.broadcast_to(move[0, 1:], (n, len(TAGS) - 1)), [self.begin[1:] - self.begin[0]]])  # after a plain word, at the edge
        best = (gain + first[:, None, None, :]).max(axis=0)  # by own and next shape, and tag
        for _ in range(4 * gain.size):
            into = (best[:, :n, :, None] + move[1:, 1:]).max(axis=2)  # by previous and own shape, and the own tag
            longer = np.maximum(best, (into[:, :, None, :] + gain[:n]).max(axis=0))
            if np.array_equal(longer, best):
                return float(max((best[:, :n] + move[1:, 0]).max(), best[:, n].max()))
            best = longer
        return np.inf

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores, places by tags."""
        parts = []
        for w in words:
            key = w if len(w) <= 64 else None
            got = self.cache.get(w) if key else None
            if got is None:
                f = shape(w)
                got = tuple(self._sum([f"{m}{x}" for x in f]) for m in "0-+")
                if key:
                    if len(self.cache) > 200_000:
                        self.cache.clear()
                    self.cache[w] = got
            parts.append(got)
        own = np.array([p[0] for p in parts])
        own += np.array([self.edge_before, *(p[1] for p in parts[:-1])])
        own += np.array([*(p[2] for p in parts[1:]), self.edge_after])
        return own

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The likeliest tags of each line: Viterbi over all lines at once, the longest first."""
        order = sorted(range(len(lines)), key=lambda k: -len(lines[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(lines)
        at = 0
        while at < len(order):
            most = max(1, len(lines[order[at]]))
            group = order[at : at + max(1, 200_000 // most)]
            at += len(group)
            group = [k for k in group if lines[k]]
            if not group:
                continue
            sizes = np.array([len(lines[k]) for k in group])
            emit = np.zeros((len(group), most, len(TAGS)))
            for r, k in enumerate(group):
                emit[r, : sizes[r]] = self.scores(lines[k])
            best = emit[:, 0] + self.begin
            back = np.zeros((len(group), most, len(TAGS)), np.int8)
            for t in range(1, most):
                live = int(np.searchsorted(-sizes, -t, "left"))  # lines longer than t come first
                paths = best[:live, :, None] + self.step
                back[:live, t] = paths.argmax(axis=1)
                best[:live] = paths.max(axis=1) + emit[:live, t]
            for r, k in enumerate(group):
                tags = np.zeros(sizes[r], np.int8)
                tags[-1] = best[r].argmax()
                for t in range(sizes[r] - 1, 0, -1):
                    tags[t - 1] = back[r, t, tags[t]]
                out[k] = tags
        return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Steps and beginnings that keep spans well-formed."""
    n = len(TAGS)
    step, begin = np.zeros((n, n)), np.zeros(n)
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            begin[j] = -np.inf
            for i, was in enumerate(TAGS):
                if was[2:] != to[2:]:
                    step[i, j] = -np.inf
    return step, begin


class Training:
    """A labelled table as arrays, and the likelihood of weights on it with its gradient."""

    def __init__(self, lines: list[tuple[list[str], list[int]]], decay: float = 0.01):
        feats = [_features([shape(w) for w in words]) for words, _ in lines]
        names = sorted({f for line in feats for place in line for f in place})
        self.names, self.decay = {x: k for k, x in enumerate(names)}, decay
        order = sorted(range(len(lines)), key=lambda k: -len(feats[k]))  # lines that have a place t come first
        most = len(feats[order[0]])
        self.sizes = np.array([len(feats[k]) for k in order])
        self.live = np.arange(most) < self.sizes[:, None]
        self.tags = np.zeros(self.live.shape, int)
        for row, k in enumerate(order):
            self.tags[row, : self.sizes[row]] = lines[k][1]
        places = [[self.names[f] for f in place] for k in order for place in feats[k]]
        self.at = np.array([f for place in places for f in place])
        self.starts = np.cumsum([0, *map(len, places[:-1])])
        owner = np.repeat(np.arange(len(places)), list(map(len, places)))
        by_name = np.argsort(self.at, kind="stable")
        self.owner, self.first = owner[by_name], np.searchsorted(self.at[by_name], np.arange(len(names)))
        self.allow_step, self.allow_begin = _allowed()

    def likelihood(self, emit: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Penalised log likelihood of all lines, and its gradient by forward and backward sums, scaled place by place."""
        n, (rows, most) = len(TAGS), self.live.shape
        score = np.zeros((rows, most, n))
        score[self.live] = np.add.reduceat(emit[self.at], self.starts)
        moves, start = step + self.allow_step, begin + self.allow_begin
        top = score.max(axis=2)
        odds, go = np.exp(score - top[..., None]), np.exp(moves)
        fwd, bwd, norm = np.zeros((rows, most, n)), np.ones((rows, most, n)), np.ones((rows, most))
        steps = np.zeros((n, n))
        told = score[self.live][np.arange(len(self.starts)), self.tags[self.live]].sum() + start[self.tags[:, 0]].sum()
        many = self.live.sum(axis=0)
        for t in range(most):
            on = slice(0, many[t])
            into = odds[on, t] * (np.exp(start) if t == 0 else fwd[on, t - 1] @ go)
            norm[on, t] = into.sum(axis=1)
            fwd[on, t] = into / norm[on, t, None]
        for t in range(most - 1, 0, -1):
            on = slice(0, many[t])
            later = odds[on, t] * bwd[on, t] / norm[on, t, None]
            bwd[on, t - 1] = later @ go.T
            steps -= go * (fwd[on, t - 1].T @ later)
            np.add.at(steps, (self.tags[on, t - 1], self.tags[on, t]), 1)
            told += moves[self.tags[on, t - 1], self.tags[on, t]].sum()
        own = -(fwd * bwd)[self.live]
        own[np.arange(len(own)), self.tags[self.live]] += 1
        grad = np.add.reduceat(own[self.owner], self.first)
        first = -(fwd[:, 0] * bwd[:, 0]).sum(axis=0) + np.bincount(self.tags[:, 0], minlength=n)
        total = (np.log(norm) + top)[self.live].sum()
        weights = [emit, step, begin]
        penalty = 0.5 * self.decay * sum((w * w).sum() for w in weights)
        return float(told - total - penalty), [g - self.decay * w for g, w in zip((grad, steps, first), weights, strict=True)]


def train(lines: list[tuple[list[str], list[int]]], rounds: int = 80, rate: float = 0.3, decay: float = 0.05) -> Field:
    """Ascent on the penalised log likelihood with per-weight step sizes; no randomness."""
    table, n = Training(lines, decay), len(TAGS)
    weights = [np.zeros((len(table.names), n)), np.zeros((n, n)), np.zeros(n)]
    seen = [np.full_like(x, 1e-8) for x in weights]
    for _ in range(rounds):
        _, grads = table.likelihood(*weights)
        for w, g, s in zip(weights, grads, seen, strict=True):
            s += g * g
            w += rate * g / np.sqrt(s)
    emit, step, begin = weights
    return Field(table.names, emit, step + table.allow_step, begin + table.allow_begin)


@lru_cache(1)
def trained() -> Field:
    return train(labelled_lines())


_DEFANGED = re.compile(r"[\[(]\.[\])]")
_AT = re.compile(r"\s*[(\[{]at[)\]}]\s*|@", re.I)
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the field can be of its kind at all."""
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        try:
            ipaddress.ip_address(_DEFANGED.sub(".", text))
        except ValueError:
            return False
        return True
    if kind == "secret":
        return bool(_KEY.fullmatch(text) and digits and len(digits) < len(text))
    name, host = ([*_AT.split(text, maxsplit=1), "", ""])[:2]
    return bool(name.strip() and host.strip())


def added_spans(lines: list[tuple[int, str]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of the field in each line, given as (offset, text)."""
    words = [[(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)] for _, text in lines]
    out = []
    for (offset, text), found, tags in zip(lines, words, field.decode([[w for _, _, w in line] for line in words]), strict=True):
        spans, k = [], 0
        while k < len(found):
            if tags[k]:
                kind, a, j = TAGS[tags[k]][2:], found[k][0], k + 1
                while j < len(found) and TAGS[tags[j]] == f"I-{kind}":
                    j += 1
                b = found[j - 1][1]
                while a < b and text[a] in _EDGE:
                    a += 1
                while b > a and text[b - 1] in _EDGE:
                    b -= 1
                if a < b and plausible(kind, text[a:b]):
                    spans.append((kind, offset + a, offset + b))
                k = j
            else:
                k += 1
        out.append(spans)
    return out


def find_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, by kind and start."""
    base = [base_spans(t or "") for t in texts]
    lines, owner = [], []
    for k, t in enumerate(texts):
        if t and (not field.plain_lines_are_empty or _TELLING.search(t)):
            at = 0
            for line in t.split("\n"):
                if line and (not field.plain_lines_are_empty or _TELLING.search(line)):
                    lines.append((at, line))
                    owner.append(k)
                at += len(line) + 1
    every = [list(b) for b in base]
    for k, spans in zip(owner, added_spans(lines, field), strict=True):
        every[k] += [s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in base[k])]
    rank = {kind: n for n, kind in enumerate(ALL_KINDS)}
    order = lambda s: (rank[s[0]], s[1])
    return [(sorted(b, key=order), sorted(e, key=order)) for b, e in zip(base, every, strict=True)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, base and spans (both array<struct<kind, start, stop>>) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    field = trained()
    span = "array<struct<kind: string, start: bigint, stop: bigint>>"
    row = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]

    def run(cols):
        found = find_spans(cols[1], field)
        return [cols[0], [row(b) for b, _ in found], [row(e) for _, e in found]]

    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, base {span}, spans {span}", rows=512)

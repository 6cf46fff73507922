"""Chat formatting: a finite-state machine over roles and a declarative template, all in SQL functions.

A template says how a turn is marked, which roles are trained on and which role may follow which. The machine
runs over the turns of a conversation and writes a letter for each: the state that the turn led to and whether
its text is trained on. The segments with their loss flags, and whether the order is valid, are read from
these letters. A turn that may not stand where it is leads to a state that is never left; texts are still marked
and flagged there.

Texts are escaped reversibly: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so that no text holds a
control string; in roles a line break becomes ``<|nl|>``, which no escaped text can hold either.

A conversation is one row of the result, so its turns meet in one task: the digest and the formatted
text of a conversation are single values. Conversations are independent and there is no other shuffle.

Defined results: turns are ordered by turn, null first, ties by role and then text; repeated rows are
turns of their own; null texts and roles are empty; texts of any length are kept whole; rows with a null id form
one conversation; an invalid order is formatted all the same and told by ``valid``; no rows give no rows; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    #: state -> {role: next state}; a pair that is absent rejects the conversation.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("answered",)


CHATML = Template()


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<|nl|>"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


#: Turns that the machine takes at a time, so that its letters are not copied for every turn of a long conversation.
PIECE = 512
REJECT = "reject"


class Machine:
    """The template's moves as a table from (letter, role) to a letter. A letter stands for a state and a loss flag."""

    def __init__(self, template: Template):
        states = sorted({*template.moves, *(then for to in template.moves.values() for then in to.values()), "begin"} - {REJECT})
        self.letter = {(state, loss): chr(ord("A") + 2 * k + loss) for k, state in enumerate([REJECT, *states]) for loss in (False, True)}
        self.trained, self.begin = template.trained, self.letter["begin", False]
        self.accepting = [self.letter[state, loss] for state in template.accept for loss in (False, True)]
        self.losses = [x for (_, loss), x in self.letter.items() if loss]
        self.table = {f"{self.letter[state, was]}{role}": self.letter[then, role in template.trained] for state, to in template.moves.items() for role, then in to.items() for was in (False, True)}

    def next(self, letter: Column, role: Column) -> Column:
        moves = F.create_map(*[F.lit(x) for pair in self.table.items() for x in pair])
        rejected = F.when(role.isin(*self.trained), self.letter[REJECT, True]).otherwise(self.letter[REJECT, False])
        return F.coalesce(F.element_at(moves, F.concat(letter, role)), rejected)

    def run(self, turns: Column) -> Column:
        """array<string>: the letter of each turn."""
        told = lambda at, said: F.struct(at.alias("at"), said.alias("said"))
        step = lambda acc, t: F.transform(F.array(self.next(acc["at"], t["role"])), lambda x: told(x, F.concat(acc["said"], x)))[0]
        piece = lambda acc, k: F.aggregate(F.slice(turns, k * PIECE + 1, PIECE), told(acc["at"], F.lit("")), step)
        both = lambda acc, k: F.transform(F.array(piece(acc, k)), lambda x: told(x["at"], F.concat(acc["said"], x["said"])))[0]
        pieces = F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / PIECE).cast("int"))
        return F.split(F.aggregate(pieces, told(F.lit(self.begin), F.lit("")), both)["said"], "")


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, valid."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    machine = Machine(template)
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def parts(t: Column, k: Column) -> Column:
        head = F.concat(F.lit(template.start), _role_out(t["role"]), F.lit(template.after_role))
        return F.array(seg(head, F.lit(False)), seg(escaped(t["text"]), F.get("letters", k).isin(*machine.losses)), seg(F.lit(template.end), F.lit(False)))

    run = convs.select("conv_id", "turns", machine.run(F.col("turns")).alias("letters"))
    made = run.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"), F.element_at("letters", -1).isin(*machine.accepting).alias("valid"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    quoted = "\\Q" + template.end + "\\E"
    pieces = F.split(formatted, quoted)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(template.start) + 1), F.length(p)))

    def read(p: Column) -> Column:
        role = F.substring_index(p, template.after_role, 1)
        text = F.substring(p, F.length(role) + len(template.after_role) + 1, F.length(p))
        return F.struct(_role_in(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(bare, read)


def read_loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")

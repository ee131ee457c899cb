"""Chat formatting: a finite-state machine over roles, text segments with loss flags, and the way back.

Columns and SQL functions only. A ``Template`` declares the parts that every turn is written with and which of them count
in the loss, and the moves between roles that a conversation may make. Control strings inside a text are made harmless
reversibly: every ``<`` followed by backslashes and ``|`` gets one backslash more, so that ``<|`` occurs nowhere but in the
template's own markers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

GUARD = "<|"


@dataclass(frozen=True)
class Part:
    """One piece of a turn: a fixed ``literal``, the ``role`` or the ``text``; ``loss_roles``: roles in whose turns it is learned."""

    kind: str
    value: str = ""
    loss_roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Template:
    """Parts of a turn in order, allowed moves ``{state: next roles}`` (a state is the last role, ``start`` at first), final roles."""

    parts: tuple[Part, ...] = (
        Part("literal", "<|im_start|>"),
        Part("role"),
        Part("literal", "\n"),
        Part("text", loss_roles=("assistant",)),
        Part("literal", "<|im_end|>\n"),
    )
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        kinds = [p.kind for p in self.parts]
        if kinds != ["literal", "role", "literal", "text", "literal"]:
            raise ValueError("a turn is: marker, role, separator, text, marker")
        opening, _, separator, _, closing = self.parts
        if not (opening.value.startswith(GUARD) and closing.value.startswith(GUARD) and separator.value == "\n"):
            raise ValueError("markers start with '<|' and a line feed ends the role, or texts could not be told from markers")


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles may not hold a line feed, which ends them: per cent and line feed are written as codes."""
    return escape_text(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape_text(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _segments(turn: Column, template: Template) -> Column:
    def content(part: Part) -> Column:
        return {"literal": F.lit(part.value), "role": escape_role(turn["role"]), "text": escape_text(turn["text"])}[part.kind]

    def loss(part: Part) -> Column:
        return turn["role"].isin(*part.loss_roles) if part.loss_roles else F.lit(False)

    return F.array(*[F.struct(content(p).alias("text"), loss(p).alias("loss"), F.lit(p.kind).alias("kind")) for p in template.parts])


def _walk(turns: Column, template: Template) -> Column:
    """Runs the machine: the state reached (empty once a move is forbidden) and the position of the first forbidden turn."""
    moves = F.create_map(*[F.lit(x) for state, roles in template.moves.items() for role in roles for x in (f"{state}>{role}", role)])

    def step(walk: Column, turn: Column) -> Column:
        moved = F.coalesce(F.try_element_at(moves, F.concat(walk["state"], F.lit(">"), turn["role"])), F.lit(""))
        return F.struct(
            moved.alias("state"),
            (walk["at"] + 1).alias("at"),
            F.coalesce(walk["bad"], F.when(moved == "", walk["at"])).alias("bad"),
        )

    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, n_turns, formatted, segments array<text, loss, kind>, valid, first_bad_turn`` for every conversation.

    Needs ``conv_id, turn, role, text``; other columns are left out. Turns are ordered by turn (null first), equal ones by role
    and text; repeated rows are repeated turns. Null texts and roles are empty strings. A conversation that breaks the turn
    order is formatted all the same, with ``valid`` false and the position (from 0) of its first forbidden turn, or null there
    if only its last role is not a final one. A null ``conv_id`` is one conversation; no rows give no rows.
    """
    template = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    walked = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
        _walk(F.col("turns"), template).alias("walk"),
    )
    return walked.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        F.coalesce(F.col("walk.bad").isNull() & F.col("walk.state").isin(*template.final), F.lit(False)).alias("valid"),
        F.col("walk.bad").alias("first_bad_turn"),
    )


def read_chat(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, exactly as they went in."""
    opening, _, separator, _, closing = [p.value for p in (template or Template()).parts]
    pieces = F.split(formatted, r"\Q" + opening + r"\E")

    def turn(piece: Column) -> Column:
        at = F.instr(piece, separator)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"),
            unescape_text(F.substring(piece, at + 1, F.length(piece) - at - len(closing))).alias("text"),
        )

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape_text(s["text"])), "")

"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative template names the markers around a turn, the roles that are
learned, and the moves between roles that make an order valid.  Turns become
segments (text, loss); all segments in order are the formatted text.  Only a
learned role's own text is under the loss mask; markers aren't.

Markers inside texts and roles are escaped reversibly: first the escape sign is
doubled, then it is put between the two characters that begin each marker.  So
a text can't close its own turn, and reading back gives it exactly.

Only SQL functions are used.  A conversation becomes one row, as its output is
one text.  Turns go by number, then role, then text, so ties and repeated rows
have one order; a null number comes first.  A null text or role counts as empty;
an empty or unknown role is invalid for the machine but still formatted.  Rows
with a null conversation id form one conversation.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape sign, and what begins each marker.
ESCAPE, OPENING = "\\", "<|"
#: The state before any turn, and the one that no move leaves.
START, WRONG = "start", "wrong"


@dataclass(frozen=True)
class Template:
    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    #: state -> roles that may follow; a state is the last role
    moves: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(2 * ESCAPE)), F.lit(OPENING), F.lit(OPENING[0] + ESCAPE + OPENING[1:]))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPENING[0] + ESCAPE + OPENING[1:]), F.lit(OPENING)), F.lit(2 * ESCAPE), F.lit(ESCAPE))


def _role_out(c: Column) -> Column:
    return F.replace(escaped(c), F.lit("\n"), F.lit(ESCAPE + "n"))


def _role_in(c: Column) -> Column:
    # signs come in pairs but for the one before n, which is after all pairs of its run
    pairs = F.split(c, r"\\\\", -1)
    return unescaped(F.array_join(F.transform(pairs, lambda p: F.replace(p, F.lit(ESCAPE + "n"), F.lit("\n"))), 2 * ESCAPE))


def final_state(roles: Column, template: Template = CHATML) -> Column:
    """The machine's state after an array of roles."""
    moves = F.create_map(*[F.lit(x) for state, nexts in template.moves.items() for role in nexts for x in (f"{state}\n{role}", role)])
    return F.aggregate(roles, F.lit(START), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(WRONG)))


def format_chats(turns: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv id, segments array<struct<text, loss>>, formatted, state, valid of each conversation."""
    rows = turns.select(
        F.col(conv_col),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("_turn"),
    )
    chats = rows.groupBy(conv_col).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.before_role), _role_out(t["role"]), F.lit(template.after_role)), no),
                segment(escaped(t["text"]), t["role"].isin(*template.learned)),
                segment(F.lit(template.after_text), no),
            ),
        )
    )
    state = final_state(F.transform("_turns", lambda t: t["role"]), template)
    chats = chats.select(conv_col, segments.alias("segments"), state.alias("state"))
    return chats.select(
        conv_col, "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.final).alias("valid")
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(formatted, "\\Q" + template.after_text + "\\E")
    turns = F.filter(parts, lambda p: p.startswith(template.before_role))
    start = len(template.before_role) + 1

    def turn(p: Column) -> Column:
        at = F.locate(template.after_role, p, start)
        return F.struct(
            _role_in(F.substring(p, F.lit(start), at - start)).alias("role"),
            unescaped(F.substring(p, at + len(template.after_role), F.length(p))).alias("text"),
        )

    return F.transform(turns, turn)


def chat_digests(chats: DataFrame, conv_col: str = "conv_id", template: Template = CHATML) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from the output."""
    back = chats.select(
        conv_col,
        read_back(F.col("formatted"), template).alias("turns"),
        unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("valid").alias("valid_order"),
    )

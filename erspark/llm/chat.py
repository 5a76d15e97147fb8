"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over roles checks the order of turns; every conversation is
formatted, and ``valid`` tells which ones it accepts. Each turn gives segments with loss
flags. All control strings of a template start with its guard, and a guard inside a text
is broken up reversibly: one ``&`` more goes between ``<`` and ``|`` of every ``<&*|``.

Turns are ordered by (turn, role, text), nulls first. Null roles and texts are empty
strings; a conversation without an id is one of its own. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: Roles whose text is trained on.
    loss: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state.
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "called"},
            "called": {"assistant": "answered", "tool": "called"},
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if not (self.begin.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("control strings must start with the guard <|")


CHATML = Template()


def escape(c):
    return F.regexp_replace(c, r"<(&*)\|", "<&$1|")


def unescape(c):
    return F.regexp_replace(c, r"<&(&*)\|", "<$1|")


def escape_role(c):
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c):
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def final_state(roles, template: Template):
    """The state after all roles; null once a turn is out of order."""
    step = {f"{a}\n{role}": b for a, to in template.turns.items() for role, b in to.items()}
    table = F.create_map(*[F.lit(x) for kv in step.items() for x in kv])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.element_at(table, F.concat(state, F.lit("\n"), role)))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, formatted, loss_spans (start, size in code points), n_turns, valid, state."""
    row = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    trained = F.array(*[F.lit(x) for x in template.loss])

    def segments(t):
        return F.array(
            F.struct(F.concat(F.lit(template.begin), escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), F.array_contains(trained, t["role"]).alias("loss")),
            F.struct(F.lit(template.end + "\n").alias("text"), F.lit(False).alias("loss")),
        )

    parts = chats.withColumn("segments", F.flatten(F.transform("turns", segments)))
    ends = F.aggregate(
        "segments",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["text"])).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(s["text"]).alias("size"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    state = final_state(F.transform("turns", lambda t: t["role"]), template)
    return parts.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ends["spans"].alias("loss_spans"),
        F.size("turns").cast("bigint").alias("n_turns"),
        state.alias("state"),
        "segments",
    ).withColumn("valid", F.coalesce(F.col("state").isin(*template.accept), F.lit(False)))


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Turns (array of role, text) and loss texts, read back from formatted and loss_spans."""
    quoted = lambda x: "".join("\\" + c if c in "|<>[](){}.*+?^$\\" else c for c in x)
    pieces = F.filter(F.split("formatted", quoted(template.begin)), lambda p: F.length(p) > 0)
    tail = len(template.end) + 1

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        size = F.length(p) - F.length(role) - 1 - tail
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, F.length(role) + 2, size)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["size"])))
    return formatted.withColumn("read_turns", F.transform(pieces, turn)).withColumn("read_loss", loss)


def chat_digests(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    back = read_chats(format_chats(turns, template), template)
    told = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("read_loss", "")
    return back.select(
        "conv_id",
        F.size("read_turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )

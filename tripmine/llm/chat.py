"""Chat formatting from a declarative template, with SQL expressions only.

A finite-state machine over roles checks the turn order of every conversation;
the template then gives its text as segments, each with a loss flag. Where a control
string of the template would begin inside a text or role, its first character is
escaped, so no text can forge a turn, reading back gives the texts unchanged, and
other text stays as it is.

A conversation is one training sample: its turns come together in one row, in
order of turn, then role, then text. Null roles and texts count as empty; a
conversation that breaks the turn order is kept and marked ``valid = false``;
repeated rows are repeated turns; an empty table gives no rows; rows with a null
``conv_id`` form one conversation. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Template:
    """Control strings around role and text, the roles that are learned, and the turn order.

    ``order`` maps ``state|role`` to the next state; anything missing is an error.
    """

    opening: str = "### "
    middle: str = ": "
    closing: str = " </turn>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    order: dict[str, str] = field(
        default_factory=lambda: {
            "start|system": "ready",
            "start|user": "asked",
            "ready|user": "asked",
            "asked|assistant": "answered",
            "answered|user": "asked",
        }
    )
    accepted: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if "\\" in self.opening + self.middle + self.closing:
            raise ValueError("control strings hold no backslash")

    def _codes(self) -> dict[str, str]:
        """What stands for the first character of each control string."""
        return {s: "\\" + code for s, code in zip((self.opening, self.middle, self.closing), "abc", strict=True)}

    def escaped(self, text: Column, *, role: bool = False) -> Column:
        """Text in which no control string begins; only their first characters and
        backslashes are written otherwise. The middle one matters in roles only."""
        text = F.replace(text, F.lit("\\"), F.lit("\\z"))
        for control, code in self._codes().items():
            if role or control != self.middle:
                text = F.replace(text, F.lit(control), F.lit(code + control[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        for control, code in self._codes().items():
            text = F.replace(text, F.lit(code), F.lit(control[0]))
        return F.replace(text, F.lit("\\z"), F.lit("\\"))


TEMPLATE = Template()


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: ``conv_id, valid, segments, formatted, loss_spans``.

    ``segments`` are (text, loss) in order; ``formatted`` is their concatenation;
    ``loss_spans`` are (start, length) of the learned segments, counted in
    characters of ``formatted`` from 1.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*(F.lit(x) for pair in template.order.items() for x in pair))
    state = F.aggregate(
        "turns",
        F.lit(template.start),
        lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit("|"), t["role"])), F.lit("error")),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(template.opening), template.escaped(t["role"], role=True), F.lit(template.middle))
        return F.array(
            segment(head, F.lit(False)),
            segment(template.escaped(t["text"]), t["role"].isin(*template.learned)),
            segment(F.lit(template.closing), F.lit(False)),
        )

    segments = chats.select(
        "conv_id",
        state.isin(*template.accepted).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )
    begun = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def further(s: Column, seg: Column) -> Column:
        n = F.length(seg["text"])
        span = F.array(F.struct(s["at"].alias("start"), n.alias("length")))
        return F.struct(
            (s["at"] + n).alias("at"),
            F.when(seg["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        )

    return segments.select(
        "*",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.aggregate("segments", begun, further, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """(role, text) of each turn, read back from a formatted conversation."""
    pieces = F.split(formatted, "\\Q" + template.closing + "\\E", -1)

    def parsed(piece: Column) -> Column:
        inner = F.substring(piece, len(template.opening) + 1, 2**31 - 1)
        at = F.instr(inner, template.middle)
        return F.struct(
            template.unescaped(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            template.unescaped(F.substring(inner, at + len(template.middle), F.length(inner))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parsed)


def read_loss(formatted: Column, spans: Column, template: Template = TEMPLATE) -> Column:
    """All learned text, unescaped, in order."""
    texts = F.transform(spans, lambda s: template.unescaped(F.substring(formatted, s["start"], s["length"])))
    return F.array_join(texts, "")

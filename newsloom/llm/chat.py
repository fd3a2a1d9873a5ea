"""Chat formatting by a finite-state machine over roles; DataFrame functions only.

A declarative Template names the markers, which roles may start and follow each other, and which
roles are learnt. `format_chats` gives one row per conversation: `segments` (text pieces, each with
a loss flag), `formatted` (the pieces joined) and `valid` (the machine accepted the turn order;
invalid conversations are marked, not dropped). `read_chats` parses `formatted` back.

Inside roles and texts every `~` becomes `~0`, every `<|` becomes `~1`, and a line feed in a role
`~2`; so no marker can occur inside a text, and reading reverses it.

Nulls: a null text or role is empty; rows whose conv_id is null form one conversation. Turns are
ordered by turn (null first), then role, then text, so ties and repeated rows have one order and
repeated rows stay. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    role_end: str = "\n"
    closing: str = "<|im_end|>\n"
    first: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    last: tuple[str, ...] = ("assistant",)
    learnt: tuple[str, ...] = ("assistant",)


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))
    return F.replace(c, F.lit("\n"), F.lit("~2")) if role else c


def unescape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("~2"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def _step(template: Template):
    """The machine: a state is the role last seen, `start` or `bad`."""

    def step(state: Column, role: Column) -> Column:
        ways = F.when((state == "start") & role.isin(*template.first), F.concat(F.lit("role:"), role))
        for before, after in template.follows.items():
            ways = ways.when((state == f"role:{before}") & role.isin(*after), F.concat(F.lit("role:"), role))
        return ways.otherwise("bad")

    return step


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(template.opening), escape(x.role, True), F.lit(template.role_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x.text).alias("text"), x.role.isin(*template.learnt).alias("loss")),
                F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    ends = [f"role:{x}" for x in template.last]
    return (
        chats.withColumn("segments", pieces)
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
        .withColumn("valid", F.aggregate(F.transform("turns", lambda x: x.role), F.lit("start"), _step(template)).isin(*ends))
        .select("conv_id", "segments", "formatted", "valid")
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds `turns` (role and text, parsed from `formatted`) and `loss_text` (unescaped text under the loss flags)."""
    quoted = "\\Q" + template.opening + "\\E"
    parts = F.split("formatted", quoted)
    n = len(template.closing)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.role_end)
        text = F.substring(p, at + len(template.role_end), F.length(p) - at - (len(template.role_end) - 1) - n)
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1), True).alias("role"), unescape(text).alias("text"))

    return formatted.withColumn("turns", F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)).withColumn(
        "loss_text", unescape(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), ""))
    )

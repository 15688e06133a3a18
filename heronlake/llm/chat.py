"""Chat formatting: a finite-state machine over roles, and a declarative template that gives text segments with a
loss flag each. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

@dataclass(frozen=True)
class Template:
    """start + role + between + text + end for each turn. The opening of control strings is escaped in roles and texts:
    first the escape sign, then the opening; in roles also what ends a role."""

    start: str = "<|im_start|>"
    between: str = "\n"
    end: str = "<|im_end|>\n"
    opening: str = "<|"
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<|", "&lt;|"))
    role_escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<|", "&lt;|"), ("\n", "&nl;"))
    learned: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role without an entry, or an end in another state, makes a conversation invalid.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    initial: str = "begin"
    final: tuple[str, ...] = ("answered",)


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, written in pairs:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, written in reversed(pairs):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def end_state(roles: Column, template: Template) -> Column:
    """The state after all roles; null once a move is missing."""
    table = F.create_map(*[F.lit(x) for s, m in template.moves.items() for r, t in m.items() for x in (f"{s} {r}", t)])
    return F.aggregate(roles, F.lit(template.initial), lambda state, role: F.when(state.isNotNull(), table[F.concat(state, F.lit(" "), role)]))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, loss_spans array<struct<start, end>>, valid; one row for each
    conversation. Spans are code points of formatted, end exclusive.

    rows: conv_id, turn, role, text; other columns are not read. An empty table has no conversations. Rows are put in order of turn, role, text, nulls first; repeated rows are repeated turns.
    Null roles and texts count as empty; null conv_ids are one conversation. Whatever the order of roles, the conversation
    is formatted; valid says whether the state machine accepts it. Offsets are running sums over the sorted rows, so time grows with
    a conversation's length and not its square. A conversation's text is one value: its rows meet in one task, as the result does."""
    t = template or Template()
    head = F.concat(F.lit(t.start), escape(F.col("role"), t.role_escapes), F.lit(t.between))
    rows = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"head": head, "body": escape(F.col("text"), t.escapes)})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(t.end)
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "at", "head", "body"))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        return F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["role"].isin(*t.learned)), segment(F.lit(t.end), F.lit(False)))

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["head"])
        return F.struct(start.alias("start"), (start + F.length(x["body"])).alias("end"))

    return whole.select(
        "conv_id",
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(t.end))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["role"].isin(*t.learned)), span).alias("loss_spans"),
        F.coalesce(end_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final), F.lit(False)).alias("valid"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns, array of struct<role, text>, that a formatted text holds; null for null, none for an empty text."""
    t = template or Template()
    pieces = F.slice(F.split(formatted, _quoted(t.start)), 2, 1 << 30)

    def of(piece: Column) -> Column:
        cut = F.instr(piece, t.between)
        body = F.substring(piece, cut + len(t.between), F.length(piece) - cut - len(t.between) - len(t.end) + 1)
        return F.struct(
            unescape(F.substring(piece, F.lit(1), cut - 1), t.role_escapes).alias("role"),
            unescape(body, t.escapes).alias("text"),
        )

    return F.transform(pieces, of)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 and c not in "_\n" else c for c in text)

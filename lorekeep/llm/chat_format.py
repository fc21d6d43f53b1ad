"""Chat formatting in DataFrame operations only.

Records come in several layouts: lists of messages, lists of from/value pairs, prompt and completion,
instruction with input and output. The sorted nested field paths that a record fills are hashed to a
fingerprint, and the fingerprint selects a declarative mapping that turns the record into canonical
turns (role, text). A template then writes the turns as one string with a loss mask. Control strings
inside texts are escaped, and :func:`read_turns` gets the very same turns back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import fresh_name

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

START, END = "<|turn_start|>", "<|turn_end|>\n"
#: A control string begins with one of two characters, and goes on as one of these. the
#: marks of the common chat templates and of this one.
CONTROL = r"(?:/?s>|/?INST\]|</?SYS>>|\|[A-Za-z_]{1,32}\|>)"
_ESCAPE = rf"([<\[])(\\*)(?={CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={CONTROL})"


@dataclass(frozen=True)
class Layout:
    """How to read one layout: either a list of messages, or fields that become turns in order."""

    name: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.items:
            return tuple(sorted((f"{self.items}[].{self.role}", f"{self.items}[].{self.text}")))
        return tuple(sorted(name for _, names in self.fields for name in names))


LAYOUTS = (
    Layout("messages", items="messages"),
    Layout("from_value", items="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def record_schema(layouts: tuple[Layout, ...] = LAYOUTS) -> T.StructType:
    """A nullable schema with the fields of all layouts, for ``from_json`` or ``spark.read.json``."""
    out: dict[str, T.DataType] = {}
    for layout in layouts:
        if layout.items:
            out[layout.items] = T.ArrayType(T.StructType([T.StructField(layout.role, T.StringType()), T.StructField(layout.text, T.StringType())]))
        for _, names in layout.fields:
            out.update(dict.fromkeys(names, T.StringType()))
    return T.StructType([T.StructField(k, v) for k, v in sorted(out.items())])


def _readable(df: DataFrame, layouts: tuple[Layout, ...]) -> list[tuple[str, str, str]]:
    """(path, column, leaf) of the paths of the layouts that the table has, with a fitting type."""
    out = []
    for path in sorted({path for layout in layouts for path in layout.paths()}):
        top, _, leaf = path.partition("[].")
        kind = df.schema[top].dataType if top in df.columns else None
        nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and leaf in kind.elementType.names
        if nested if leaf else isinstance(kind, T.StringType):
            out.append((path, top, leaf))
    return out


def _present(df: DataFrame, layouts: tuple[Layout, ...]) -> Column:
    """The paths, among those of the layouts, that a row fills; a nested one counts if any element fills it."""
    parts = []
    for path, top, leaf in _readable(df, layouts):
        column = F.col(f"`{top}`")
        # an element that fills the leaf, or a list that has no elements to judge by
        filled = (F.size(column) == 0) | (F.size(F.array_compact(column[leaf])) > 0) if leaf else F.lit(True)
        parts.append(F.when(column.isNotNull() & filled, F.lit(path)))
    if not parts:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*parts))


def fingerprint(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """A hash of the sorted nested field paths that a row fills; columns of no layout don't count."""
    return F.xxhash64(F.array_join(F.array_sort(_present(df, layouts)), "|"))


def _turns(layout: Layout) -> Column:
    if layout.items:
        def turn(x: Column) -> Column:
            role = F.coalesce(x[layout.role], F.lit(""))
            for old, new in layout.roles:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[layout.text], F.lit("")).alias("text"))

        return F.transform(F.col(f"`{layout.items}`"), turn)
    return F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *[F.col(f"`{n}`") for n in names]).alias("text")) for role, names in layout.fields])


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` (string) and ``turns`` (array of role, text) to each record.

    A record that fills the fields of no layout, or of several at once, has a null layout and null
    turns. Null roles and texts become empty, but a list in which every role or every text is null
    doesn't fill that field; an empty list gives no turns. Further columns pass through, whatever their
    names; a column named layout or turns is replaced. An empty table gives no rows.
    """
    have = {path for path, _, _ in _readable(df, layouts)}
    usable = [x for x in layouts if set(x.paths()) <= have]
    held = fresh_name(df, "mark")
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(T.ArrayType(TURN))
    for layout in usable:
        selected = F.col(held) == F.xxhash64(F.lit("|".join(layout.paths())))
        name = F.when(selected, F.lit(layout.name)).otherwise(name)
        turns = F.when(selected, _turns(layout)).otherwise(turns)
    return df.withColumn(held, fingerprint(df, layouts)).withColumns({"layout": name, "turns": turns}).drop(held)


def escape(text: Column) -> Column:
    """Put one backslash more after the first character of every control string."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(df: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` (string) and ``loss_mask`` (array of start, length in code points).

    The mask covers the escaped text of every turn whose role is in ``learn``, in order. Null turns
    give a null string and mask; no turns give an empty string. Further columns pass through, whatever
    their names; a column named formatted or loss_mask is replaced.
    """
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    written = F.transform(
        F.col("turns"),
        lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learn).alias("learn")),
    )
    held = fresh_name(df, "written")
    parts = F.transform(F.col(held), lambda w: F.concat(w["head"], w["body"], F.lit(END)))
    span = "struct<start:bigint,length:bigint>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, w: Column) -> Column:
        start = acc["at"] + F.char_length(w["head"])
        size = F.char_length(w["body"]).cast("bigint")
        one = F.array(F.struct(start.alias("start"), size.alias("length")).cast(span))
        return F.struct((start + size + len(END)).alias("at"), F.when(w["learn"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return (
        df.withColumn(held, written)
        .withColumns({"formatted": F.array_join(parts, ""), "loss_mask": F.aggregate(held, zero, step)["spans"]})
        .drop(held)
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string was made of."""
    cut = F.slice(F.split(formatted, START.replace("|", r"\|")), 2, 2**31 - 2)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        skip = F.char_length(role)
        body = F.substring(part, skip + 2, F.char_length(part) - skip - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(cut, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, as one string."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as one record a conversation: conv_id, messages.

    Turns are in order of turn, then role, then text; a null turn comes first, repeated rows stay.
    Rows with a null conv_id are one conversation.
    """
    one = F.struct(
        F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("content")
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_all")).select(
        "conv_id", F.transform("_all", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )

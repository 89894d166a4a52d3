"""Bring conversations of many layouts into one marked-up training text.

A record's layout is told by its schema fingerprint: the hash of its nested field
paths, without types or values. The fingerprint selects a declarative mapping, which
turns the record into canonical turns, one row each: ``(conversation, turn, role,
text)``. Turns are then written between control strings, texts and roles are escaped
so that no control string can arise inside them, and the characters of assistant
texts form the loss mask. Escaping is reversible and :func:`read_back` undoes it.

Everything is DataFrame expressions: no Python runs on executors.

Defined cases: a null or empty text is an empty turn, and so is a null role. A null
identifier is one conversation of its own. Turns are ordered by number, then role, then
text, nulls first; repeated rows are repeated turns. A record whose fingerprint is not
known, or which is not JSON, gives no turn and is listed by
:func:`unmapped_records`. A table of turns is told by the fingerprint of its own schema, and may have more columns;
one that fits no layout is refused. Texts are read whole whatever their length. Empty tables give empty results. Operators read only the
columns they are told of. A conversation is one training text and hence one row; it is
gathered in one task, while conversations are spread by identifier.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _OPEN_ESCAPED = "<|", "<\\|"


@dataclass(frozen=True)
class Fields:
    """Turns that are fields of the record: (role, paths), paths joined by a new line."""

    structure: dict
    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Messages:
    """Turns that are a list: where it is, its role and text fields, and role names."""

    structure: dict
    path: str
    role: str
    text: str
    names: dict = field(default_factory=dict)


# The layouts known from the start. ``structure`` shows the nested fields.
LAYOUTS: dict[str, Fields | Messages] = {
    "prompt": Fields(
        {"prompt": None, "completion": None},
        (("user", ("prompt",)), ("assistant", ("completion",))),
    ),
    "question": Fields(
        {"question": None, "answer": None},
        (("user", ("question",)), ("assistant", ("answer",))),
    ),
    "instruction": Fields(
        {"instruction": None, "input": None, "output": None},
        (("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    "messages": Messages(
        {"messages": [{"role": None, "content": None}]}, "messages", "role", "content"
    ),
    "dialogue": Messages(
        {"conversations": [{"from": None, "value": None}]},
        "conversations",
        "from",
        "value",
        {"human": "user", "gpt": "assistant"},
    ),
}


def field_paths(structure, prefix: str = "") -> list[str]:
    """``{"a": [{"b": None}]}`` has the paths ``a[].b``."""
    if isinstance(structure, dict) and structure:
        return sorted(
            path
            for name, inner in structure.items()
            for path in field_paths(inner, f"{prefix}.{name}" if prefix else name)
        )
    if isinstance(structure, list):
        return field_paths(structure[0] if structure else None, f"{prefix}[]")
    return [prefix]


def _shape(structure) -> str:
    if structure is None:
        return "VALUE"
    if isinstance(structure, dict):
        inner = (
            name if value is None else f"{name}: {_shape(value)}"
            for name, value in sorted(structure.items())
        )
        return f"OBJECT<{', '.join(inner)}>"
    return f"ARRAY<{_shape(structure[0])}>"


def fingerprint(structure: dict) -> str:
    return hashlib.sha256(_shape(structure).encode()).hexdigest()


def record_fingerprint(record: Column) -> Column:
    """The same of a JSON text; null if it is not JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    untyped = F.regexp_replace(schema, r": [A-Z]+(\([0-9, ]+\))?(?=[,>])", "")
    return F.sha2(untyped, 256)


def record_turns(
    df: DataFrame, id_column: str, record_column: str, layouts: dict | None = None
) -> DataFrame:
    """Canonical turns of JSON records, each by the mapping its fingerprint selects."""
    layouts = LAYOUTS if layouts is None else layouts
    by_print = [(fingerprint(x.structure), _mapped(x)) for x in layouts.values()]
    records = df.select(
        F.col(id_column).alias("conversation"),
        record_fingerprint(F.col(record_column)).alias("print"),
        F.try_parse_json(F.col(record_column)).alias("record"),
    )
    turns = reduce(
        lambda other, one: F.when(F.col("print") == one[0], one[1]).otherwise(other),
        by_print,
        F.lit(None).cast("array<struct<role:string,text:string>>"),
    )
    return records.select("conversation", F.posexplode(turns).alias("turn", "said")).select(
        "conversation", F.col("turn").cast("long"), "said.role", "said.text"
    )


def unmapped_records(
    df: DataFrame, id_column: str, record_column: str, layouts: dict | None = None
) -> DataFrame:
    """Records that no mapping fits, with their fingerprint, so that one can be added."""
    known = [fingerprint(x.structure) for x in (LAYOUTS if layouts is None else layouts).values()]
    found = record_fingerprint(F.col(record_column))
    return df.select(
        F.col(id_column).alias("conversation"), found.alias("fingerprint")
    ).filter(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known))


# Tables that hold a turn a row: which columns hold what, by the table's fingerprint.
ROW_LAYOUTS = {
    fingerprint({name: None for name in names}): names
    for names in (
        ("conv_id", "turn", "role", "text"),
        ("conversation_id", "turn", "role", "content"),
        ("dialog", "index", "speaker", "utterance"),
    )
}


def table_structure(kind: T.DataType):
    """The nested fields of a table or a column, as the layouts show them."""
    if isinstance(kind, T.StructType):
        return {f.name: table_structure(f.dataType) for f in kind.fields}
    return [table_structure(kind.elementType)] if isinstance(kind, T.ArrayType) else None


def row_layout(schema: T.StructType) -> tuple[str, str, str, str] | None:
    """The fields of a table that hold conversation, turn, role and text; None if no layout fits.

    A layout fits if the fingerprint of the table's fields of its names is its own; other fields do not matter. Of
    several the first listed counts.
    """
    held = table_structure(schema)
    for names in ROW_LAYOUTS.values():
        found = {name: held[name] for name in names if name in held}
        if len(found) == len(names) and fingerprint(found) in ROW_LAYOUTS:
            return ROW_LAYOUTS[fingerprint(found)]
    return None


def row_turns(df: DataFrame) -> DataFrame:
    """Canonical turns of a table that holds a turn a row, by the mapping that its own schema selects."""
    names = row_layout(df.schema)
    if names is None:
        raise ValueError(f"no mapping for the fields {field_paths(table_structure(df.schema))}")
    conversation, turn, role, text = (F.col(f"`{name}`") for name in names)
    return df.select(
        conversation.alias("conversation"),
        turn.cast("long").alias("turn"),
        role.cast("string").alias("role"),
        text.cast("string").alias("text"),
    )


def format_turns(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``(conversation, formatted, loss)``: the text, and its spans under the loss mask.

    Spans are code points, end exclusive. The window and the grouping share one shuffle.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    written = turns.select(
        "conversation",
        F.struct("turn", role.alias("role"), text.alias("text")).alias("order"),
        head.alias("head"),
        escape(text).alias("body"),
        (role == learn_from).alias("learn"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    running = Window.partitionBy("conversation").orderBy("order")
    before = F.sum(F.length("piece").cast("long")).over(
        running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.length("piece")
    start = before + F.length("head")
    placed = written.select(
        "conversation",
        before.alias("at"),
        "piece",
        F.when(
            F.col("learn"), F.struct(start.alias("start"), (start + F.length("body")).alias("end"))
        ).alias("span"),
    )
    gathered = placed.groupBy("conversation").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list("span")).alias("loss"),
    )
    return gathered.select(
        "conversation", F.array_join("pieces.piece", "").alias("formatted"), "loss"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conversation, turns, loss_text, formatted_chars)`` from a formatted text and its
    mask alone."""
    parts = F.split("formatted", r"<\|im_start\|>")
    turns = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda part: F.struct(
            unescape_role(F.substring_index(part, "\n", 1)).alias("role"),
            unescape(_between(part)).alias("text"),
        ),
    )
    masked = F.transform(
        "loss",
        lambda s: unescape(
            F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])
        ),
    )
    return formatted.select(
        "conversation",
        turns.alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(_OPEN), F.lit(_OPEN_ESCAPED))


def unescape(text: Column) -> Column:
    """Between doubled backslashes every backslash is an escape."""
    pieces = F.transform(
        F.split(text, r"\\\\"), lambda x: F.replace(x, F.lit("\\|"), F.lit("|"))
    )
    return F.array_join(pieces, "\\")


def escape_role(role: Column) -> Column:
    """A role ends its line, so its own line ends are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(
        F.split(role, r"\\\\"),
        lambda x: F.replace(
            F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")
        ),
    )
    return F.array_join(pieces, "\\")


def _between(part: Column) -> Column:
    """What stands between the role's line end and the closing control string."""
    head = F.length(F.substring_index(part, "\n", 1)) + 1
    return F.substring(part, head + 1, F.length(part) - head - len(END) - 1)


def _mapped(layout: Fields | Messages) -> Column:
    record = F.col("record")
    if isinstance(layout, Fields):
        said = [
            F.struct(
                F.lit(role).alias("role"),
                F.concat_ws(
                    "\n",
                    *[
                        F.nullif(F.variant_get(record, f"$.{path}", "string"), F.lit(""))
                        for path in paths
                    ],
                ).alias("text"),
            )
            for role, paths in layout.turns
        ]
        return F.array(*said)
    listed = F.variant_get(
        record, f"$.{layout.path}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
    )
    return F.transform(
        listed,
        lambda x: F.struct(
            _renamed(x[layout.role], layout.names).alias("role"), x[layout.text].alias("text")
        ),
    )


def _renamed(role: Column, names: dict) -> Column:
    return reduce(
        lambda other, one: F.when(role == one[0], one[1]).otherwise(other), names.items(), role
    )

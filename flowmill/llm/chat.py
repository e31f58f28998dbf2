"""Chat formatting: heterogeneous conversation layouts to one template with a loss mask, by DataFrame functions only.

A layout is known by the fingerprint of its schema: the SHA-256 of its nested field paths, sorted.  Each fingerprint
selects a declarative :class:`Layout`, which turns a record into canonical turns ``array<struct<role, text>>``.  Records
may be typed columns, JSON texts of mixed layouts, or rows by turn.

The template is ``<|im_start|>`` role LF text ``<|im_end|>`` LF for each turn.  Inside roles and texts, ``\\`` is written
``\\\\``, ``<|`` is written ``<\\|``, and in roles LF is written ``\\n``: no text can contain a control string, and reading
back is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Other layouts' names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How one schema maps to turns.

    ``turns``: a list field with one record a turn, whose ``role`` and ``text`` fields are named; or ``parts``: one field
    for each (role, field) in order, null or absent fields giving no turn; or ``rows``: one row a turn, ordered by a field.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str], ...] = ()
    rows: str | None = None
    key: str | None = None
    optional: tuple[str, ...] = field(default=())

    def path_sets(self) -> list[list[str]]:
        """Each set of field paths that a record of this layout may have."""
        if self.turns:
            return [[f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]]
        if self.rows:
            return [[self.key or "", self.rows, self.role, self.text]]
        sets: list[list[str]] = [[]]
        for _, name in self.parts:
            sets = [[*s, name] for s in sets] + (sets if name in self.optional else [])
        return sets


LAYOUTS = (
    Layout("messages", turns="messages"),
    Layout("conversations", turns="conversations", role="from", text="value"),
    Layout("dialogue", turns="dialogue", role="speaker", text="text"),
    Layout("instruction", parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("prompt", parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", parts=(("user", "question"), ("assistant", "answer"))),
    Layout("turn rows", rows="turn", key="conv_id", text="text"),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known(layouts: Iterable[Layout] = LAYOUTS) -> dict[str, Layout]:
    return {fingerprint(paths): layout for layout in layouts for paths in layout.path_sets()}


def schema_paths(schema: T.StructType) -> list[str]:
    """The leaf field paths of a typed schema."""

    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, at + "[]")
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return [at]

    return [x for f in schema.fields for x in walk(f.dataType, f.name)]


def named_paths(layouts: Iterable[Layout]) -> set[str]:
    return {p for x in layouts for paths in x.path_sets() for p in paths}


def layout_of(df: DataFrame, layouts: Iterable[Layout] = LAYOUTS) -> Layout:
    """The layout that the schema's fingerprint selects; fields that no layout names don't count."""
    layouts = tuple(layouts)
    named = named_paths(layouts)
    paths = [p for p in schema_paths(df.schema) if p in named]
    table = known(layouts)
    if (found := table.get(fingerprint(paths))) is None:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    return found


def _canonical(role: Column, text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.coalesce(role.cast("string"), F.lit(""))
    return F.struct(F.coalesce(F.try_element_at(names, role), role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _parts(fields: list[tuple[str, Column]]) -> Column:
    each = [F.when(c.isNotNull(), _canonical(F.lit(role), c)) for role, c in fields]
    return F.filter(F.array(*each), lambda t: t.isNotNull()).cast(TURNS)


def _listed(items: Column, layout: Layout) -> Column:
    return F.transform(F.coalesce(items, F.array()), lambda t: _canonical(t[layout.role], t[layout.text])).cast(TURNS)


def turns_of(df: DataFrame, layout: Layout | None = None) -> Column:
    """The canonical turns of a typed record layout (not of rows by turn). A null list has no turns."""
    layout = layout or layout_of(df)
    if layout.rows:
        raise ValueError("rows by turn are grouped first, with turns_from_rows")
    if layout.turns:
        return _listed(F.col(layout.turns), layout)
    return _parts([(role, F.col(name)) for role, name in layout.parts if name in df.columns])


def _field_path(value: Column, name: str, path: str) -> Column:
    """``path`` if the variant has a plain value or null under ``name``, ``path.*`` if a list or record, else null."""
    inside = F.try_variant_get(value, f"$.{name}", "variant")
    nested = F.schema_of_variant(inside).rlike("^(ARRAY|OBJECT)<")
    return F.when(inside.isNotNull(), F.when(nested, path + ".*").otherwise(path))


def _item_paths(item: Column, name: str, fields: list[str]) -> Column:
    own = F.filter(F.array(*[_field_path(item, f, f"{name}[].{f}") for f in fields]), lambda p: p.isNotNull())
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(f"{name}[]")))


def _list_paths(value: Column, name: str, fields: list[str]) -> Column:
    items = F.try_variant_get(value, f"$.{name}", "array<variant>")
    listed = F.when(F.size(items) > 0, F.flatten(F.transform(items, lambda item: _item_paths(item, name, fields)))).otherwise(F.array(F.lit(f"{name}[]")))
    return F.when(items.isNotNull(), listed).otherwise(F.array().cast("array<string>"))


def json_paths(value: Column, layouts: Iterable[Layout] = LAYOUTS) -> Column:
    """The nested field paths of a variant that the layouts name, sorted; of other fields nothing.

    An empty list is the path ``name[]``, and so is an item without any named field.  Lists and records where plain values
    belong are paths of their own, which no layout has.
    """
    named = named_paths(layouts)
    plain = F.filter(F.array(*[_field_path(value, name, name) for name in sorted(p for p in named if "[" not in p)]), lambda p: p.isNotNull())
    lists: dict[str, list[str]] = {}
    for name, _, inner in sorted(p.partition("[].") for p in named if "[" in p):
        lists.setdefault(name, []).append(inner)
    return F.array_sort(F.array_distinct(F.concat(plain, *[_list_paths(value, name, fields) for name, fields in lists.items()])))


def turns_from_json(record: Column, layouts: Iterable[Layout] = LAYOUTS) -> Column:
    """``struct<layout, turns>`` of a JSON record, its layout chosen row by row by the fingerprint of its :func:`json_paths`.

    Fields that no layout names don't count, in records and in turns.  Text that isn't JSON, or of an unknown layout, gets a
    null layout and null turns: it is kept for the caller to see.
    """
    layouts = [x for x in layouts if not x.rows]
    value = F.try_parse_json(record)
    shape = F.sha2(F.array_join(json_paths(value, layouts), "\n"), 256)
    out = F.lit(None).cast(f"struct<layout:string,turns:{TURNS}>")
    for layout in layouts:
        for paths in [*layout.path_sets(), *([[f"{layout.turns}[]"]] if layout.turns else [])]:
            if layout.turns:
                items = F.try_variant_get(value, f"$.{layout.turns}", f"array<struct<{layout.role}:string,{layout.text}:string>>")
                turns = _listed(items, layout)
            else:
                turns = _parts([(role, F.try_variant_get(value, f"$.{name}", "string")) for role, name in layout.parts if name in paths])
            here = F.struct(F.lit(layout.name).alias("layout"), turns.alias("turns"))
            out = F.when(shape == fingerprint(paths), here).otherwise(out)
    return out


def turns_from_rows(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """``key, turns`` from rows by turn. Turns are ordered by turn (null first), role and text; rows of a null key are one
    conversation. A conversation is one value of the result, so its rows meet in one task.
    """
    layout = layout or layout_of(rows)
    turn = F.struct(F.col(layout.rows).alias("at"), _canonical(F.col(layout.role), F.col(layout.text)).alias("turn"))
    grouped = rows.groupBy(F.col(layout.key)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(layout.key, F.transform("turns", lambda t: t["turn"]).cast(TURNS).alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(turns: Column, *, loss_role: str = "assistant") -> Column:
    """``struct<formatted, loss_mask>``; the mask has an entry a turn: the span ``<start, length>``, in code points from
    the turn's start marker, of the text that counts for the loss, or null. Null turns give nulls; no turns, ''.
    """
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    pieces = F.transform(turns, lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    spans = F.transform(turns, lambda t: F.when(t["role"] == loss_role, F.struct(F.length(head(t)).alias("start"), F.length(escape(t["text"])).alias("length"))))
    return F.struct(F.array_join(pieces, "").alias("formatted"), spans.alias("loss_mask"))


def _segments(formatted: Column) -> Column:
    """The turns as written, each without its start marker."""
    cut = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(cut, F.lit(2), F.size(cut) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, exactly as they were."""

    def turn(segment: Column) -> Column:
        body = F.substring(segment, F.lit(1), F.length(segment) - len(END))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(_segments(formatted), turn)


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, in order, unescaped."""

    def part(segment: Column, span: Column) -> Column:
        inside = F.substring(segment, span["start"] - len(START) + 1, span["length"])
        return F.when(span.isNull(), "").otherwise(unescape(inside))

    return F.array_join(F.zip_with(_segments(formatted), loss_mask, part), "")

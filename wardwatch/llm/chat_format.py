"""Chat formatting by schema fingerprints.

**Layouts.** A record (JSON, or a row of any table turned into a VARIANT) has nested field paths such as ``.messages[].role``. The
paths that any layout knows are sorted and hashed; the hash selects the layout, a list of rules that say which fields make which turns. Fields
that no layout knows do not count. The registry holds the hash of every combination of a layout's optional fields, and two
layouts with one hash are an error when it is built.

**Template.** A turn is ``start role separator text end``. In role and text a backslash goes into each control string after its first
character and a backslash becomes two, so no control string is left, and dropping each escaping backslash restores the text. The loss mask is
a list of spans (code points) over the formatted text: the texts of the trained roles, without any mark.

Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Levels of nesting that are looked into.
DEPTH = 6
#: Other names of roles in layouts that say so.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class One:
    """One turn of a fixed role from scalar fields, which are joined by an empty line; absent and empty ones are skipped."""

    role: str
    fields: tuple[str, ...]
    #: Fields that may be absent. If all are, or all are null, there is no turn; otherwise a null text is an empty one.
    optional: tuple[str, ...] = ()

    def choices(self) -> list[list[tuple[str, ...]]]:
        return [[(f".{f}",), ()] if f in self.optional else [(f".{f}",)] for f in self.fields]

    def turns(self, record: Column) -> Column:
        texts = F.array_compact(F.array(*[F.try_variant_get(record, f"$.{f}", "string") for f in self.fields]))
        turn = F.struct(F.lit(self.role).alias("role"), F.array_join(F.filter(texts, lambda x: x != ""), "\n\n").alias("text"))
        if set(self.optional) < set(self.fields):
            return F.array(turn)
        return F.when(F.size(texts) > 0, F.array(turn)).otherwise(F.array().cast(TURNS))


@dataclass(frozen=True)
class Many:
    """A turn per element of a list, in its order. Null roles and texts are empty."""

    field: str
    role: str
    text: str
    #: The text may be a list of objects, whose fields of this name are joined by newlines.
    parts: str = ""
    renamed: bool = False

    def choices(self) -> list[list[tuple[str, ...]]]:
        item = f".{self.field}[]"
        texts = [(f"{item}.{self.text}",)]
        if self.parts:
            part = f"{item}.{self.text}[].{self.parts}"
            texts += [(part,), (f"{item}.{self.text}", part)]
        return [[(item,), *[(f"{item}.{self.role}", *t) for t in texts]]]

    def turns(self, record: Column) -> Column:
        def turn(item: Column) -> Column:
            role = F.coalesce(F.try_variant_get(item, f"$.{self.role}", "string"), F.lit(""))
            if self.renamed:
                names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
                role = F.coalesce(F.try_element_at(names, role), role)
            text = F.try_variant_get(item, f"$.{self.text}", "string")
            if self.parts:
                parts = F.try_variant_get(item, f"$.{self.text}", "array<variant>")
                listed = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, f"$.{self.parts}", "string"), F.lit("")))
                text = F.when(parts.isNotNull(), F.array_join(listed, "\n")).otherwise(text)
            return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        return F.transform(F.try_variant_get(record, f"$.{self.field}", "array<variant>"), turn)


@dataclass(frozen=True)
class Layout:
    name: str
    rules: tuple[One | Many, ...]

    def path_sets(self) -> set[tuple[str, ...]]:
        """Sorted paths of every combination of what may be absent."""
        choices = [c for rule in self.rules for c in rule.choices()]
        return {tuple(sorted({p for paths in picked for p in paths})) for picked in product(*choices)} - {()}

    def turns(self, record: Column) -> Column:
        return F.concat(*[rule.turns(record).cast(TURNS) for rule in self.rules])


_SYSTEM = One("system", ("system",), ("system",))
LAYOUTS = (
    Layout("messages", (Many("messages", "role", "content", parts="text"),)),
    Layout("turn_rows", (Many("messages", "role", "text"),)),
    Layout("from_value", (_SYSTEM, Many("conversations", "from", "value", renamed=True))),
    Layout("instruction", (_SYSTEM, One("user", ("instruction", "input"), ("input",)), One("assistant", ("output",)))),
    Layout("prompt_completion", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("prompt_response", (_SYSTEM, One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("question_answer", (_SYSTEM, One("user", ("context", "question"), ("context",)), One("assistant", ("answer",)))),
    Layout("prompt_messages", (One("user", ("prompt",)), Many("messages", "role", "content", parts="text"))),
)


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Registry:
    """Fingerprints of all layouts and the paths that any of them knows."""

    def __init__(self, layouts: Sequence[Layout] = LAYOUTS):
        self.layouts = tuple(layouts)
        self.by_fingerprint: dict[str, str] = {}
        known: set[str] = set()
        for layout in self.layouts:
            for paths in layout.path_sets():
                known.update(paths)
                name = self.by_fingerprint.setdefault(fingerprint_of(paths), layout.name)
                if name != layout.name and not self._both_empty(paths):
                    raise ValueError(f"layouts {name} and {layout.name} have the same paths {paths}")
        self.known = sorted(known)

    @staticmethod
    def _both_empty(paths: Sequence[str]) -> bool:
        """A list without elements has no turns in any layout."""
        return all(p.endswith("[]") for p in paths)

    def fingerprint(self, record: Column) -> Column:
        known = F.array(*[F.lit(p) for p in self.known])
        return F.sha2(F.array_join(F.array_sort(F.array_intersect(field_paths(record), known)), "\n"), 256)

    def layout(self, fingerprint: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in self.by_fingerprint.items() for x in pair])
        return F.try_element_at(names, fingerprint)

    def turns(self, layout: Column, record: Column) -> Column:
        out = F.lit(None).cast(TURNS)
        for one in self.layouts:
            out = F.when(layout == one.name, one.turns(record)).otherwise(out)
        return out


def field_paths(record: Column, depth: int = DEPTH) -> Column:
    """Paths of the leaves of a VARIANT: ``.name`` for a field, ``[]`` for the elements of a list, whatever their order and number."""
    leaf = F.array(F.lit(""))
    if not depth:
        return leaf
    fields, items = F.try_variant_get(record, "$", "map<string,variant>"), F.try_variant_get(record, "$", "array<variant>")
    # An empty list has one leaf: the list itself.
    some = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(None).cast("variant")))
    below = F.transform(
        F.map_entries(fields), lambda e: F.transform(field_paths(e["value"], depth - 1), lambda p: F.concat(F.lit("."), e["key"], p))
    )
    inside = F.transform(F.array_distinct(F.flatten(F.transform(some, lambda e: field_paths(e, depth - 1)))), lambda p: F.concat(F.lit("[]"), p))
    return F.when(fields.isNotNull(), F.flatten(below)).when(items.isNotNull(), inside).otherwise(leaf)


def canonical(records: DataFrame, record: str = "record", registry: Registry | None = None) -> DataFrame:
    """Records (VARIANT column ``record``) with fingerprint, layout, and turns in place of it.

    A record of no known layout, which includes null, scalars, and empty objects, keeps its row with null layout and turns.
    """
    registry = registry or Registry()
    out = records.withColumn("fingerprint", registry.fingerprint(F.col(record)))
    out = out.withColumn("layout", registry.layout(F.col("fingerprint")))
    return out.withColumn("turns", registry.turns(F.col("layout"), F.col(record))).drop(record)


def json_records(table: DataFrame, column: str) -> DataFrame:
    """A JSON text per row as ``record``; a text that is no JSON is a null record."""
    return table.withColumn("record", F.try_parse_json(F.col(column)))


def row_records(rows: DataFrame) -> DataFrame:
    """One record per conversation from a row per turn (conv_id, turn, role, text): conv_id, record.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat are turns of their own. A row without a conv_id is a conversation
    of its own, so no group collects them. A conversation is one output text, and so one row.
    """
    rows = rows.select("conv_id", F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("m"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("m").alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return grouped.unionByName(alone).select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


@dataclass(frozen=True)
class Template:
    """Marks around role and text, and other control strings that texts must not hold either.

    Each begins with ``<`` or ``[``, ends with ``>`` or ``]``, and has none of the four inside, so none can lie across a border.
    """

    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|eot_id|>")
    trained: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.start, self.separator, self.end, *self.foreign)

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls():
            text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
        return text

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


TEMPLATE = Template()


def formatted(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Turns (column ``turns``) as ``formatted`` text with ``loss_spans`` (start, length in code points, in order). Null turns give nulls."""
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            template.escaped(t["role"]).alias("role"), template.escaped(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")
        ),
    )
    s, x, e = (F.lit(m) for m in (template.start, template.separator, template.end))
    out = chats.withColumn("pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(s, p["role"], x, p["text"], e)), ""))
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    marks = len(template.start) + len(template.separator)

    def step(state: Column, p: Column) -> Column:
        start, length = state["at"] + marks + F.length(p["role"]), F.length(p["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(template.end)).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return out.withColumn("loss_spans", F.aggregate("pieces", first, step, lambda state: state["spans"])).drop("pieces", "turns")


def read_back(table: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What ``formatted`` and ``loss_spans`` say: ``turns`` again, and ``loss_text``, the text under the mask."""

    def quoted(mark: str) -> str:
        return r"\Q" + mark + r"\E"

    def turn(segment: Column) -> Column:
        halves = F.split(segment, quoted(template.separator), -1)
        role = F.substring(F.get(halves, F.lit(0)), len(template.start) + 1, 2**31 - 1)
        return F.struct(template.unescaped(role).alias("role"), template.unescaped(F.get(halves, F.lit(1))).alias("text"))

    segments = F.split("formatted", quoted(template.end), -1)
    out = table.withColumn("turns", F.transform(F.slice(segments, 1, F.size(segments) - 1), turn))
    text = F.transform("loss_spans", lambda s: template.unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return out.withColumn("loss_text", F.array_join(text, ""))


def digests(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digest columns of formatted conversations, all read back from the output; the other columns stay."""
    back = read_back(chats, template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumns(
        {
            "n_turns": F.size("turns").cast("long"),
            "turns_sha256": F.sha2(said, 256),
            "loss_chars": F.length("loss_text").cast("long"),
            "loss_sha256": F.sha2("loss_text", 256),
            "formatted_chars": F.length("formatted").cast("long"),
        }
    ).drop("turns", "loss_text", "formatted", "loss_spans")

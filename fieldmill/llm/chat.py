"""Chat formatting: records of unlike layouts become canonical turns, and turns become one marked text.

A record's layout is told by its fingerprint: a hash of the sorted paths of its nested fields. Each
known fingerprint selects a declarative mapping from field paths to turns. Records are JSON text, so that one table may
mix layouts row by row, or structs, whose paths are those of their schema and whose texts are taken as they are, without a JSON reader's limits.

Template, for each turn:  <|turn|>ROLE<|says|>TEXT<|over|>
In roles and texts & becomes &amp; and < becomes &lt; so no mark can appear inside them, whatever they
say; reading back undoes the two in the opposite order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
#: Characters of one text that Spark's JSON reader takes (fixed value).
MOST_JSON = 20_000_000
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout's field paths ('messages[].role' for fields inside a list) and how they give turns.

    turns: (role, path) pairs for flat layouts, where parts of one turn are joined by blank lines;
    or items: (list path, role field, text field, role names to canonical ones) for message lists.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None

    @property
    def text(self) -> str:
        return "|".join(sorted(self.paths))


#: Role words of common layouts and the canonical role of each.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("dialog", ("turns[].speaker", "turns[].text"), items=("turns", "speaker", "text")),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", ("answer", "question"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt", ("prompt", "response", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object: top-level names, or name[].field for lists of objects.

    Values keep their kind, so a string that itself reads as a list is a string.
    """
    fields = F.try_variant_get(F.try_parse_json(record), "$", "map<string,variant>")

    def inside(name: Column, value: Column) -> Column:
        names = F.flatten(F.transform(F.try_variant_get(value, "$", "array<map<string,variant>>"), F.map_keys))
        found = F.transform(F.array_distinct(names), lambda f: F.concat(name, F.lit("[]."), f))
        return F.when(F.size(found) > 0, found).otherwise(F.array(name))

    return F.array_sort(F.flatten(F.transform(F.map_entries(fields), lambda e: inside(e["key"], e["value"]))))


def fingerprint(record: Column) -> Column:
    """Hash of the layout of a JSON record, alike for all records with the same field paths."""
    return F.xxhash64(F.array_join(field_paths(record), "|"))


def canonical_role(role: Column, names: dict[str, str] | None = None) -> Column:
    known = ROLES if names is None else names
    out = role
    for word, canonical in known.items():
        out = F.when(role == word, canonical).otherwise(out)
    return out


def _items(rows: Column, role: str, text: str, roles: dict[str, str] | None) -> Column:
    said = lambda m, field: F.coalesce(m[field], F.lit(""))
    return F.transform(rows, lambda m: F.struct(canonical_role(said(m, role), roles).alias("role"), said(m, text).alias("text")))


def canonical_turns(record: Column, print_col: Column, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] | None = None) -> Column:
    """Turns of a record under the mapping its fingerprint selects; null for an unknown layout."""
    at = lambda path: F.get_json_object(record, f"$.{path}")
    out = F.lit(None).cast(TURNS_TYPE)
    for layout in layouts:
        if layout.items:
            path, role, text = layout.items
            rows = F.from_json(at(path), f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = _items(rows, role, text, roles)
        else:
            said = [F.struct(F.lit(who).alias("role"), F.array_join(F.filter(F.array(*(F.coalesce(at(p), F.lit("")) for p in parts)), lambda x: x != ""), "\n\n").alias("text")) for who, parts in layout.turns]
            turns = F.array(*said)
        out = F.when(print_col == F.xxhash64(F.lit(layout.text)), turns).otherwise(out)
    return out


def schema_paths(kind: StructType) -> list[str]:
    """Sorted nested field paths of a struct, as field_paths gives them for JSON."""
    out = []
    for f in kind.fields:
        inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else None
        out += [f"{f.name}[].{g.name}" for g in inner.fields] if isinstance(inner, StructType) else [f.name]
    return sorted(out)


def struct_turns(record: Column, kind: StructType, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] | None = None) -> Column:
    """Turns of a struct under the mapping that its schema's fingerprint selects; null for an unknown layout."""
    name = "|".join(schema_paths(kind))
    for layout in layouts:
        if layout.text == name and layout.items:
            path, role, text = layout.items
            return _items(record[path], role, text, roles)
        if layout.text == name:
            parts = lambda paths: F.filter(F.array(*(F.coalesce(record[p].cast("string"), F.lit("")) for p in paths)), lambda x: x != "")
            said = [F.struct(F.lit(who).alias("role"), F.array_join(parts(paths), "\n\n").alias("text")) for who, paths in layout.turns]
            return F.when(record.isNotNull(), F.array(*said))
    return F.lit(None).cast(TURNS_TYPE)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] | None = None, learn_from: str = "assistant") -> DataFrame:
    """Format records, JSON text or structs: conv_id, layout fingerprint, turns, formatted text, loss spans, and `problem`.

    loss_spans holds (start, length) in code points of the formatted text, 0-based, one for each text of
    role `learn_from`, in order. A record that is null, no JSON object, or of an unknown layout keeps
    its row with null turns, formatted text and spans, and `problem` says which. So does a JSON record that Spark's reader can't
    take because a text in it has over 20 million characters; structs have no such limit. A record without turns formats to an empty text.
    Null roles and texts inside a record count as empty. Texts are kept whole; repeated rows give repeated
    rows; an empty table gives none. Other columns of the table are ignored, whatever their names.
    """
    kind = records.schema[record_col].dataType
    if isinstance(kind, StructType):
        read = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("_record"))
        read = read.withColumn("layout", F.when(F.col("_record").isNotNull(), F.xxhash64(F.lit("|".join(schema_paths(kind))))))
        read = read.withColumn("turns", struct_turns(F.col("_record"), kind, layouts, roles))
        long = F.lit(False)
    else:
        read = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).cast("string").alias("_record"))
        read = read.withColumn("layout", fingerprint(F.col("_record")))
        read = read.withColumn("turns", canonical_turns(F.col("_record"), F.col("layout"), layouts, roles))
        long = F.length("_record") > MOST_JSON
    problem = F.when(F.col("turns").isNotNull(), None).when(F.col("_record").isNull(), "null record").when(long, "over the JSON reader's limit").otherwise("unknown layout")
    read = read.withColumn("problem", problem.cast("string"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn_from).alias("learn")))
    read = read.withColumn("_parts", parts)
    step = lambda s, p: F.struct((s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(OVER)).cast("long").alias("at"), F.when(p["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(s["spans"]).alias("spans"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return read.select(
        "conv_id", "layout", "turns",
        F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(OVER))), "").alias("formatted"),
        F.aggregate("_parts", empty, step, lambda s: s["spans"]).alias("loss_spans"), "problem",
    )


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text, raw text)."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    role = lambda p: F.substring_index(p, SAYS, 1)
    body = lambda p: F.substring_index(F.substring_index(p, SAYS, -1), OVER, 1)
    return F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(body(p)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts that the loss spans cover, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))

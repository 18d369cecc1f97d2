"""Chats of many layouts as one: layouts known by a hash of their field paths, turns marked by a template that can be read back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common templates, without their first character.
CONTROL = r"/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_-]+\|>"
TRAINED = "assistant"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping from a record's fields to turns.

    ``fields`` gives turns of one text each, (role, text paths), the texts of one turn joined by an
    empty line; turns whose texts are all null or missing are left out, save the last of a layout
    without lists. ``lists`` gives lists of messages, (list path, role field, text field), whose
    turns follow in order. ``roles`` renames roles of lists; others stay as they are.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    lists: tuple[tuple[str, str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return (*(p for _, ps in self.fields for p in ps), *(f"{name}[].{x}" for name, *both in self.lists for x in both))

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


RENAMED = (("human", "user"), ("gpt", "assistant"), ("model", "assistant"), ("bot", "assistant"))


def _asked(name: str, question: tuple[str, ...], answer: str) -> Layout:
    return Layout(name, (("user", question), ("assistant", (answer,))))


_PLAIN = (
    Layout("messages", lists=(("messages", "role", "content"),), roles=RENAMED),
    Layout("messages_text", lists=(("messages", "role", "text"),), roles=RENAMED),
    Layout("messages_from", lists=(("messages", "from", "content"),), roles=RENAMED),
    Layout("messages_value", lists=(("messages", "from", "value"),), roles=RENAMED),
    Layout("conversations", lists=(("conversations", "from", "value"),), roles=RENAMED),
    Layout("conversations_content", lists=(("conversations", "role", "content"),), roles=RENAMED),
    Layout("prompt_completion_lists", lists=(("prompt", "role", "content"), ("completion", "role", "content")), roles=RENAMED),
    _asked("prompt_completion", ("prompt",), "completion"),
    _asked("prompt_response", ("prompt",), "response"),
    _asked("instruction", ("instruction",), "output"),
    _asked("instruction_input", ("instruction", "input"), "output"),
    _asked("input_output", ("input",), "output"),
    _asked("question_answer", ("question",), "answer"),
)
#: Every layout without and with a field for the system's text, which comes first.
LAYOUTS = (*_PLAIN, *(replace(x, name=f"system_{x.name}", fields=(("system", ("system",)), *x.fields)) for x in _PLAIN))


def fingerprint_of(paths) -> str:
    """The hash that names a set of nested field paths, whatever their order; ``[]`` stands for the elements of a list."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """The leaf paths of a column's type; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


def _shape(layout: Layout) -> T.StructType:
    """The type of a layout's records."""
    text = T.StringType()
    item = lambda *names: T.ArrayType(T.StructType([T.StructField(x, text) for x in names]))
    return T.StructType([*(T.StructField(p, text) for _, ps in layout.fields for p in ps), *(T.StructField(name, item(*both)) for name, *both in layout.lists)])


TURNS = "array<struct<role:string,text:string>>"


def _turns(layout: Layout, field: Callable[[str], Column], items: Callable[[str], Column], part: Callable[[Column, str], Column]) -> Column:
    """A record's turns, array<struct<role, text>>, by what gives a field's text, a list, and a field of one of its items."""
    turn = lambda r, t: F.struct(F.coalesce(r, F.lit("")).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    made = []
    for i, (role, ps) in enumerate(layout.fields):
        texts = [field(p).cast("string") for p in ps]
        always = not layout.lists and i == len(layout.fields) - 1
        made.append(F.when(F.coalesce(*texts).isNotNull() | F.lit(always), turn(F.lit(role), F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts]))))
    parts = [F.filter(F.array(*made), lambda t: t.isNotNull())] if made else []

    def renamed(role: Column) -> Column:
        out = role
        for old, new in layout.roles:
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    def said(name: str, role: str, text: str) -> Column:
        made = F.transform(items(name), lambda m: turn(renamed(part(m, role).cast("string")), part(m, text).cast("string")))
        return F.coalesce(made, F.array().cast(TURNS))

    return F.concat(*parts, *[said(*x) for x in layout.lists])


def _lists(layouts) -> list[str]:
    return sorted({name for x in layouts for name, *_ in x.lists})


def _known(layouts) -> list[str]:
    """The paths that layouts name, and those of their lists where these are empty."""
    return sorted({p for x in layouts for p in x.paths} | {f"{name}[]" for name in _lists(layouts)})


def json_parts(text: Column, lists: list[str]) -> Column:
    """struct(fields, lists) of a JSON record: each field's text by its name, and those of ``lists`` that are lists of objects, as maps. Two readings of the text serve all layouts."""
    kind = ", ".join(f"`{name}` array<map<string,string>>" for name in lists)
    fields = F.from_json(text, "map<string,string>")
    listed = F.when(fields.isNotNull(), F.from_json(text, kind)) if lists else F.lit(None)
    return F.struct(fields.alias("fields"), listed.alias("lists"))


def json_paths(parts: Column, lists: list[str]) -> Column:
    """The field paths of a JSON record read by json_parts(), ``field`` or ``list[].field``, or ``list[]`` for an empty list; null if it is no JSON object.

    Only values that are lists are read as such, so that texts may look like lists, names may hold
    any character and values any nesting. Null and absent fields differ, as paths do.
    """
    paths = F.filter(F.map_keys(parts["fields"]), lambda k: ~k.isin(*lists)) if lists else F.map_keys(parts["fields"])

    def of_list(name: str) -> Column:
        items = parts["lists"][name]
        inner = F.array_distinct(F.flatten(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.map_keys(x))))
        found = F.when(F.size(items) == 0, F.array(F.lit(f"{name}[]"))).when(F.size(inner) > 0, F.transform(inner, lambda k: F.concat(F.lit(f"{name}[]."), k)))
        has = F.map_contains_key(parts["fields"], F.lit(name))
        return F.when(has, F.coalesce(found, F.array(F.lit(name)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(paths, *map(of_list, lists)))


def json_fingerprint(parts: Column, layouts=LAYOUTS) -> Column:
    """The fingerprint of a JSON record read by json_parts(): the hash of those of its paths that some layout names; null if there are none.

    Other fields, as ids and metadata, leave it alone.
    """
    named = F.array_sort(F.array_intersect(json_paths(parts, _lists(layouts)), F.lit(_known(layouts))))
    return let(named, lambda found: F.when(F.size(found) > 0, F.substring(F.sha2(F.array_join(found, "\n").cast("binary"), 256), 1, 16)))


def mappings(layouts=LAYOUTS) -> dict[str, Layout]:
    """The layout for each fingerprint that records may have: of its own paths, of an empty list, and of its own with those of one other.

    Of two layouts in one record that with more paths is taken, the first of equals.
    """
    out: dict[str, Layout] = {}
    empty = lambda x: [f"{name}[]" for name, *_ in x.lists]
    texts = lambda x: [p for _, ps in x.fields for p in ps]
    for x in layouts:
        out.setdefault(x.fingerprint, x)
    for x in layouts:
        if x.lists:
            out.setdefault(fingerprint_of([*texts(x), *empty(x)]), x)
    for x in sorted(layouts, key=lambda x: -len(x.paths)):
        for y in layouts:
            for more in (y.paths, empty(y), *([p] for p in y.paths)):
                out.setdefault(fingerprint_of([*x.paths, *more]), x)
    return out


MAPPING = "array<struct<print: string, layout: string, fields: array<struct<role: string, paths: array<string>>>, lists: array<struct<path: string, role: string, text: string>>, roles: map<string,string>>>"


def mapping_table(spark: SparkSession, layouts=LAYOUTS) -> DataFrame:
    """mappings() as a table with a row for each fingerprint, (print, layout, fields, lists, roles); its size depends on the layouts alone."""
    rows = [
        {"print": print_, "layout": x.name, "fields": [{"role": r, "paths": ps} for r, ps in x.fields], "lists": [dict(zip(("path", "role", "text"), y, strict=True)) for y in x.lists], "roles": dict(x.roles)}
        for print_, x in mappings(layouts).items()
    ]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), MAPPING)))


def _mapped(parts: Column, listed: list[str]) -> Column:
    """A JSON record's turns by the mapping that stands in columns ``fields``, ``lists`` and ``roles`` beside it."""
    turn = lambda r, t: F.struct(F.coalesce(r, F.lit("")).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    by_name = F.create_map(*[x for name in listed for x in (F.lit(name), parts["lists"][name])]) if listed else F.lit(None).cast("map<string,array<map<string,string>>>")

    def of_field(f: Column, i: Column) -> Column:
        texts = F.filter(F.transform(f["paths"], lambda p: F.try_element_at(parts["fields"], p)), lambda t: t.isNotNull())
        always = (F.size("lists") == 0) & (i == F.size("fields") - 1)
        return F.when((F.size(texts) > 0) | always, turn(f["role"], F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")))

    def of_list(x: Column) -> Column:
        role = lambda m: F.try_element_at(m, x["role"])
        return F.coalesce(F.transform(F.try_element_at(by_name, x["path"]), lambda m: turn(F.coalesce(F.try_element_at(F.col("roles"), role(m)), role(m)), F.try_element_at(m, x["text"]))), F.array().cast(TURNS))

    return F.concat(F.filter(F.transform("fields", of_field), lambda t: t.isNotNull()), F.flatten(F.transform("lists", of_list)))


def to_turns(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """(id, turn, role, text, layout): a row for each turn of each record.

    ``record_col`` is a struct, whose layout is known from the column's type, or a string of JSON,
    whose layout is known from each row's own fingerprint; fields that no layout names are passed
    over. Records of no known layout, broken JSON and nulls give one row with null turn, role, text
    and layout, and empty lists one with the layout alone, so that no record is lost.
    """
    kind = records.schema[record_col].dataType
    id_, record = F.col(id_col), F.col(record_col)
    if isinstance(kind, T.StructType):
        by_print, known = mappings(layouts), set(_known(layouts))
        found = by_print.get(fingerprint_of(known & set(paths_of(kind))))
        has = {f.name for f in kind}
        get = lambda name: record[name] if name in has else F.lit(None)
        turns = F.when(record.isNotNull(), _turns(found, get, get, lambda m, x: m[x])) if found else F.lit(None).cast(TURNS)
        name = F.when(record.isNotNull(), F.lit(found.name)) if found else F.lit(None).cast("string")
        base = records.select(id_.alias("id"), name.alias("layout"), turns.alias("turns"))
    else:
        listed = _lists(layouts)
        read = records.select(id_.alias("id"), json_parts(record, listed).alias("parts"))
        told = read.select("id", "parts", json_fingerprint(F.col("parts"), layouts).alias("print"))
        base = told.join(F.broadcast(mapping_table(records.sparkSession, layouts)), "print", "left").select("id", "layout", F.when(F.col("layout").isNotNull(), _mapped(F.col("parts"), listed)).alias("turns"))
    return base.select("id", "layout", F.posexplode_outer("turns").alias("turn", "t")).select("id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def escape(text: Column) -> Column:
    """The text with a backslash after the first character of each control string, and one more where some already follow it."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _role_out(role: Column) -> Column:
    """A role in one line."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_turns(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """(id, formatted, loss): a text for each id with its turns in order, and the spans of it to train on.

    A turn is ``<|im_start|>`` with its role, a line feed, its text, ``<|im_end|>`` and a line
    feed; control strings within texts and roles are escaped. ``loss`` lists (start, length) in
    code points of the texts, as escaped, of turns with role ``trained``. Null roles and texts are
    empty; rows in which turn, role and text are all null stand for a record without turns. Null
    turn numbers come first; equal ones are ordered by role, then text. Lengths are summed over rows, before the rows of an id, which make up one
    value of the result, are gathered.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(BEGIN), _role_out(role), F.lit("\n"))
    there = F.coalesce(F.col("turn").cast("string"), F.col("role"), F.col("text")).isNotNull()
    rows = turns.select("id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body"), there.alias("there"))
    whole = F.when(F.col("there"), F.concat("head", "body", F.lit(END)))
    rows = rows.withColumn("whole", whole)
    order = W.partitionBy("id").orderBy("turn", "role", "text")
    ahead = F.coalesce(F.sum(F.length("whole")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("id", "there", "whole", F.row_number().over(order).alias("n"), (ahead + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == trained).alias("trained"))
    parts = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("n", "whole", "start", "length", "trained")))).alias("p"))
    spans = F.transform(F.filter("p", lambda p: p["trained"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return parts.select("id", F.array_join(F.transform("p", lambda p: p["whole"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>: the inverse of format_turns() for one id."""
    marks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x.startswith(BEGIN))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(BEGIN) + 1))
        cut = F.instr(body, F.lit("\n"))
        return F.struct(_role_in(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(marks, turn)


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped span by span, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over all of ``conversations`` and one more.

    Each row of the table becomes a JSON record with one message, of one of three layouts by its
    conversation, with fields that no layout names; the added conversation is a record of prompt
    and completion. Each is told by its own fingerprint. Roles stay as the table has them. Rows of
    null turns come first in their conversation.
    """
    layouts = tuple(replace(x, roles=()) for x in LAYOUTS)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role, text, way = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    records = [
        F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("from"), text.alias("value"), F.struct(F.col("turn").alias("at")).alias("meta"))).alias("conversations"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("text"))).alias("messages"), F.array("turn").alias("turns"))),
    ]
    record = F.when(way == 0, records[0]).when(way == 1, records[1]).otherwise(records[2])
    told = to_turns(table.select(F.struct("conv_id", "turn").alias("at"), record.alias("record")), "at", "record", layouts)
    rows = told.select(F.col("id.conv_id").alias("id"), F.col("id.turn").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.to_json(F.struct(F.lit(odd).alias("prompt"), F.lit(odd).alias("completion"))).alias("record"))
    made = format_turns(rows.unionByName(to_turns(extra, "id", "record", layouts).select("id", "turn", "role", "text")))
    told = made.select("id", "formatted", parse(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss")).alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL of op5_chat: digests straight from the turns, the formatted length from the escaped texts.
OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 12 + length(role) + 1 + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_-]+\|>)', '\1\\\2\3', 'g')) + 11 AS chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

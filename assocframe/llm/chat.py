"""Chat formatting with schema fingerprints.

Records of chats come as JSON in layouts of many makes. A record's fingerprint
is a hash of its nested field paths, over all elements of its arrays and down to
DEPTH levels (what lies deeper is one more path, which no mapping has); it
selects a declarative mapping, and the mapping says where the turns are. Canonical turns, (role, text) in order, are
then written with a template that marks turns, and read back from it.

Control strings inside roles and texts are escaped so that the markers can't
occur in them: `\\` is written `\\b` and `<|` is written `\\p`, and in roles a line
feed is written `\\n`. Each code letter stands behind a backslash that stands
nowhere else, so plain replacements undo it. The loss mask is the list of spans
(start and length in code points) of the assistants' texts.

Nulls: a null text is empty, a null role is `unknown`. Turns are ordered by
turn, then role and text; equal turns repeat. A record whose fingerprint has no
mapping, or that is no JSON object, keeps null turns; unmapped() counts such by
fingerprint. Texts may be as long as a string can be: the JSON reader's own
limit of 20,000,000 characters is lifted. A chat is one row, so a chat must fit a
task. An empty table gives an empty result. Columns that are added (fingerprint,
turns, formatted, loss, read_turns, loss_texts) replace those of the same name.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
#: Levels of a record whose field paths are told apart.
DEPTH = 5
#: The JSON reader gives up silently on longer strings than this.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns. paths: all its field paths, with [] for
    the elements of an array. Either `turns` is an array's path with the fields
    `role` and `text` of its elements, or `fields` lists (role, path) in order;
    paths in `optional` give no turn when they are empty or null."""

    paths: tuple[str, ...]
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprint(self) -> Column:
        return _hash(F.array_sort(F.array(*[F.lit(p) for p in self.paths])))


MAPPINGS = (
    Mapping(("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping(("system", "prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("messages", "messages[].content", "messages[].role"), turns="messages"),
    Mapping(("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
)


def _hash(paths: Column) -> Column:
    return F.substring(F.sha2(F.array_join(paths, "\n").cast("binary"), 256), 1, 16)


def _read(record: Column, schema: str) -> Column:
    return F.from_json(record, schema, _ANY_LENGTH)


def paths(record: Column) -> Column:
    """The sorted distinct field paths of a JSON record: its fields and those of
    objects in them, with [] for the elements of an array. One level at a time:
    `todo` has the values whose fields are still to be listed."""
    nodes = "array<struct<path:string,value:string,field:boolean>>"

    def below(s: Column) -> Column:
        dot = F.when(s["path"] == "", "").otherwise(".")
        # as variants, texts keep their quotes and so aren't taken for what they hold; values beyond a variant's bound are read as strings
        known = F.transform_values(_read(s["value"], "map<string,variant>"), lambda k, x: F.to_json(x))
        parts = F.transform(_read(s["value"], "array<variant>"), lambda x: F.to_json(x))
        fields = F.transform(F.map_entries(F.coalesce(known, _read(s["value"], "map<string,string>"))), lambda e: F.struct(F.concat(s["path"], dot, e["key"]).alias("path"), e["value"].alias("value"), F.lit(True).alias("field")))
        items = F.transform(F.coalesce(parts, _read(s["value"], "array<string>")), lambda x: F.struct(F.concat(s["path"], F.lit("[]")).alias("path"), x.alias("value"), F.lit(False).alias("field")))
        return F.coalesce(F.when(F.startswith(s["value"], F.lit("{")), fields).when(F.startswith(s["value"], F.lit("[")), items), F.array().cast(nodes)).cast(nodes)

    def level(state: Column, _: Column) -> Column:
        found = F.flatten(F.transform(state["todo"], below))
        return _let(found, lambda f: F.struct(f.alias("todo"), F.array_distinct(F.concat(state["done"], F.transform(F.filter(f, lambda x: x["field"]), lambda x: x["path"]))).alias("done")))

    start = F.struct(F.array(F.struct(F.lit("").alias("path"), F.ltrim(record).alias("value"), F.lit(False).alias("field"))).cast(nodes).alias("todo"), F.array().cast("array<string>").alias("done"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, level)
    deeper = lambda st: F.exists(st["todo"], lambda x: F.startswith(x["value"], F.lit("{")) | F.startswith(x["value"], F.lit("[")))
    return _let(state, lambda st: F.array_sort(F.concat(st["done"], F.when(deeper(st), F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def fingerprint(record: Column) -> Column:
    return _hash(paths(record))


def canonical(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with `fingerprint` and `turns`, an array of (role, text)."""
    out = records.withColumn("fingerprint", fingerprint(F.col(record)))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        turns = F.when(F.col("fingerprint") == m.fingerprint(), _mapped(m, F.col(record))).otherwise(turns)
    return out.withColumn("turns", turns)


def unmapped(chats: DataFrame) -> DataFrame:
    """(fingerprint, records): how many of canonical()'s records have no mapping."""
    return chats.where("turns is null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))


def _mapped(m: Mapping, record: Column) -> Column:
    """The turns of a record of m's layout."""
    if m.turns:
        found = _read(record, f"`{m.turns}` array<struct<`{m.role}`:string,`{m.text}`:string>>")[m.turns]
        names = F.create_map(*[F.lit(x) for pair in m.roles for x in pair]) if m.roles else None
        named = lambda r: r if names is None else F.coalesce(names[r], r)
        return F.transform(found, lambda x: _turn(named(x[m.role]), x[m.text]))
    row = _read(record, ", ".join(f"`{p}` string" for p in dict.fromkeys(p for _, p in m.fields)))
    made = F.array(*[_turn(F.lit(r), row[p]) if p not in m.optional else F.when(row[p] != "", _turn(F.lit(r), row[p])) for r, p in m.fields])
    return F.filter(made, lambda x: x.isNotNull()) if m.optional else made


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\p"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\n"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\n"), F.lit("\n")))


def format_turns(chats: DataFrame, turns: str = "turns") -> DataFrame:
    """chats with `formatted` and `loss`, the spans of the assistants' texts."""
    parts = F.transform(F.col(turns), lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("text")))
    held = "_parts"
    while held in chats.columns:
        held += "_"
    out = chats.withColumn(held, parts)

    def next_span(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["head"])
        span = F.array(F.struct(at.alias("start"), F.length(p["text"]).alias("length")))
        return F.struct((at + F.length(p["text"]) + len(END)).alias("at"), F.when(p["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    loss = F.aggregate(F.col(held), zero, next_span, lambda s: s["spans"])
    return out.withColumn("formatted", F.array_join(F.transform(held, lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")).withColumn("loss", loss).drop(held)


def read_back(chats: DataFrame, formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """chats with `read_turns`, parsed from the formatted text alone, and
    `loss_texts`, the unescaped texts under the mask."""
    pieces = F.filter(F.split(F.col(formatted), r"<\|im_end\|>\n"), lambda x: x.startswith(START))
    cut = F.transform(pieces, lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x)))
    turns = F.transform(cut, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text")))
    texts = F.transform(F.col(loss), lambda s: unescape(F.substring(F.col(formatted), s["start"] + 1, s["length"])))
    return chats.withColumn("read_turns", turns).withColumn("loss_texts", texts)


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows by turn. A chat of one question and one
    answer becomes a prompt and a response, one that starts with a system text
    and goes on so has that too, any other is a list of messages."""
    named = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    chats = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    are = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    text = lambda i: F.get("m", F.lit(i))["content"]
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(are("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .otherwise(F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))))
    )
    return chats.select("conv_id", record.alias("record"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<|', '\p') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 12 + 1 + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting by schema fingerprints. DataFrame functions only.

A record is a JSON object of any layout. The paths of its fields, nested ones too, are hashed; the fingerprint selects
a declarative mapping that says which paths hold the turns. Canonical turns are written through a template that marks
them, escapes control strings inside texts reversibly, and tells which characters the loss is taken on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
UNKNOWN = "unknown"

#: Other names of the roles; fixed values.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Strings of a record may be as long as a text can be.
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """How records of one shape hold their turns.

    fields: the field names, nested as in a record (dict: object, list: array of what it holds, None: a plain value).
    parts: (role, field) in order, for records with one field per turn. turns: the fields (list, role, text) of records
    with a list of turns. roles: other names of roles in such a list.
    """

    name: str
    fields: dict
    parts: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    def canonical(self, record: Column) -> Column:
        if self.turns:
            items, role, text = self.turns
            rows = F.from_json(record, f"`{items}` array<struct<`{role}`:string,`{text}`:string>>", _ANY_LENGTH)[items]
            return F.transform(rows, lambda t: F.struct(self._role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
        values = F.from_json(record, ",".join(f"`{name}` string" for _, name in self.parts), _ANY_LENGTH)
        return F.filter(F.array(*(F.struct(F.lit(role).alias("role"), values[name].alias("text")) for role, name in self.parts)),
                        lambda t: t.text.isNotNull())

    def _role(self, role: Column) -> Column:
        if not self.roles:
            return F.coalesce(role, F.lit(""))
        names = F.create_map(*(F.lit(x) for pair in self.roles.items() for x in pair))
        return F.coalesce(F.try_element_at(names, role), role, F.lit(""))


#: Public layouts; fixed values.
LAYOUTS = (
    Layout("messages", {"messages": [{"content": None, "role": None}]}, turns=("messages", "role", "content")),
    Layout("shared", {"conversations": [{"from": None, "value": None}]}, turns=("conversations", "from", "value"), roles=ROLES),
    Layout("prompt", {"prompt": None, "response": None}, (("user", "prompt"), ("assistant", "response"))),
    Layout("completion", {"completion": None, "prompt": None}, (("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", {"input": None, "instruction": None, "output": None},
           (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question", {"answer": None, "question": None}, (("user", "question"), ("assistant", "answer"))),
)

#: Strings that tokenizers or templates treat as control; fixed values.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_OPEN, _MIDDLE, _CLOSE = "<|turn|>", "<|says|>", "<|end|>"

# Types of plain values in the schema of a record; what is left of it is its field names and how they nest.
_PLAIN = r"(: |<)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|DECIMAL\([0-9]+, ?[0-9]+\))(?=[,>])"


def shape(record: Column) -> Column:
    """Nested field paths of a JSON object, as one text; null for other texts.

    They are taken from the record with its string values blanked, so they do not depend on how long texts are: without
    escapes, a quoted run is a name if a colon follows it, else a value.
    """
    plain = F.replace(F.replace(record, F.lit("\\\\")), F.lit('\\"'))
    blank = F.regexp_replace(plain, '("[^"]*+"[\\x20\\t\\r\\n]*+:)|(")[^"]*+(")', "$1$2$3")
    schema = F.schema_of_variant(F.try_parse_json(blank))
    return F.when(schema.startswith("OBJECT<"), F.regexp_replace(schema, _PLAIN, "$1"))


def shape_of(fields) -> str:
    """What shape() gives for a record with these fields."""
    if isinstance(fields, dict):
        return "OBJECT<" + ", ".join(f"{name}: {shape_of(fields[name])}" for name in sorted(fields)) + ">"
    return f"ARRAY<{shape_of(fields[0])}>" if isinstance(fields, list) else ""


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """All columns with fingerprint, layout and turns (array of role and text); columns of these names are replaced.

    A record that is null, no JSON object, or of no known layout has layout `unknown` and null turns: it is kept, not
    guessed at. Fields that are null are no turns in part layouts and empty texts in turn lists; their names still count
    for the fingerprint. An empty table stays empty.
    """
    known = F.create_map(*(x for i, layout in enumerate(layouts) for x in (fingerprint(F.lit(shape_of(layout.fields))), F.lit(i))))
    marked = records.withColumn("fingerprint", F.when(shape(F.col(record)).isNotNull(), fingerprint(shape(F.col(record)))))
    at = F.coalesce(F.try_element_at(known, F.col("fingerprint")), F.lit(-1))
    turns, name = F.lit(None).cast(f"array<{TURN}>"), F.lit(UNKNOWN)
    for i, layout in enumerate(layouts):
        turns = F.when(at == i, layout.canonical(F.col(record)).cast(f"array<{TURN}>")).otherwise(turns)
        name = F.when(at == i, layout.name).otherwise(name)
    return marked.withColumn("layout", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """Breaks control strings by a backslash and a letter for their first character; backslashes are doubled before."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, letter in (("<", "l"), ("[", "b"), ("|", "p")):
        rests = [c[1:] for c in CONTROL if c[0] == first]
        tails = "|".join("".join(f"\\{x}" if not x.isalnum() else x for x in rest) for rest in rests)
        out = F.regexp_replace(out, f"\\{first}(?={tails})", rf"\\{letter}")
    return out


def unescape(text: Column) -> Column:
    """Back to the text: between doubled backslashes, letters become the characters they stand for."""
    def plain(part: Column) -> Column:
        for first, letter in (("<", "l"), ("[", "b"), ("|", "p")):
            part = F.replace(part, F.lit("\\" + letter), F.lit(first))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def written(turns: Column) -> Column:
    """The formatted text of a list of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(_OPEN), escape(F.coalesce(t.role, F.lit(""))), F.lit(_MIDDLE), escape(F.coalesce(t.text, F.lit(""))), F.lit(_CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """Spans (start, end) of assistant texts in the formatted text, in code points, end exclusive."""
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(escape(F.coalesce(t.role, F.lit("")))).alias("role"), F.length(escape(F.coalesce(t.text, F.lit("")))).alias("text"),
        (t.role == "assistant").alias("loss")))
    fixed = len(_OPEN) + len(_MIDDLE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(sizes, start, lambda a, t: F.struct(
        (a.at + fixed + t.role + t.text + len(_CLOSE)).alias("at"),
        F.when(t.loss, F.concat(a.spans, F.array(F.struct((a.at + fixed + t.role).alias("start"), (a.at + fixed + t.role + t.text).alias("end"))))).otherwise(a.spans).alias("spans")),
        lambda a: a.spans)


def format_chats(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """canonical_turns() with formatted and loss_spans in place of turns; both null where the layout is unknown."""
    rows = canonical_turns(records, record, layouts)
    return rows.withColumn("formatted", written(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns"))).drop("turns")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read from it alone."""
    marked = F.filter(F.split(formatted, "<\\|end\\|>"), lambda x: x != "")
    return F.transform(marked, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(_OPEN) + 1, 1 << 30), _MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(x, _MIDDLE, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.end - s.start))), "")

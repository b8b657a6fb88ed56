"""Chat formatting: heterogeneous layouts to canonical turns, and turns to one marked text.

The fingerprint of a layout is the hash of its nested field paths.  It selects a
declarative mapping from the registry, which says where roles and texts lie.  Canonical
turns are written with a template that marks turns, and escapes control strings inside
texts so that reading back is exact; a mask marks what the loss counts.
"""

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``items`` names an array of messages with the fields ``role`` and ``text``, or is
    empty if the row itself is a message (``turn`` tells its place) or if ``fields``
    name, in order, the role of each text field.
    """

    name: str
    paths: tuple
    items: str = ""
    role: str = "role"
    text: str = "text"
    turn: str = ""
    fields: tuple = ()
    roles: dict = field(default_factory=dict)  # other names of roles


#: Declarative mappings; a new layout needs a new entry only.
MAPPINGS = (
    Mapping("rows", ("turn", "role", "text"), turn="turn"),
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), items="messages", text="content"),
    Mapping("shares", ("conversations", "conversations[].from", "conversations[].value"), items="conversations",
            role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", ("instruction", "input", "output"),
            fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("prompt", ("prompt", "completion"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("system_prompt", ("system", "prompt", "response"),
            fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)


def field_paths(schema: T.DataType, at="") -> list[str]:
    """Paths of all nested fields, ``[]`` for an array's elements."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path, *field_paths(f.dataType, path)]
    return out


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def mapping_for(paths, ignore=(), mappings=MAPPINGS) -> Mapping | None:
    """The mapping whose fingerprint the paths have; ``ignore`` lists fields that don't count."""
    own = [p for p in paths if p.split(".")[0].split("[")[0] not in ignore]
    return {fingerprint(m.paths): m for m in mappings}.get(fingerprint(own))


def _named(role: Column, roles: dict) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for other, name in roles.items():
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return role


def _turn(at, role, text, roles):
    return F.struct(at.cast("bigint").alias("turn"), _named(role, roles).alias("role"),
                    F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(m: Mapping, col) -> Column:
    """array of turns of one row; ``col`` gives a top-level field."""
    if m.items:
        return F.transform(col(m.items), lambda x, i: _turn(i, x[m.role], x[m.text], m.roles))
    if m.fields:
        return F.filter(
            F.array(*[_turn(F.lit(i), F.lit(role), col(name), {}) for i, (name, role) in enumerate(m.fields)]),
            lambda t: (t["role"] != "system") | (t["text"] != ""))
    return F.array(_turn(col(m.turn), col(m.role), col(m.text), m.roles))


def canonical(rows: DataFrame, id_col="conv_id", ignore=(), mappings=MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout.

    The layout is told from the table's nested fields, but for the id and ``ignore``.
    Null texts and roles become empty; an unknown layout raises ValueError.
    """
    m = mapping_for(field_paths(rows.schema), {id_col, *ignore}, mappings)
    if m is None:
        raise ValueError(f"no mapping for {sorted(field_paths(rows.schema))}")
    turns = _turns(m, lambda name: rows[name])
    return rows.select(rows[id_col].cast("bigint").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def json_fingerprint(text: Column) -> Column:
    """Fingerprint of the nested field paths of a JSON text; null if it isn't JSON.

    Values' types don't count.  The shape is the one the schema of the value is printed
    with: OBJECT<a, b: ARRAY<OBJECT<...>>>.
    """
    shape = F.schema_of_variant(F.try_parse_json(text))
    return F.sha2(F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z]+(?:\([0-9, ]*\))?", ""), 256)


def _json_shape(m: Mapping) -> str:
    if m.items:
        return f"OBJECT<{m.items}: ARRAY<OBJECT<{', '.join(sorted((m.role, m.text)))}>>>"
    return f"OBJECT<{', '.join(sorted(m.paths))}>"


def _json_schema(m: Mapping) -> str:
    if m.items:
        return f"struct<`{m.items}`:array<struct<`{m.role}`:string,`{m.text}`:string>>>"
    return "struct<" + ",".join(f"`{p}`:string" for p in m.paths) + ">"


def canonical_json(rows: DataFrame, id_col="conv_id", json_col="record", mappings=MAPPINGS) -> DataFrame:
    """(conv_id, layout, turn, role, text) of records of mixed layouts, one JSON text each.

    Every row's fingerprint selects its mapping.  A row of an unknown layout, or that is
    null or no JSON, gives one row with null layout, turn, role and text.
    """
    rows = rows.select(rows[id_col].cast("bigint").alias("conv_id"), rows[json_col].alias("record"))
    rows = rows.withColumn("print", json_fingerprint(F.col("record")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        own = F.col("print") == hashlib.sha256(_json_shape(m).encode()).hexdigest()
        record = F.from_json("record", _json_schema(m))
        layout = F.when(own, F.lit(m.name)).otherwise(layout)
        turns = F.when(own, _turns(m, lambda name, r=record: r[name])).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), F.explode_outer(turns).alias("t")).select("conv_id", "layout", "t.*")


# The template: <s>[role]text</s> for each turn, with `\`, `<`, `[` and `]` escaped in both.
OPEN, HEAD, CLOSE = "<s>[", "]", "</s>"
TURN = r"(?s)<s>\[((?:[^\\\]]++|\\.)*+)\]((?:[^\\<]++|\\.)*+)</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained=("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask) of (conv_id, turn, role, text).

    loss_mask holds the spans [start, end) of the formatted text, in code points, that
    the loss counts: the texts of the ``trained`` roles.  Turns are ordered by turn
    (null first), then role and text, so ties and repeated rows have a fixed order; rows
    with a null conv_id are one conversation; null roles and texts are empty; extra
    columns are ignored.  One shuffle by conversation, whose text is one value anyhow.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(HEAD))
    rows = rows.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    size = (F.length("head") + F.length("body") + len(CLOSE)).cast("bigint")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head"))
    span = F.when(F.col("role").isin(*trained), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    piece = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
    pieces = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return pieces.select("conv_id", F.array_join("p.piece", "").alias("formatted"),
                         F.filter("p.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("role"),
                     F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("text")),
        lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(chats: DataFrame) -> DataFrame:
    """What reading back gives, as counts and checksums."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))

"""Chat formatting with schema fingerprints, in DataFrame functions only.

A table's or record's nested field paths, as far as a layout knows them, are sorted and hashed;
the hash selects a declarative mapping, which turns prompt, instruction, message or turn-row
layouts into canonical turns (role, text). A typed table has one fingerprint; records in JSON
have one each, so that one column can mix layouts.

The template writes each turn as ``<s>[ROLE]role[/ROLE]text</s>``. Inside roles and texts, every
control string (also those with backslashes put in already) gets one backslash more after its
first character, which reading back takes out again; control strings start with ``<`` or ``[``
and hold neither later on, so that none can form across a border. The loss mask lists the spans
of assistant texts in the formatted string.

Cases: null roles and texts count as empty; turns sort by turn number (null first), then role,
then text, so that repeated rows stay and ties are settled; rows with a null id are one
conversation; a record whose fingerprint no layout has, or that is no JSON, has no turns; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings, as one expression behind the first character.
CONTROL_TAIL = r"/?(?:s>|(?:INST|ROLE)\])"
TURN_END = "</s>"
TURN_HEAD = "<s>[ROLE]"
ROLE_END = "[/ROLE]"
LOSS_ROLE = "assistant"
#: Other names of roles, in layouts that have names of their own.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns. rows: (turn, role, text) columns of a table with a row for
    each turn. many: (list, role, text) fields. flat: (role, fields) joined by blank lines.
    renames: roles have names of ROLE_NAMES; elsewhere they stay as they are."""

    name: str
    rows: tuple[str, str, str] | None = None
    many: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = field(default=())
    renames: bool = False

    def paths(self) -> list[str]:
        if self.rows:
            return list(self.rows)
        if self.many:
            a, role, text = self.many
            return [*[x for _, fs in self.flat for x in fs], f"{a}[].{role}", f"{a}[].{text}"]
        return [x for _, fs in self.flat for x in fs]


LAYOUTS = (
    Layout("turn rows", rows=("turn", "role", "text")),
    Layout("messages", many=("messages", "role", "content")),
    Layout("system and messages", many=("messages", "role", "content"), flat=(("system", ("system",)),), optional=("system",)),
    Layout("exchange", many=("conversations", "from", "value"), renames=True),
    Layout("instruction", flat=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Layout("prompt and completion", flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question and answer", flat=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths: list[str]) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def known_fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Each layout's fingerprint, and that without its optional fields."""
    out: dict[str, Layout] = {}
    for x in layouts:
        for paths in (x.paths(), [p for p in x.paths() if p not in x.optional]):
            out.setdefault(fingerprint(paths), x)
    return out


def _known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths()})


def schema_paths(kind: T.DataType, top: str = "") -> list[str]:
    """The leaf paths of a type; [] stands for a list's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{top}.{f.name}" if top else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{top}[]")
    return [top]


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout of a table, by the fingerprint of those of its paths that some layout has; if
    unknown, as with columns of several layouts, by the largest layout that it holds whole."""
    known = set(_known_paths(layouts))
    paths = [p for p in schema_paths(schema) if p in known]
    got = known_fingerprints(layouts).get(fingerprint(paths))
    if got is None:
        held = [x for x in layouts if {*x.paths()} - {*x.optional} <= {*paths}]
        if not held:
            raise ValueError(f"no layout has the fields {sorted(paths)}")
        got = max(held, key=lambda x: len(x.paths()))
    return got


def _role(c: Column, renames: bool) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for name, role in ROLE_NAMES.items() if renames else ():
        c = F.when(c == name, role).otherwise(c)
    return c


def _turn(role: Column, text: Column, renames: bool = False) -> Column:
    return F.struct(_role(role, renames).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _flat(layout: Layout, get) -> Column:
    """Turns of single fields; a turn without any of its fields is left out."""
    turns = []
    for role, names in layout.flat:
        parts = [get(n) for n in names if get(n) is not None]
        if parts:
            text = F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts]) if len(parts) > 1 else parts[0]
            turns.append(F.when(F.coalesce(*parts).isNotNull(), _turn(F.lit(role), text)))
    return F.filter(F.array(*turns), lambda t: t.isNotNull()) if turns else F.array().cast(TURNS)


def _many(said: Column, role: str, text: str, renames: bool) -> Column:
    return F.transform(said, lambda m: _turn(m[role], m[text], renames))


def canonical(df: DataFrame, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of a typed table."""
    x = layout_of(df.schema, layouts)
    if x.rows:
        turn, role, text = x.rows
        rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(turn).alias("turn"), _turn(F.col(role), F.col(text)).alias("said")).alias("row"))
        turns = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["said"])
        return rows.groupBy("id").agg(turns.alias("turns")).select("id", F.lit(x.name).alias("layout"), "turns")
    present = {f.name for f in df.schema.fields}
    turns = _flat(x, lambda n: F.col(n).cast("string") if n in present else None)
    if x.many:
        a, role, text = x.many
        turns = F.concat(turns, _many(F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)), role, text, x.renames))
    return df.select(F.col(id_col).alias("id"), F.lit(x.name).alias("layout"), turns.alias("turns"))


def canonical_json(df: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of records in JSON, each by its own fingerprint."""
    layouts = tuple(x for x in layouts if not x.rows)
    v = F.try_parse_json(F.col(json_col).cast("string"))
    # each known path that the record has, in sorted order, hashed as fingerprint() does
    shape = F.schema_of_variant("v")
    has = []
    for p in _known_paths(layouts):
        head, _, tail = p.partition("[].")
        if tail:
            inner = F.regexp_extract("shape", rf"(?:<|, ){head}: ARRAY<OBJECT<([^>]*)>", 1)
            has.append(F.when(inner.rlike(rf"(?:^|, ){tail}: "), p))
        else:
            has.append(F.when(F.regexp_replace("shape", r"<OBJECT<[^>]*>>", "").rlike(rf"(?:<|, ){p}: "), p))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).withColumn("shape", shape).withColumn("fingerprint", F.sha2(F.array_join(F.filter(F.array(*has), lambda p: p.isNotNull()), "\n"), 256))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for key, x in known_fingerprints(layouts).items():
        made = _flat(x, lambda n: F.try_variant_get("v", f"$.{n}", "string"))
        if x.many:
            a, role, text = x.many
            got = F.try_variant_get("v", f"$.{a}", f"array<struct<{role}:string,{text}:string>>")
            made = F.concat(made, _many(F.coalesce(got, F.array().cast(f"array<struct<{role}:string,{text}:string>>")), role, text, x.renames))
        turns, name = F.when(F.col("fingerprint") == key, made).otherwise(turns), F.when(F.col("fingerprint") == key, x.name).otherwise(name)
    return rows.select("id", name.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({CONTROL_TAIL})", r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)\\({CONTROL_TAIL})", "$1$2$3")


def render(turns: DataFrame) -> DataFrame:
    """(id, layout, formatted, loss): loss is an array of spans (start, end; code points, from 0, end
    exclusive) of formatted."""
    made = turns.withColumn("parts", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN_HEAD), escape(t["role"]), F.lit(ROLE_END)).alias("head"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))))
    sized = F.transform("parts", lambda p: F.struct(F.char_length(p["head"]).cast("long").alias("a"), F.char_length(p["text"]).cast("long").alias("b"), p["loss"].alias("loss")))
    end = len(TURN_END)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    step = lambda s, p: F.struct(
        (s["at"] + p["a"] + p["b"] + F.lit(end)).alias("at"),
        F.when(p["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + p["a"]).alias("start"), (s["at"] + p["a"] + p["b"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
    )
    return made.select("id", "layout", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(TURN_END))), "").alias("formatted"), F.aggregate(sized, start, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(id, turns, loss_texts) from (id, formatted, loss)."""
    raw = F.filter(F.split("formatted", TURN_END, -1), lambda x: x != "")
    head = len(TURN_HEAD)

    def turn(x: Column) -> Column:
        at = F.instr(x, ROLE_END)
        return F.struct(unescape(F.substr(x, F.lit(head + 1), at - F.lit(head + 1))).alias("role"), unescape(F.substr(x, at + F.lit(len(ROLE_END)))).alias("text"))

    return formatted.select("id", F.transform(raw, turn).alias("turns"), F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("loss_texts"), "formatted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all conversations, and one whose texts hold control strings."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, t.text FROM (SELECT inline(array(named_struct('turn', 0L, 'role', 'user', 'text', :x), named_struct('turn', 1L, 'role', 'assistant', 'text', :x)))) t", args={"x": hard})
    back = read_back(render(canonical(told.unionByName(more), "conv_id")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|(?:INST|ROLE)\]))', '\1\2\\\3', 'g')"
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(TURN_HEAD) + len(ROLE_END) + len(TURN_END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

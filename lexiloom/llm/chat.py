r"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; DataFrame operations only.

*Layouts.* A conversation record may come as a list of messages, as prompt and completion, as instruction, input and
output, or as rows by turn. A layout needs certain nested field paths (`messages[].role`, `instruction`, ...); the
SHA-256 of their sorted list is its fingerprint. A record's own paths are those of its fields that aren't null; of these
the ones that a layout needs are hashed, and the first layout, of most paths first, whose fingerprint comes out is the
record's: a declarative mapping to turns of (role, text). Other fields of a record don't matter. One table may mix
layouts: `canonical_records` reads columns (any that a record lacks are null), `canonical_json` JSON texts.

*Template.* A turn is `<turn:ROLE>TEXT</turn>\n`. Inside roles and texts `\` is written `\b`, `<` is written `\l`
and `>` is written `\g`, so no control string can occur there and the way back is exact. The loss mask is a list of
(start, end) code-point spans of the formatted string, one per assistant text.

Defined cases: null text and null role are empty; turns are ordered by turn (nulls first), then role, then text;
repeated rows are repeated turns; rows with a null conversation id form one conversation; records of no known layout
get null turns; an empty table gives no rows; other columns are ignored, or kept by `canonical_json`, but for those
named as its results, which are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import fresh, table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that make the layout. Either items (a list's path) with role and text fields in
    it, or fixed, pairs of (role, path) in order; names maps role names to canonical ones; skip_empty leaves out
    fixed turns without text; join puts several fields into one text."""

    name: str
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


SHARED_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("messages_text", ("messages[].role", "messages[].text"), "messages", "role", "text"),
    Layout("share", ("conversations[].from", "conversations[].value"), "conversations", "from", "value", names=SHARED_NAMES),
    Layout("bare", ("[].content", "[].role"), "", "role", "content"),
    Layout("prompt_completion", ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input", ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_instruction", ("input", "instruction", "output", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), role="role", text="text"),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths): x for x in LAYOUTS}


def chosen(paths: Column, layouts=LAYOUTS) -> tuple[Column, Column]:
    """(fingerprint, name) of the first layout, of most paths first, whose fingerprint the record's paths give; or nulls."""
    out = F.lit(None).cast("struct<f:string,name:string>")
    for x in sorted(layouts, key=lambda x: len(x.paths)):  # the last one set is tried first
        own = F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in x.paths]))), "\n"), 256)
        out = F.when(own == fingerprint(x.paths), F.struct(F.lit(fingerprint(x.paths)).alias("f"), F.lit(x.name).alias("name"))).otherwise(out)
    return out["f"], out["name"]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves; [] stands for a list's items."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint_of(df: DataFrame, only: tuple[str, ...] = ()) -> str:
    """Of a DataFrame's columns; only: the columns to take, all by default."""
    return fingerprint(p for f in df.schema.fields if not only or f.name in only for p in schema_paths(f.dataType, f.name))


def variant_paths(v: Column, layouts=LAYOUTS) -> Column:
    """The nested field paths of a VARIANT record: its own fields, and those of items of the lists that layouts name."""
    keys = lambda x: F.coalesce(F.map_keys(x), F.array().cast("array<string>"))
    found = [keys(F.try_variant_get(v, "$", "map<string,variant>"))]
    for at in sorted({x.items for x in layouts if x.role and not x.fixed and x.name != "turn_rows"}):
        items = F.try_variant_get(v, f"$.{at}" if at else "$", "array<map<string,variant>>")
        inner = F.array_distinct(F.flatten(F.transform(F.coalesce(items, F.array().cast("array<map<string,variant>>")), keys)))
        head = F.lit(f"{at}[].")
        found.append(F.transform(inner, lambda k: F.concat(head, k)))
    return F.flatten(F.array(*found))


def record_paths(df: DataFrame, columns: list[str]) -> Column:
    """The nested field paths of each row's columns that aren't null."""
    paths = []
    for c in columns:
        leaves = schema_paths(df.schema[c].dataType, c)
        paths.append(F.when(F.col(c).isNotNull(), F.array(*[F.lit(p) for p in leaves])).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*paths))


def _role(role: Column, layout: Layout) -> Column:
    if not layout.names:
        return F.coalesce(role, F.lit(""))
    named = F.create_map(*[F.lit(x) for pair in layout.names for x in pair])
    return F.coalesce(F.try_element_at(named, role), role, F.lit(""))


def _turn_of(layout: Layout):
    return lambda t: F.struct(_role(t[layout.role], layout).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text"))


def _mapped(layout: Layout, get, items) -> Column:
    """Turns of a record of this layout; get gives a field's text, items the list of messages."""
    if not layout.fixed:
        return F.transform(items(layout), _turn_of(layout))
    text = lambda paths: F.array_join(F.filter(F.array(*[F.coalesce(get(p), F.lit("")) for p in paths]), lambda t: t != ""), "\n")
    made = F.array(*[F.struct(F.lit(role).alias("role"), text(paths).alias("text")) for role, paths in layout.fixed])
    return F.filter(made, lambda t: (t.role != "system") | (t.text != ""))


def _select(name: Column, layouts, get, items) -> Column:
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        turns = F.when(name == x.name, _mapped(x, get, items)).otherwise(turns)
    return turns


def canonical_json(df: DataFrame, column: str, layouts=LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns for the JSON texts of a column; records of no known layout, and texts that
    are no JSON, get a null layout and null turns."""
    layouts = [x for x in layouts if x.name != "turn_rows"]
    v, made = fresh(df, "_v"), fresh(df, "_name")
    out = df.withColumn(v, F.try_parse_json(F.col(column)))
    print_, name = chosen(variant_paths(F.col(v), layouts), layouts)
    get = lambda p: F.try_variant_get(F.col(v), f"$.{p}", "string")
    items = lambda x: F.try_variant_get(F.col(v), f"$.{x.items}" if x.items else "$", f"array<struct<`{x.role}`:string,`{x.text}`:string>>")
    out = out.withColumn(made, F.struct(print_.alias("f"), name.alias("name")))
    turns = _select(F.col(f"{made}.name"), layouts, get, items)
    return out.withColumns({"fingerprint": F.col(f"{made}.f"), "turns": turns, "layout": F.col(f"{made}.name")}).drop(v, made)


def canonical_records(df: DataFrame, key: str, layouts=LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, turns) of a table whose rows are records; each row's layout follows from the columns that it fills."""
    columns = [c for c in df.columns if c != key]
    usable = [x for x in layouts if x.name not in ("turn_rows", "bare") and all(p.split("[]")[0] in columns for p in x.paths)]
    usable = [x for x in usable if set(x.paths) <= {p for c in columns for p in schema_paths(df.schema[c].dataType, c)}]
    print_, name = chosen(record_paths(df, columns), usable)
    out = df.withColumns({(f := fresh(df, "_f")): print_, (n := fresh(df, "_n")): name})
    turns = _select(F.col(n), usable, lambda p: F.col(p).cast("string"), lambda x: F.col(x.items))
    return out.select(F.col(key), F.col(f).alias("fingerprint"), F.col(n).alias("layout"), turns.alias("turns"))


def canonical_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows by turn, to (key, turns). The layout is chosen by the fingerprint of the columns it needs, key being conv_id there."""
    named = rows.select(F.col(key).alias("conv_id"), *[c for c in ("turn", "role", "text") if c in rows.columns])
    layout = BY_FINGERPRINT.get(fingerprint_of(named))
    if layout is None or layout.name != "turn_rows":
        raise ValueError("these columns have no layout by rows")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), text(layout.role).alias("role"), text(layout.text).alias("text"))
    got = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return got.select(F.col("conv_id").alias(key), F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def packed(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Records of several layouts in one table, as corpora of many origins have them: (key, turns) to (key, messages,
    conversations, prompt, completion, instruction, output), filled by layout and null elsewhere. A user's and an assistant's
    turn make a prompt or an instruction; other conversations are lists, with content or text by the key's parity."""
    t = F.col("turns")
    two = (F.size(t) == 2) & (F.get(t, 0).role == "user") & (F.get(t, 1).role == "assistant")
    even = F.coalesce(F.pmod(F.xxhash64(key), F.lit(2)) == 0, F.lit(True))
    shared = F.exists(t, lambda x: x.role.isin(*[a for a, _ in SHARED_NAMES]))  # that layout renames such roles
    listed = lambda role, text: F.transform(t, lambda x: F.struct(x.role.alias(role), x.text.alias(text)))
    as_share = ~two & even & ~shared
    first, second = F.get(t, 0).text, F.get(t, 1).text
    return turns.select(
        F.col(key), F.when(~two & ~as_share, listed("role", "content")).alias("messages"), F.when(as_share, listed("from", "value")).alias("conversations"),
        F.when(two & even, first).alias("prompt"), F.when(two & even, second).alias("completion"),
        F.when(two & ~even, first).alias("instruction"), F.when(two & ~even, second).alias("output"),
    )


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def formatted(convs: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """convs has turns; adds formatted and loss_spans, array<struct<start,end>> of code points, end exclusive."""
    head = lambda t: F.concat(F.lit("<turn:"), escaped(t.role), F.lit(">"))
    body = F.transform("turns", lambda t: F.struct(F.length(head(t)).alias("h"), F.length(escaped(t.text)).alias("b"), t.role.isin(*learn_from).alias("on")))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, x: F.struct(
        (a.at + x.h + x.b + F.lit(len("</turn>\n"))).cast("int").alias("at"),
        F.when(x.on, F.concat(a.spans, F.array(F.struct((a.at + x.h).cast("int").alias("start"), (a.at + x.h + x.b).cast("int").alias("end"))))).otherwise(a.spans).alias("spans"),
    )
    joined = F.array_join(F.transform("turns", lambda t: F.concat(head(t), escaped(t.text), F.lit("</turn>\n"))), "")
    return convs.withColumn("formatted", joined).withColumn("loss_spans", F.aggregate(body, start, step).spans)


def parsed(df: DataFrame) -> DataFrame:
    """The way back: adds read_turns, from formatted alone, and loss_text, the unescaped text under loss_spans."""
    pieces = F.filter(F.split(F.col("formatted"), "</turn>\n", -1), lambda p: p != "")
    turn = lambda p: F.struct(
        unescaped(F.regexp_extract(p, "^<turn:([^>]*)>", 1)).alias("role"), unescaped(F.regexp_extract(p, "(?s)^<turn:[^>]*>(.*)$", 1)).alias("text")
    )
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s.start + 1, s.end - s.start)))
    return df.withColumn("read_turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(under, ""))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    records = packed(canonical_rows(rows.unionByName(more)))
    back = parsed(formatted(canonical_records(records, "conv_id")).drop("turns"))
    whole = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(7 + length(role) + length(text) + 8 + length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')))::bigint as formatted_chars
from c group by conv_id"""

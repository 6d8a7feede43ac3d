"""Chat formatting, for records of unlike layouts.

A record is a nested value.  The paths of its fields, without their types, are
hashed to a fingerprint, and the fingerprint selects a declarative mapping: where the
turns are, and which fields hold role and text.  The canonical turns are
written with a template whose marks cannot occur inside texts: control strings there
are escaped, and the escapes can be undone.  The loss mask is a list of
(start, length) in code points of the output, which covers assistant texts.

DataFrame functions only.  Defined cases: null roles and texts are empty; turns
of equal number go by role, then by text as the output has it; a null conv_id is a conversation of its own; a
conversation without turns gives an empty output; records that no mapping fits
have a null output and keep their fingerprint; other columns are left out.  Text that
is not JSON, or more than a variant holds, is an error.  Rows that are turns already do
not pass through JSON, but their columns are fingerprinted and mapped as the fields of records are; conversations of
rows that no mapping fits have nulls; a conversation's output must fit one value, 2 GiB, or the query fails.
Time is in proportion to the turns and their texts, but for sorting the turns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casframe.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"

# The control strings of common chat templates.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CODES = "abcdefghi"


def escape(text: Column, line: bool = False) -> Column:
    """Text in which no control string is left; with line, no line end either."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code, control in zip(_CODES, CONTROL, strict=True):
        out = F.replace(out, F.lit(control), F.lit("\\" + code))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescape(text: Column) -> Column:
    """Undoes escape.  Pairs of backslashes part the text, so that single ones begin a code."""

    def codes(part: Column) -> Column:
        for code, control in zip(_CODES, CONTROL, strict=True):
            part = F.replace(part, F.lit("\\" + code), F.lit(control))
        return F.replace(part, F.lit("\\n"), F.lit("\n"))

    undone = F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")
    return F.when(F.contains(text, F.lit("\\")), undone).otherwise(text)


@dataclass(frozen=True)
class Mapping:
    """How records with just these field paths are read.

    turns: the path of an array of turns with the fields role and text (and order, if
    the array is not in order), or else fixed (role, path) pairs, whose null texts
    are left out.  roles: other names for roles.
    """

    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    order: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping(("turns[].role", "turns[].text", "turns[].turn"), turns="turns", text="text", order="turn"),
    Mapping(("messages[].content", "messages[].role"), turns="messages"),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping(("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)

#: Records of one turn each, which are rows with these columns beside the conversation's key.
TURN_MAPPINGS = (
    Mapping(("role", "text", "turn"), text="text", order="turn"),
    Mapping(("content", "role", "turn"), order="turn"),
    Mapping(("from", "turn", "value"), role="from", text="value", order="turn", roles=(("human", "user"), ("gpt", "assistant"))),
)


def field_paths(record: Column) -> Column:
    """The sorted leaf paths of a variant object of up to two levels, as an array."""
    schema = F.schema_of_variant(record)
    # "OBJECT<a: ARRAY<OBJECT<b: STRING>>, c: BIGINT>": names with their kinds, the inner ones in brackets.
    lists = F.regexp_extract_all(schema, F.lit(r"(\w+: ARRAY<OBJECT<[^<>]*>>)"), F.lit(1))
    inner = F.flatten(F.transform(lists, lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, r"OBJECT<(.*)>>", 1), F.lit(r"(\w+): "), F.lit(1)), lambda f: F.concat(F.regexp_extract(x, r"^(\w+)", 1), F.lit("[]."), f))))
    outer = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(schema, r"\w+: ARRAY<OBJECT<[^<>]*>>", ""), r"^OBJECT<", ""), F.lit(r"(\w+): "), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(inner, outer)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _named(role: Column, m: Mapping) -> Column:
    for old, new in m.roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.coalesce(role, F.lit(""))


def _turns(record: Column, m: Mapping) -> Column:
    def text(v: Column, path: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", "string")

    if m.turns:
        items = F.try_variant_get(record, f"$.{m.turns}", "array<variant>")
        order = (lambda v: F.try_variant_get(v, f"$.{m.order}", "bigint")) if m.order else (lambda v: F.lit(0).cast("long"))
        turns = F.transform(items, lambda v: F.struct(order(v).alias("n"), _named(text(v, m.role), m).alias("role"), F.coalesce(text(v, m.text), F.lit("")).alias("text")))
        turns = F.array_sort(turns) if m.order else turns
        return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    turns = F.array(*(F.struct(F.lit(r).alias("role"), text(record, p).alias("text")) for r, p in m.fixed))
    return F.filter(turns, lambda t: t["text"].isNotNull())


def canonical_turns(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint and turns, an array of (role, text), to records of JSON text or variants."""
    value = F.col(record) if dict(records.dtypes)[record] == "variant" else F.parse_json(record)
    rows = records.withColumn("__v", value).withColumn("fingerprint", fingerprint(field_paths(F.col("__v"))))
    turns = None
    for m in mappings:
        fits = F.col("fingerprint") == fingerprint(F.array(*(F.lit(p) for p in sorted(m.paths))))
        turns = F.when(fits, _turns(F.col("__v"), m)) if turns is None else turns.when(fits, _turns(F.col("__v"), m))
    return rows.withColumn("turns", turns).drop("__v")


def single_turns(records: DataFrame, key: str, mappings: tuple[Mapping, ...] = TURN_MAPPINGS) -> DataFrame:
    """key, fingerprint, fits, n, role and text of rows that are one turn each; n, role and text are null where no mapping fits.

    A row's field paths are its columns; columns that no mapping names are no fields.
    """
    fields = sorted({p for m in mappings for p in m.paths} & set(records.columns))
    own = fingerprint(F.array(*(F.lit(c) for c in fields)).cast("array<string>"))
    fits, turn = F.lit(False), {"n": F.lit(None), "role": F.lit(None), "text": F.lit(None)}
    for m in mappings:
        n, role, text = (F.col(c) if c in fields else F.lit(None) for c in (m.order, m.role, m.text))
        this = F.col("fingerprint") == fingerprint(F.array(*(F.lit(c) for c in sorted(m.paths))))
        fits = fits | this
        turn = {c: F.when(this, value).otherwise(turn[c]) for c, value in (("n", n), ("role", _named(role, m)), ("text", text))}
    return records.select(key, *fields, own.alias("fingerprint")).select(key, "fingerprint", fits.alias("fits"), *(value.alias(c) for c, value in turn.items()))


def _body(rows: DataFrame, key: str) -> DataFrame:
    """Turn rows (key, n, role, text) with what the output has of each: s, and the lengths of its head and text.

    Every control string is escaped once, in rows, before turns of one key meet.
    """
    rows = rows.select(key, "n", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("who", F.col("role")).withColumns({"head": F.concat(F.lit(START), escape(F.col("role"), line=True), F.lit("\n")), "text": escape(F.col("text"))})
    return rows.select(key, "n", "who", (F.col("role") == "assistant").alias("loss"), F.length("head").alias("head"), F.length("text").alias("len"), F.concat("head", "text", F.lit(END + "\n")).alias("s"))


def _formatted(body: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """key, formatted and loss_mask of turn rows; a running sum places each turn, so work is linear in the turns."""
    tail = len(END) + 1
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = body.withColumn("end", F.sum((F.col("head") + F.col("len") + F.lit(tail)).cast("long")).over(before))
    rows = placed.withColumn("start", F.when(F.col("loss"), (F.col("end") - tail - F.col("len") + 1).cast("int"))).groupBy(key).agg(
        F.expr("listagg(s, '') WITHIN GROUP (ORDER BY end)").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("loss"), F.struct("start", F.col("len").alias("length"))))).alias("loss_mask"),
    )
    return rows.select(key, "formatted", "loss_mask")


def format_turns(rows: DataFrame, key: str) -> DataFrame:
    """key, formatted and loss_mask of rows with an array of turns; key must tell the rows apart.

    Null turns give a null output, and an empty array an empty one.
    """
    flat = rows.where("turns IS NOT NULL").select(key, F.posexplode("turns").alias("n", "t")).select(key, "n", "t.role", "t.text")
    made = _formatted(_body(flat, key), key, ("n",)).withColumnRenamed(key, "__key")
    some = F.col("turns").isNotNull()
    out = rows.select(key, some.alias("__some")).join(made, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, F.when(F.col("__some"), F.coalesce("formatted", F.lit(""))).alias("formatted"), F.when(F.col("__some"), F.coalesce("loss_mask", F.array().cast("array<struct<start:int,length:int>>"))).alias("loss_mask"))


def read_back(formatted: DataFrame, key: str, *carried: str) -> DataFrame:
    """Rows of what formatted and loss_mask alone say: key, at (where a piece begins), role and text of each turn, and loss, its text under the mask; carried columns go along.

    The output is split at its turn ends; pieces and mask entries are then ordered by place, so that
    each entry meets the piece that it begins in.
    """
    pieces = F.transform(F.filter(F.split("formatted", F.lit(r"<\|im_end\|>\n")), lambda x: x != ""), lambda x: F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), x.alias("piece")))
    masks = F.transform("loss_mask", lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), F.lit(None).cast("string").alias("piece")))
    flat = formatted.select(key, *carried, F.posexplode(F.concat(pieces, masks)).alias("pos", "e")).select(key, *carried, "pos", "e.*")
    own = Window.partitionBy(key)
    size = F.when(F.col("piece").isNotNull(), F.length("piece") + len(END) + 1).otherwise(0).cast("long")
    flat = flat.withColumn("at", F.coalesce(F.col("start").cast("long"), F.sum(size).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + 1))
    here = own.orderBy("at", F.col("start").isNotNull(), "pos")
    flat = flat.withColumns({
        "in_piece": F.last("piece", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "piece_at": F.last(F.when(F.col("piece").isNotNull(), F.col("at")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    loss = unescape(F.substr(F.col("in_piece"), (F.col("start") - F.col("piece_at") + 1).cast("int"), F.col("length")))
    head = F.locate("\n", F.col("piece"))
    return flat.select(
        key,
        *carried,
        "at",
        F.when(F.col("piece").isNotNull(), unescape(F.substr(F.col("piece"), F.lit(len(START) + 1), head - len(START) - 1))).alias("role"),
        F.when(F.col("piece").isNotNull(), unescape(F.substr(F.col("piece"), head + 1))).alias("text"),
        F.when(F.col("start").isNotNull(), loss).alias("loss"),
    )


def typed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, fingerprint and turns of rows that are turns already."""
    paths = F.array(*(F.lit(p) for p in sorted(MAPPINGS[0].paths)))
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", fingerprint(paths).alias("fingerprint"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What is read back from outputs that are not empty, as counts and SHA-256."""
    rows = read_back(formatted.withColumn("formatted_chars", F.length("formatted").cast("long")), key, "formatted_chars")
    back = rows.withColumn("said", F.concat("role", F.lit("\n"), "text", F.lit("\n"))).groupBy(key).agg(
        F.count("said").alias("n_turns"),
        F.coalesce(F.expr("listagg(said, '') WITHIN GROUP (ORDER BY at)"), F.lit("")).alias("said"),
        F.coalesce(F.expr("listagg(loss, '') WITHIN GROUP (ORDER BY at)"), F.lit("")).alias("loss"),
        F.max("formatted_chars").alias("formatted_chars"),
    )
    return back.select(key, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(conversations: DataFrame, mappings: tuple[Mapping, ...] = TURN_MAPPINGS) -> DataFrame:
    """One row for each conversation of rows (conv_id, and a turn as the mapping of their fingerprint names its columns: turn, role, text)."""
    rows = single_turns(conversations, "conv_id", mappings)
    body = _body(rows.where("fits").select("conv_id", "n", "role", "text"), "conv_id")
    formatted = cut(_formatted(body, "conv_id", ("n", "who", "s")))  # stored, so that a task holds the output or what is read back
    return digests(formatted, "conv_id").unionByName(rows.where("NOT fits").select("conv_id").distinct(), allowMissingColumns=True)

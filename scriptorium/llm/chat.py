"""Chat formatting by schema fingerprint, with DataFrame functions only.

The nested field paths of the data, of a table's schema or of each JSON record, are hashed as far as any mapping knows
them; the hash selects a declarative mapping that turns rows of that layout into canonical turns. What no single mapping
fits is unknown: an error for a table, a count of its own for records. Turns are written with a reversible template:

    ### role: text</turn>\n

Inside role and text the characters that start control strings are escaped (\\ as \\b, < as \\l, # as \\h and
in roles : as \\c), so no text can close a turn or open one, and what is between two marks reads back exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a type, nested ones included: `messages[].role`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(column: str, role: str, text: str) -> Column:
    return F.transform(F.coalesce(F.col(column), F.array()), lambda m: _turn(m[role], m[text]))


def _pair(prompt: str, answer: str):
    return lambda: F.array(_turn("user", F.col(prompt)), _turn("assistant", F.col(answer)))


def _with_input() -> Column:
    asked = F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(F.concat_ws("\n", "instruction", "input"))
    return F.array(_turn("user", asked), _turn("assistant", F.col("output")))


#: Layouts: their field paths, and the canonical turns of a row that holds a conversation; None where a row is one turn.
LAYOUTS: tuple[tuple[tuple[str, ...], object], ...] = (
    (("role", "text", "turn"), None),
    (("messages[].content", "messages[].role"), lambda: _messages("messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), lambda: _messages("conversations", "from", "value")),
    (("prompt", "response"), _pair("prompt", "response")),
    (("prompt", "completion"), _pair("prompt", "completion")),
    (("instruction", "output"), _pair("instruction", "output")),
    (("input", "instruction", "output"), _with_input),
)
MAPPINGS = {fingerprint(list(p)): turns for p, turns in LAYOUTS}
KNOWN = frozenset(p for known, _ in LAYOUTS for p in known)
#: Lists of turns within a record, and the paths of their elements.
NESTED = {f: sorted(p for p in KNOWN if p.startswith(f"{f}[]")) for f in ("messages", "conversations")}


def _escape(text: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _unescape(text: Column) -> Column:
    for a, b in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def turn_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Canonical rows (key, nth, role, text) of a table of any known layout; nth gives the order.

    The hash of the schema's paths, of those that any layout knows, selects the mapping; other columns may stand
    beside them. Rows by turn are ordered by turn (null first), then role and text, so ties have one order. Null roles
    and texts are empty, a null list has no turns, repeated rows are turns of their own; no rows, none. A schema
    that no mapping fits, or that holds the fields of several layouts, raises ValueError: select one's columns.
    """
    held = sorted({p for p in paths(df.schema) if p in KNOWN and p != key})
    mark = fingerprint(held)
    if mark not in MAPPINGS:
        raise ValueError(f"no mapping for the layout {mark}: {held}")
    if (turns := MAPPINGS[mark]) is None:
        role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
        return df.select(F.col(key), F.struct("turn", role.alias("role"), text.alias("text")).alias("nth"), role.alias("role"), text.alias("text"))
    return df.select(F.col(key), F.posexplode(turns()).alias("nth", "t")).select(key, "nth", "t.role", "t.text")


_MESSAGE = "array<struct<role: string, content: string>>"
_RECORD = f"messages {_MESSAGE}, conversations array<struct<`from`: string, value: string>>, prompt string, response string, completion string, instruction string, input string, output string"


def record_paths(record: Column) -> Column:
    """Sorted paths of a JSON record as far as a layout knows them: its own keys, null values included, and those of the first element of a list of turns (an empty list counts as any)."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    held = [F.filter(keys, lambda k: k.isin(*sorted(p for p in KNOWN if "[" not in p)))]
    for name in NESTED:
        held.append(_nested_paths(record, keys, name))
    return F.array_sort(F.array_distinct(F.concat(*held)))


def _nested_paths(record: Column, keys: Column, name: str) -> Column:
    first = F.coalesce(F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")), F.array().cast("array<string>"))
    inner = F.filter(F.transform(first, lambda k: F.concat(F.lit(f"{name}[]."), k)), lambda p: p.isin(*NESTED[name]))
    empty = F.array_contains(keys, name) & (F.get_json_object(record, f"$.{name}") == "[]")
    return F.when(empty, F.array(*map(F.lit, NESTED[name]))).otherwise(inner)


def record_fingerprint(record: Column) -> Column:
    """The layout of a JSON record as fingerprint() gives it for a table; null for what is no JSON object."""
    return F.when(F.json_object_keys(record).isNotNull(), F.substring(F.sha2(F.array_join(record_paths(record), "\n"), 256), 1, 16))


def mixed_json_turns(df: DataFrame, column: str, key: str) -> DataFrame:
    """Canonical rows of JSON records whose layouts differ row by row; the hash of the record's own paths selects its mapping.

    A record that is null, broken, or of no single known layout gives no rows; layout_counts counts these.
    """
    row = df.select(F.col(key), record_fingerprint(F.col(column)).alias("layout"), F.from_json(F.col(column), _RECORD).alias("r")).select(key, "layout", "r.*")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout, make in MAPPINGS.items():
        if make is not None:
            turns = F.when(F.col("layout") == layout, make()).otherwise(turns)
    return row.select(key, F.posexplode(turns).alias("nth", "t")).select(key, "nth", "t.role", "t.text")


def layout_counts(df: DataFrame, column: str) -> DataFrame:
    """layout, paths, known, n: how many records have each layout and whether mixed_json_turns reads it; layout is null for what is no JSON object."""
    mapped = sorted(k for k, make in MAPPINGS.items() if make is not None)
    row = df.select(record_fingerprint(F.col(column)).alias("layout"), record_paths(F.col(column)).alias("paths"))
    return row.groupBy("layout", "paths").agg(F.count("*").alias("n")).select("layout", "paths", F.coalesce(F.col("layout").isin(mapped), F.lit(False)).alias("known"), "n")


def formatted(rows: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """key, formatted (one string), marks array<struct<start, length, loss>>: a turn's escaped text in the string, and whether it counts for the loss.

    One conversation is one row and so one task's work; its digest asks for that. A conversation's turns are
    sorted by Spark, which can spill.
    """
    head = F.concat(F.lit(OPEN), _escape(F.col("role"), True), F.lit(COLON))
    parts = rows.select(key, "nth", head.alias("head"), _escape(F.col("text")).alias("body"), (F.col("role") == learn).alias("loss"))
    before = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(CLOSE)
    parts = parts.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    turn = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("s"), (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "loss")
    turns = parts.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return turns.select(key, F.array_join(F.col("t.s"), "").alias("formatted"), F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("marks"))


def read_back(df: DataFrame) -> DataFrame:
    """df with turns array<struct<role, text, loss>> read from formatted and marks alone."""
    pieces = F.slice(F.split("formatted", CLOSE, -1), F.lit(1), F.size("marks"))

    def one(x: Column) -> Column:
        piece, mark = x["0"], x["1"]
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), COLON, 1)
        body = F.substr(piece, F.length(piece) - mark["length"].cast("int") + 1)
        return F.struct(_unescape(role).alias("role"), _unescape(F.when(mark["length"] > 0, body).otherwise("")).alias("text"), mark["loss"].alias("loss"))

    return df.withColumn("turns", F.transform(F.arrays_zip(pieces.alias("0"), F.col("marks").alias("1")), one))

"""Chat formatting: records of many layouts to one template. DataFrame functions only.

A record is a VARIANT value. The nested paths of its fields (values left out) make its schema
fingerprint, which selects one of the declared mappings of ``LAYOUTS`` to canonical turns, an array
of (role, text). Turns are then written in one template:

    system      <s><<SYS>> text <</SYS>>
    user        <s>[INST] text [/INST]
    assistant   text </s>                    with a space before the text
    any other   <s><<ROLE>> role <</ROLE>> text </s>

Control strings within a text or role get a backslash after their first character; one that has
some already gets one more, so taking one away gives the text back. The loss mask is a list of spans
of code points of the formatted string: the assistants' texts, without the space and the marker.

Roles keep their names, but for layouts whose names for them are others (``ROLES``).

Defined results: null text or role is empty; a record whose layout no mapping declares
has a null layout and null turns and nothing formatted; an empty list of turns formats to an empty
string; texts may have any length and content; repeated turns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A control string: its first character, backslashes, the rest.
CONTROL = r"(<)(\\*)(/?s>|</?(?:SYS|ROLE)>>)|(\[)(\\*)(/?INST\])"
#: Other names of the roles, in layouts that do not use these.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: One turn in formatted text; just one alternative fits where a turn begins.
TURN = (
    r"(?s)<s>\[INST\] .*? \[/INST\]|<s><<SYS>> .*? <</SYS>>|<s><<ROLE>> .*? <</ROLE>> .*? </s>| .*? </s>"
)


def fingerprint(record: Column) -> Column:
    """64-bit hash of a variant's nested field paths, whatever types its values have."""
    paths = F.regexp_replace(F.schema_of_variant(record), r"DECIMAL\(\d+,\d+\)", "DECIMAL")
    return F.xxhash64(F.regexp_replace(paths, r"(?<=[:<] ?)(?!OBJECT<|ARRAY<)[A-Z_]+(?=[,>])", ""))


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def renamed(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)


def listed(path: str, role: str, text: str, name: Callable[[Column], Column] = lambda role: role) -> Callable[[Column], Column]:
    kind = f"array<struct<{role} string, {text} string>>"
    return lambda r: F.transform(F.try_variant_get(r, path, kind), lambda m: turn(name(m[role]), m[text]))


def paired(system: str | None, question: tuple[str, ...], answer: str) -> Callable[[Column], Column]:
    get = lambda r, name: F.try_variant_get(r, f"$.{name}", "string")

    def turns(r: Column) -> Column:
        asked = F.concat_ws("\n", *[F.nullif(get(r, q), F.lit("")) for q in question])
        both = F.array(turn(F.lit("user"), asked), turn(F.lit("assistant"), get(r, answer)))
        if system is None:
            return both
        first = F.array(turn(F.lit("system"), get(r, system)))
        return F.when(F.coalesce(get(r, system), F.lit("")) != "", F.concat(first, both)).otherwise(both)

    return turns


@dataclass(frozen=True)
class Layout:
    """Records whose fields are those of an example are read by ``turns``."""

    name: str
    examples: tuple[str, ...]
    turns: Callable[[Column], Column]


LAYOUTS = (
    Layout("messages role text", ('{"messages":[{"role":"","text":""}]}', '{"messages":[]}'), listed("$.messages", "role", "text")),
    Layout("messages role content", ('{"messages":[{"role":"","content":""}]}',), listed("$.messages", "role", "content")),
    Layout("list role content", ('[{"role":"","content":""}]', "[]"), listed("$", "role", "content")),
    Layout("conversations from value", ('{"conversations":[{"from":"","value":""}]}', '{"conversations":[]}'), listed("$.conversations", "from", "value", renamed)),
    Layout("prompt response", ('{"prompt":"","response":""}', '{"system":"","prompt":"","response":""}'), paired("system", ("prompt",), "response")),
    Layout("prompt completion", ('{"prompt":"","completion":""}',), paired(None, ("prompt",), "completion")),
    Layout("instruction input output", ('{"instruction":"","input":"","output":""}', '{"instruction":"","output":""}'), paired(None, ("instruction", "input"), "output")),
    Layout("question answer", ('{"question":"","answer":""}', '{"context":"","question":"","answer":""}'), paired(None, ("context", "question"), "answer")),
)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows with ``layout`` and ``turns``."""
    has = F.col("schema_fingerprint")
    fits = lambda x: F.array_contains(F.array(*[fingerprint(F.parse_json(F.lit(e))) for e in x.examples]), has)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role string, text string>>")
    for x in reversed(layouts):
        name = F.when(fits(x), F.lit(x.name)).otherwise(name)
        turns = F.when(F.col("layout") == x.name, x.turns(F.col(record))).otherwise(turns)
    return records.withColumn("schema_fingerprint", fingerprint(F.col(record))).withColumn("layout", name).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$4$2$5$3$6")


def _written(t: Column) -> Column:
    role, text = t["role"], escape(t["text"])
    part = lambda a, b: F.struct(F.lit(a).alias("head"), text.alias("body"), F.lit(b).alias("tail"), (role == "assistant").alias("loss"))
    other = F.concat(F.lit("<s><<ROLE>> "), escape(role), F.lit(" <</ROLE>> "))
    return (
        F.when(role == "user", part("<s>[INST] ", " [/INST]"))
        .when(role == "system", part("<s><<SYS>> ", " <</SYS>>"))
        .when(role == "assistant", part(" ", " </s>"))
        .otherwise(F.struct(other.alias("head"), text.alias("body"), F.lit(" </s>").alias("tail"), F.lit(False).alias("loss")))
    )


def formatted(rows: DataFrame, turns: str = "turns") -> DataFrame:
    """The rows with ``formatted`` and ``loss_spans`` (start, length in code points)."""
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])
    none = F.array().cast("array<struct<start int, length int>>")

    def step(a: Column, p: Column) -> Column:
        span = F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((a["at"] + size(p)).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return (
        rows.withColumn("_parts", F.transform(turns, _written))
        .withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
        .withColumn("loss_spans", F.aggregate("_parts", F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"])
        .drop("_parts")
    )


def parsed(text: Column) -> Column:
    """Turns read back from a formatted string."""

    def one(t: Column) -> Column:
        cut = lambda a, b: F.substring(t, F.lit(a + 1), F.length(t) - (a + b))
        other = F.regexp_extract(t, r"(?s)^<s><<ROLE>> (.*?) <</ROLE>> (.*) </s>$", 1)
        said = F.regexp_extract(t, r"(?s)^<s><<ROLE>> (.*?) <</ROLE>> (.*) </s>$", 2)
        return (
            F.when(t.startswith("<s>[INST] "), F.struct(F.lit("user").alias("role"), unescape(cut(10, 8)).alias("text")))
            .when(t.startswith("<s><<SYS>> "), F.struct(F.lit("system").alias("role"), unescape(cut(11, 9)).alias("text")))
            .when(t.startswith("<s><<ROLE>> "), F.struct(unescape(other).alias("role"), unescape(said).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(cut(1, 5)).alias("text")))
        )

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), one)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def from_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record (key, record) for each conversation that is kept a turn to a row; turns of
    equal number are ordered by role and text. Such a record is one string in the end, so its rows
    have to meet in one place."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    turns = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("n"), c(role).alias("role"), c(text).alias("text")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.select(key, F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def format_report(rows: DataFrame) -> DataFrame:
    """Digests of all conversations, read back from what was formatted."""
    out = formatted(canonical(from_rows(rows))).select("conv_id", "layout", "formatted", "loss_spans")
    out = out.withColumns({"_t": parsed(F.col("formatted")), "_l": loss_text(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2(F.col("_l"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )

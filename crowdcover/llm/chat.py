"""Conversations of any layout as chat text with a loss mask.

Records come in many layouts: a prompt and a response, an instruction with an input and an output, a
list of messages whose fields go by several names. A record's *fingerprint* is the hash of its nested
field paths, without types and values. A table of declarative mappings says, per fingerprint, how
the turns are taken from such a record; a new layout is a new row, not new code. All of it is column
work in the JVM; fingerprints are constants of the plan, so no join is needed.

The template writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a
role or text is broken up by ``\\-`` after its first character, and a backslash becomes two, so that
no turn can open or close a turn, and every text can be read back exactly. The loss mask is a list of
spans of the formatted text, in code points: the texts of the turns by the assistant.

Spark's JSON functions give up on strings of 20 million characters. A record beyond ``LONG`` is read from
the same text without them: its strings are what stands between quotes, its fingerprint is that of the
record with all string values emptied, and an error is raised where its messages do not all have a
role and a text.

Defined cases: a record that isn't JSON, or whose fingerprint no mapping has, gets null turns, and
null in everything derived; a null text or role is empty; a conversation without turns is the empty
string. Turns with equal numbers are ordered by role and text; repeated rows are turns of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdcover.llm.common import let, unused

START, END = "<|im_start|>", "<|im_end|>"

#: Strings that tokenizers and chat templates give a meaning of their own.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<|system|>",
           "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|begin_of_text|>",
           "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<<SYS>>",
           "<</SYS>>", "[INST]", "[/INST]", "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


@dataclass(frozen=True)
class Mapping:
    """A layout, as an example record, and its turns: (role, path of the text, or None) in order, or
    one list of messages. A turn marked optional is left out where its text is empty."""

    name: str
    example: str
    turns: tuple[tuple[str, str, bool], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""


MAPPINGS = [
    Mapping("messages", '{"id":1,"messages":[{"role":"r","content":"t"}]}',
            messages="messages", role="role", text="content"),
    Mapping("turns", '{"id":1,"conversations":[{"from":"r","value":"t"}]}',
            messages="conversations", role="from", text="value"),
    Mapping("nested", '{"id":1,"dialog":{"turns":[{"speaker":{"role":"r"},"text":"t"}]}}',
            messages="dialog.turns", role="speaker.role", text="text"),
    Mapping("prompt", '{"id":1,"prompt":"t","response":"t"}',
            turns=(("user", "prompt", False), ("assistant", "response", False))),
    Mapping("instruction", '{"id":1,"system":"t","instruction":"t","output":"t"}',
            turns=(("system", "system", False), ("user", "instruction", False),
                   ("assistant", "output", False))),
    Mapping("alpaca", '{"instruction":"t","input":"t","output":"t"}',
            turns=(("user", "instruction", False), ("user", "input", True),
                   ("assistant", "output", False))),
]

#: Names that sources use for a role -> the canonical one.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Characters of a record beyond which no JSON function reads its texts.
LONG = 4_000_000


def without_texts(record: Column) -> Column:
    """A JSON text with all string values emptied; escapes in field names become question marks."""
    plain = F.regexp_replace(record, r"\\.", "?")
    # outside, inside, outside, ...: a colon behind the quotes tells a name
    return let(F.split(plain, '"'), lambda parts: F.array_join(F.transform(parts, lambda x, i: F.when(
        (i % 2 == 1) & ~F.coalesce(F.get(parts, i + 1), F.lit("")).rlike(r"^\s*:"), F.lit("")).otherwise(x)), '"'))


def paths_of(record: Column) -> Column:
    """The nested field paths of a JSON text: its schema with the kinds of the values taken out."""
    shape = F.schema_of_variant(F.try_parse_json(
        F.when(F.length(record) > LONG, without_texts(record)).otherwise(record)))
    return F.regexp_replace(shape, r": (?:STRING|VOID|BIGINT|BOOLEAN|DOUBLE|DECIMAL\([0-9,]*\)|VARIANT)"
                                   r"(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths_of(record))


def known_layouts(spark: SparkSession, mappings: list[Mapping]) -> dict[str, int]:
    """name -> fingerprint, from the example of every mapping."""
    found = spark.range(1).select(*[fingerprint(F.lit(m.example)).alias(m.name)
                                    for m in mappings]).first().asDict()
    if len(set(found.values())) < len(mappings):
        raise ValueError("two mappings have the same layout")
    return found


def _schema(path: str, leaf: str) -> str:
    """DDL of a struct that holds ``leaf`` at ``path``."""
    for name in reversed(path.split(".")):
        leaf = f"struct<`{name}`:{leaf}>"
    return leaf


# escapes of JSON that hide a quote or an escape, while a record is cut at its quotes
_SIGN, _QUOTE, _SLASH = "\ue000e", "\ue000q", "\ue000s"


def unescaped_json(text: Column) -> Column:
    """The text that stands between the quotes of a JSON string, whose escaped backslashes and quotes are
    ``_SLASH`` and ``_QUOTE``, and the sign these begin with ``_SIGN``."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    read = F.transform(F.regexp_extract_all(text, F.lit(f"({run})")), lambda e: F.from_json(
        F.concat(F.lit('["'), e, F.lit('"]')), "array<string>")[0])
    between = F.transform(F.split(text, run), lambda b: F.regexp_replace(F.regexp_replace(F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"\\n", "\n"), r"\\t", "\t"), r"\\r", "\r"),
        r"\\b", "\b"), r"\\f", "\f"), r"\\/", "/"))
    joined = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(read, i), F.lit("")))), "")
    out = F.replace(F.replace(joined, F.lit(_QUOTE), F.lit('"')), F.lit(_SLASH), F.lit("\\"))
    return F.replace(out, F.lit(_SIGN), F.lit(_SIGN[0]))


def fields_of(record: Column) -> Column:
    """array<struct<name, text>>: all fields of a JSON text in order, whatever they are nested in; the
    text is null where the value isn't a string."""
    safe = F.replace(record, F.lit(_SIGN[0]), F.lit(_SIGN))
    safe = F.replace(F.replace(safe, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def read(parts: Column) -> Column:  # outside, inside, outside, ...: names and texts have odd places
        places = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: (i % 2 == 1) & F.get(
            parts, i + 1).rlike(r"^\s*:"))
        return F.transform(places, lambda i: F.struct(
            F.get(parts, i).alias("name"),
            F.when(F.get(parts, i + 1).rlike(r"^\s*:\s*$"), unescaped_json(F.get(parts, i + 2))).alias("text")))

    return F.when(F.contains(record, F.lit('"')), let(F.split(safe, '"'), read))


def _long_turns(mapping: Mapping, record: Column) -> Column:
    """:func:`_turns` of a record of any length."""
    def texts(fields: Column, path: str) -> Column:
        name = path.rpartition(".")[2]
        return F.transform(F.filter(fields, lambda f: f["name"] == name), lambda f: F.coalesce(f["text"], F.lit("")))

    def read(fields: Column) -> Column:
        if not mapping.messages:
            return F.filter(F.array(*[F.struct(
                F.lit(role).alias("role"), F.coalesce(F.get(texts(fields, path), F.lit(0)), F.lit("")).alias("text"),
                (F.lit(not optional) | (F.coalesce(F.get(texts(fields, path), F.lit(0)), F.lit("")) != "")).alias("there"))
                for role, path, optional in mapping.turns]), lambda t: t["there"])
        canonical = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        both = F.struct(texts(fields, mapping.role).alias("r"), texts(fields, mapping.text).alias("t"))
        return let(both, lambda b: F.when(
            F.size(b["r"]) != F.size(b["t"]), F.raise_error(F.lit("a message without a role or a text")))
            .otherwise(F.transform(F.arrays_zip(b["r"].alias("r"), b["t"].alias("t")), lambda z: F.struct(
                F.coalesce(canonical[z["r"]], z["r"]).alias("role"), z["t"].alias("text")))))

    return F.transform(let(fields_of(record), read), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _turns(mapping: Mapping, record: Column) -> Column:
    """array<struct<role, text>> of a record that has the mapping's layout."""
    def one(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if mapping.messages:
        both = (_schema(mapping.role, "string"), _schema(mapping.text, "string"))
        inner = f"array<struct<{', '.join(s.removeprefix('struct<').removesuffix('>') for s in both)}>>"
        read = F.from_json(record, _schema(mapping.messages, inner))
        canonical = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

        def get(turn: Column, path: str) -> Column:
            for name in path.split("."):
                turn = turn[name]
            return turn

        def turn(t: Column) -> Column:
            role = F.coalesce(get(t, mapping.role), F.lit(""))
            return one(F.coalesce(canonical[role], role), get(t, mapping.text))

        return F.transform(get(read, mapping.messages), turn)
    fields = ", ".join(f"`{path}` string" for _, path, _ in mapping.turns)
    read = F.from_json(record, fields)
    return let(read, lambda r: F.filter(F.array(*[
        F.struct(F.lit(role).alias("role"), F.coalesce(r[path], F.lit("")).alias("text"),
                 (F.lit(not optional) | (F.coalesce(r[path], F.lit("")) != "")).alias("there"))
        for role, path, optional in mapping.turns]), lambda t: t["there"])).cast(
            "array<struct<role:string,text:string,there:boolean>>")


def canonical_turns(records: DataFrame, record: str = "record",
                    mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """``records`` with layout (the name of the mapping; null if none fits) and turns."""
    known = known_layouts(records.sparkSession, mappings)
    shape = fingerprint(F.col(record))
    layout = F.coalesce(*[F.when(shape == known[m.name], m.name) for m in mappings], F.lit(None))
    out = records.withColumn("layout", layout)
    turns = F.lit(None)
    for m in mappings:
        plain = F.transform(_turns(m, F.col(record)), lambda t: F.struct(
            t["role"].alias("role"), t["text"].alias("text")))
        mine = F.when(F.length(record) > LONG, _long_turns(m, F.col(record))).otherwise(plain)
        turns = F.when(F.col("layout") == m.name, mine).otherwise(turns)
    return out.withColumn("turns", turns)


def _pattern(strings: list[str]) -> str:
    """Finds the first character of every control string, and backslashes."""
    by_first: dict[str, list[str]] = {}
    for s in strings:
        by_first.setdefault(s[0], []).append("".join("\\" + c if not c.isalnum() and c != "_" else c
                                                     for c in s[1:]))
    parts = [f"(?:\\{first}(?={'|'.join(rest)}))" for first, rest in by_first.items()]
    return "|".join(parts)


def escaped(text: Column) -> Column:
    """``text`` without control strings; undone by :func:`unescaped`."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_pattern(CONTROL)})", r"$1\\-")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\-|\\(\\)", "$1")


def _role(role: Column) -> Column:
    """A role on one line: a line end in it becomes a backslash and ``n``."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unrole(role: Column) -> Column:
    # an odd run of backslashes before the n: pairs, and one that belongs to the n
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted(turns: DataFrame, column: str = "turns", trained: str = "assistant") -> DataFrame:
    """``turns`` with formatted (the chat text) and loss_spans (array<struct<start, length>>)."""
    def piece(t: Column) -> Column:
        return let(F.struct(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
                            escaped(t["text"]).alias("body"), (t["role"] == trained).alias("trained")),
                   lambda p: F.struct(F.concat(p["head"], p["body"], F.lit(END + "\n")).alias("all"),
                                      F.length(p["head"]).cast("long").alias("head"),
                                      F.length(p["body"]).cast("long").alias("body"),
                                      p["trained"].alias("trained")))

    size = len(END) + 1
    empty = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["head"]
        span = F.struct(start.alias("start"), p["body"].alias("length"))
        return F.struct((start + p["body"] + size).alias("at"), F.when(
            p["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    both = let(F.transform(F.col(column), piece), lambda ps: F.struct(
        F.array_join(F.transform(ps, lambda p: p["all"]), "").alias("formatted"),
        F.aggregate(ps, empty, step)["spans"].alias("loss_spans")))
    rest = turns.select(*[c for c in turns.columns if c.lower() not in ("formatted", "loss_spans")])
    chat, = unused(rest, "chat")
    return turns.withColumn(chat, both).select(
        *rest.columns, F.col(f"{chat}.formatted").alias("formatted"),
        F.col(f"{chat}.loss_spans").alias("loss_spans"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> from a formatted text."""
    def turn(body: Column) -> Column:
        return let(F.substring_index(body, "\n", 1), lambda role: F.struct(
            _unrole(role).alias("role"),
            unescaped(F.substr(body, F.length(role) + 2)).alias("text")))

    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    return F.transform(parts, lambda p: let(F.substr(p, F.lit(len(START) + 1)), turn))


def under_mask(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, span by span."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(
        text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")

"""Chat formatting: records of any layout become turns, and turns one text with a mask.

A record's nested field paths (``messages[].role``, ``prompt``) are hashed: that is its
schema's fingerprint. A table of fingerprints, made from declarative layouts, names the
layout by which the record is read into turns (role, text). No layout is guessed from a
field's content, and a record that no layout fits stays, with its fingerprint and with
null turns. All of it is built-in functions: no Python runs for rows.

The template is one turn after another, each ``<|im_start|>``, role, a line feed, text,
``<|im_end|>``, a line feed. In texts a backslash is doubled and a ``|`` behind ``<`` gets
a backslash, so that no text holds a control string; roles are URL-encoded. Both are
undone by ``turns_of``. The mask: ``segments`` are the formatted text cut into pieces
(text, loss); loss is true for the assistant's texts and nothing else.

Edge cases: null roles and texts are empty ones; an empty list of turns gives an empty
text; rows of a conversation go by turn (null first), then role, then text, and repeated
rows stay repeated; rows without a conversation's id are one conversation; very long
texts are worked on whole, but a conversation has to fit in one row; an empty table
gives no conversations; fields that no layout knows, of whatever name, change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from .common import named, table, unused

# fixed values: the template's control strings
START, END = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records of one kind are read: either ``turns`` names an array whose elements
    have a role and a text (``names`` translates roles), or ``parts`` lists roles, each
    with the fields whose texts make its turn. Of parts, those in ``optional`` may be absent."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    names: tuple[tuple[str, str], ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()

    def fields(self) -> list[str]:
        return [self.turns] if self.turns else [f for _, fields in self.parts for f in fields]

    def paths(self) -> Iterator[frozenset[str]]:
        """Every set of paths that a record of this layout may have."""
        if self.turns:
            must, may = {f"{self.turns}[]"}, {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        else:
            may = {f for f in self.fields() if f in self.optional}
            must = set(self.fields()) - may
        for n in range(len(may), -1, -1):
            for some in combinations(sorted(may), n):
                yield frozenset(must | set(some))


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages", turns="messages"),
    Layout("rows", turns="messages", text="text"),
    Layout("shared", turns="conversations", role="from", text="value", names=_NAMES),
    Layout("contents", turns="contents", text="text", names=_NAMES),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system", "input", "output"})),
    Layout("prompt", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system", "response"})),
    Layout("completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"context", "answer"})),
)


def _digest(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _known(layouts) -> list[str]:
    return sorted({p for one in layouts for paths in one.paths() for p in paths})


def fingerprint(paths: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of those paths that any layout knows."""
    known = F.array_intersect(paths, F.array(*map(F.lit, _known(layouts))))
    return F.sha2(F.array_join(F.array_sort(known), "\n"), 256)


def typed_paths(schema: StructType) -> Column:
    """array<string>: a row's nested field paths. A column or field is there if it isn't
    null; an array's element's field is, if any element has it."""

    def walk(value: Column, kind: DataType, path: str) -> list[Column]:
        if isinstance(kind, StructType):
            inner = [p for f in kind.fields for p in walk(value.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
            return inner
        if isinstance(kind, ArrayType):
            own = F.when(value.isNotNull(), F.array(F.lit(f"{path}[]"))).otherwise(F.array().cast("array<string>"))
            inner = F.flatten(F.transform(value, lambda x: F.concat(*(walk(x, kind.elementType, f"{path}[]") or [F.array().cast("array<string>")])))) if isinstance(kind.elementType, (StructType, ArrayType)) else None
            return [own] if inner is None else [own, F.coalesce(F.array_distinct(inner), F.array().cast("array<string>"))]
        return [F.when(value.isNotNull(), F.array(F.lit(path))).otherwise(F.array().cast("array<string>"))]

    found = [p for f, c in zip(schema.fields, named(schema.names)) for p in walk(c, f.dataType, f.name)]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def json_paths(json: Column) -> Column:
    """array<string>: nested field paths of a JSON text, from the type that Spark finds for
    it: null for what is no JSON. Fields that hold null only aren't there."""
    ddl = F.schema_of_variant(F.try_parse_json(json))
    tokens = F.regexp_extract_all(ddl, F.lit(r"(`(?:[^`]|``)*`:|[A-Za-z_][A-Za-z_0-9]*:|OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\(\d+,\d+\))?)"), 0)
    state = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, token: Column) -> Column:
        def made(stack: Column, at: Column, out: Column) -> Column:
            return F.struct(stack.alias("stack"), at.alias("at"), out.alias("out"))

        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, ":$", ""), "^`|`$", ""), "``", "`")
        inside = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        element = F.concat(s["at"], F.lit("[]"))
        return (
            F.when(token == "OBJECT<", made(F.array_append(s["stack"], inside), s["at"], s["out"]))
            .when(token == "ARRAY<", made(F.array_append(s["stack"], s["at"]), element, F.array_append(s["out"], element)))
            .when(token == ">", made(F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))), s["at"], s["out"]))
            .when(token.endswith(":"), made(s["stack"], F.concat(F.element_at(s["stack"], -1), name), s["out"]))
            .when(token == "VOID", s).otherwise(made(s["stack"], s["at"], F.array_append(s["out"], s["at"])))
        )

    return F.when(ddl.isNotNull(), F.array_distinct(F.aggregate(tokens, state, step, lambda s: s["out"])))


def _turns(layout: Layout, field) -> Column | None:
    """A record's turns by a layout; field(name, kind) gives a field as that type, or None."""
    if layout.turns:
        found = field(layout.turns, (layout.role, layout.text))
        if found is None:
            return None

        def turn(m: Column) -> Column:
            role = F.coalesce(m[layout.role].cast("string"), F.lit(""))
            for theirs, ours in layout.names:
                role = F.when(role == theirs, ours).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(m[layout.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(found, turn)
    made = []
    for role, names in layout.parts:
        texts = [x for x in (field(n, None) for n in names) if x is not None]
        if len(texts) < len(names) - sum(n in layout.optional for n in names):
            return None
        if texts:
            text = F.array_join(F.array_compact(F.array(*texts)), "\n\n")
            made.append(F.when(F.coalesce(*texts).isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*made)).cast(_TURNS)


def _chosen(df: DataFrame, paths: Column, field, layouts: tuple[Layout, ...]) -> DataFrame:
    """Adds fingerprint, layout and turns."""
    kinds = {}
    for one in reversed(layouts):  # the first that fits counts
        kinds |= {_digest(p): one.name for p in one.paths()}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    turns = F.lit(None).cast(_TURNS)
    df = df.withColumn("fingerprint", fingerprint(paths, layouts)).withColumn("layout", F.element_at(names, F.col("fingerprint")))
    for one in layouts:
        if (found := _turns(one, field)) is not None:
            turns = F.when(F.col("layout") == one.name, found).otherwise(turns)
    return df.withColumn("turns", turns)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout (null: none fits) and turns to records of typed columns;
    columns of these names are replaced."""
    records = records.drop("fingerprint", "layout", "turns")
    kinds = {f.name: f.dataType for f in records.schema.fields}

    def field(name: str, inner):
        kind = kinds.get(name)
        if inner is None:
            return F.col(name) if isinstance(kind, StringType) else None
        fits = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and set(inner) <= set(kind.elementType.names)
        return F.col(name) if fits else None

    return _chosen(records, typed_paths(records.schema), field, layouts)


def canonical_json(records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The same for records that are JSON texts in a column. Texts that are no JSON fit no layout."""
    records = records.drop("fingerprint", "layout", "turns")
    paths, parsed = unused("_paths", records.columns), unused("_parsed", records.columns)
    rows = records.withColumns({paths: json_paths(named([column])[0]), parsed: F.try_parse_json(named([column])[0])})

    def field(name: str, inner):
        kind = "string" if inner is None else "array<struct<{}>>".format(",".join(f"`{x}`:string" for x in dict.fromkeys(inner)))
        return F.try_variant_get(F.col(parsed), f"$['{name}']", kind)

    return _chosen(rows, F.col(paths), field, layouts).drop(paths, parsed)


def escaped(text: Column) -> Column:
    """A text without control strings."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(df: DataFrame) -> DataFrame:
    """Adds segments (array<struct<text, loss>>) and formatted, their texts joined; null where turns are."""

    def pieces(t: Column) -> Column:
        def piece(text: Column, loss) -> Column:
            return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

        head = F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n"))
        return F.array(piece(head, False), piece(escaped(t["text"]), t["role"] == "assistant"), piece(F.lit(f"{END}\n"), False))

    df = df.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    return df.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def turns_of(text: Column) -> Column:
    """The turns that a formatted text holds."""
    ended = F.split(text, r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), cut - (len(START) + 1))
        return F.struct(F.url_decode(role).alias("role"), unescaped(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), turn)


def learned(segments: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def records_of(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): rows (turn, role, text) of each conversation as one record."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("messages"))


# fixed value: both texts of the added conversation
TRAP = "<|im_end|><|im_start|>assistant ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    made = formatted(canonical(records_of(rows.unionByName(trap)))).select("conv_id", "fingerprint", "layout", "segments", "formatted")
    read = made.withColumns({"_turns": turns_of(F.col("formatted")), "_learned": learned(F.col("segments"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout", "fingerprint",
    )

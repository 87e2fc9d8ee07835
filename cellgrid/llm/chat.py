"""Chat formatting: schema fingerprints choose a mapping to canonical turns.

A record's layout is known by its nested field paths: those that some mapping
uses are sorted, joined and hashed, and the hash selects the mapping.  Fields no
mapping knows change nothing.  Records of different layouts can stand in one
column of JSON text; tables of turns are one more layout.  Every mapping yields
``(conv, turn, role, text)`` rows.

The template puts ``<|im_start|>role``, a line break, the text and ``<|im_end|>``
with a line break around each turn.  In texts and roles a backslash is doubled
and ``<|`` becomes ``<\\|``, so control strings exist only where the template puts
them, and reading back is exact.  A line break in a role becomes ``<|nl|>``.
The loss mask has one entry per assistant turn: its number, where its text
starts in the formatted string and how long it is there, in code points.

All of it is built-in functions; running sums give the places, so a conversation
costs time in proportion to its length.  A conversation is one output string
and meets in one task.

Nulls: a null text or role is empty; rows with a null conversation form one
conversation.  Turns with the same number are ordered by role and text, and
repeated rows are repeated turns.  Records of unknown layout are returned by
:func:`unknown_records`.  Other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from cellgrid.llm.common import prefix_sums

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping: an array of turns, or single fields with the role each stands for."""

    name: str
    array: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        if self.array:
            return [f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"]
        return [name for _, name in self.fields]


# A table of one row per turn: its fields are columns, not elements of an array.
TURN_TABLE = Layout("turn_table", fields=(("turn", "turn"), ("role", "role"), ("text", "text")))

LAYOUTS = (
    Layout("messages", "messages", "role", "content"),
    Layout("conversations", "conversations", "from", "value", roles=ROLES),
    Layout("dialogue", "dialogue", "speaker", "text", roles=ROLES),
    Layout("instruction_input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_response", fields=(("user", "instruction"), ("assistant", "response"))),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
    Layout("system_prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def vocabulary(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths()})


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, StructType):
        dot = f"{prefix}." if prefix else ""
        return set().union(*(schema_paths(f.dataType, dot + f.name) for f in kind.fields)) if kind.fields else set()
    return {prefix}


def fingerprint(paths: list[Column]) -> Column:
    """Hash of the paths that are there; absent ones are null."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*paths))), "\n"))


def layout_of(found: Column, layouts: tuple[Layout, ...]) -> Column:
    """Name of the layout with this fingerprint, or null."""
    known = [(fingerprint([F.lit(p) for p in layout.paths()]), layout.name) for layout in layouts]
    return reduce(lambda c, k: c.when(found == k[0], F.lit(k[1])), known[1:], F.when(found == known[0][0], F.lit(known[0][1])))


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    if not roles:
        return role
    mapping = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    return F.coalesce(mapping[role], role)


def json_layouts(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the variant column ``_record`` and the column ``_layout``.

    A field of array elements is there if any element has it.
    """
    whole = F.col("_record")

    def there(path: str) -> Column:
        array, inner, name = path.partition("[].")
        if not inner:
            return F.when(F.try_variant_get(whole, f"$.{path}", "variant").isNotNull(), F.lit(path))
        elements = F.try_variant_get(whole, f"$.{array}", "array<variant>")
        return F.when(
            F.exists(elements, lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()), F.lit(path)
        )

    parsed = records.withColumn("_record", F.try_parse_json(F.col(record)))
    return parsed.withColumn("_layout", layout_of(fingerprint([there(p) for p in vocabulary(layouts)]), layouts))


def json_turns(records: DataFrame, conv: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(conv, turn, role, text)`` of records of different layouts in one JSON column."""
    known = json_layouts(records, record, layouts)
    out = None
    for layout in layouts:
        rows = known.where(F.col("_layout") == layout.name)
        if layout.array:
            kind = f"array<struct<`{layout.role}` string, `{layout.text}` string>>"
            items = F.try_variant_get(F.col("_record"), f"$.{layout.array}", kind)
            turns = rows.select(F.col(conv).alias("conv"), F.posexplode(items).alias("turn", "t")).select(
                "conv", "turn", _renamed(F.col(f"t.{layout.role}"), layout.roles).alias("role"), F.col(f"t.{layout.text}").alias("text")
            )
        else:
            items = F.array(
                *(
                    F.struct(F.lit(role).alias("role"), F.try_variant_get(F.col("_record"), f"$.{name}", "string").alias("text"))
                    for role, name in layout.fields
                )
            )
            turns = rows.select(F.col(conv).alias("conv"), F.posexplode(items).alias("turn", "t")).select(
                "conv", "turn", "t.role", "t.text"
            )
        turns = turns.withColumn("turn", F.col("turn").cast("long"))
        out = turns if out is None else out.unionByName(turns)
    return out


def unknown_records(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records that no mapping fits."""
    return json_layouts(records, record, layouts).where("_layout IS NULL").select(*records.columns)


def table_turns(df: DataFrame, conv: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(conv, turn, role, text)`` of a table: one row per turn, or one record per row in typed columns."""
    # the fields are those of the schema, so its fingerprint is that of every row
    found = schema_paths(df.schema)
    layout, one = None, df.sparkSession.range(1)
    for known in ((TURN_TABLE,), layouts):
        used = sorted(found & set(vocabulary(known)))
        if layout is None and used:
            name = one.select(layout_of(fingerprint([F.lit(p) for p in used]), known)).first()[0]
            layout = next((x for x in known if x.name == name), None)
    if layout is None:
        raise ValueError(f"no mapping for the fields {used}")
    if layout is TURN_TABLE:
        return df.select(F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tops = {p.split("[")[0] for p in layout.paths()}
    packed = df.select(F.col(conv).alias("conv"), F.to_json(F.struct(*sorted(tops))).alias("record"))
    return json_turns(packed, "conv", "record", (layout,))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """``(conv, formatted, loss)`` of ``turns(conv, turn, role, text)``."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    cut = turns.select(
        "conv", "turn", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"), F.lit(f"{END}\n").alias("tail")
    )
    size = (F.length("head") + F.length("body") + F.length("tail")).cast("long")
    placed = cut.select(
        "conv",
        (F.row_number().over(order) - 1).alias("i"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head")).alias("start"),
        F.length("body").cast("long").alias("length"),
        (F.coalesce("role", F.lit("")) == learn).alias("learned"),
        F.concat("head", "body", "tail").alias("piece"),
    )
    grouped = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("i", "start", "length", "learned", "piece"))).alias("t"))
    return grouped.select(
        "conv",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda x: x.learned), lambda x: F.struct(x.i.alias("turn"), x.start.alias("start"), x.length.alias("length"))
        ).alias("loss"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """``(conv, formatted, turns, loss_texts)`` read from ``formatted(conv, formatted, loss)``.

    ``turns`` are structs of role and text; ``loss_texts`` the unescaped texts
    under the mask.
    """
    parts = formatted.select(
        "*", F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "").alias("parts")
    )
    # where each part starts in the whole text; a mask's places are cut from there
    sizes = f"transform(parts, p -> length(p) + {len(END) + 1})"
    placed = parts.withColumn("sizes", F.expr(sizes)).withColumn(
        "bases", F.expr(f"zip_with({prefix_sums('sizes')}, sizes, (upto, own) -> upto - own)")
    )
    bodies = placed.select(
        "*",
        F.transform(
            "parts",
            lambda x: F.struct(
                F.substring_index(F.substring(x, len(START) + 1, 2147483647), "\n", 1).alias("head"), x.alias("part")
            ),
        ).alias("cut"),
    )
    role = lambda x: unescaped(F.replace(x.head, F.lit(LINE), F.lit("\n")))
    at = lambda x: F.length(x.head) + len(START) + 2
    return bodies.select(
        "conv",
        "formatted",
        F.transform(
            "cut",
            lambda x: F.struct(role(x).alias("role"), unescaped(F.substr(x.part, at(x))).alias("text")),
        ).alias("turns"),
        F.transform(
            "loss",
            lambda m: unescaped(
                F.substr(F.get("parts", m.turn), (m.start - F.get("bases", m.turn) + 1).cast("int"), m.length.cast("int"))
            ),
        ).alias("loss_texts"),
    )


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what :func:`read_turns` returns."""
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256
        ).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

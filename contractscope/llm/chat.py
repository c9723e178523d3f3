"""Chat formatting: schema fingerprints choose declarative mappings; a reversible template marks the turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that steer a chat model in widespread templates, and this template's own.
CONTROLS = ["<|turn|>", "<|end|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|user|>", "<|assistant|>", "<|system|>"]
TURN, END = "<|turn|>", "<|end|>\n"

#: Layout -> how its records become turns. A mapping names the fields that hold a list of turns (list, role, text), or
#: for each turn the role and the fields whose non-empty texts make it, or the columns of rows that are turns.
LAYOUTS: dict[tuple[str, ...], dict] = {
    ("role", "text", "turn"): {"rows": ("turn", "role", "text")},
    ("messages[].content", "messages[].role"): {"list": ("messages", "role", "content")},
    ("conversations[].from", "conversations[].value"): {"list": ("conversations", "from", "value")},
    ("prompt", "response"): {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    ("prompt", "completion"): {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    ("instruction", "output"): {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    ("input", "instruction", "output"): {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    ("instruction", "output", "system"): {"turns": [("system", ["system"]), ("user", ["instruction"]), ("assistant", ["output"])]},
}
#: Role names of other layouts -> canonical ones; unknown roles stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema, `[]` for a list's items, sorted."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\x00".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(k): v for k, v in LAYOUTS.items()}


def _role(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c), c)


def to_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table in any known layout.

    The layout is found by the fingerprint of the field paths besides the id. If columns are left over, the known
    layout with the most fields that are all present is used, so extra columns do no harm. An unknown layout raises
    ValueError. Null texts become empty; empty optional fields (such as an instruction's input) are left out.
    """
    paths = [p for p in field_paths(df.schema) if p != conv_id]
    spec = MAPPINGS.get(fingerprint(paths))
    if spec is None:
        inside = [k for k in LAYOUTS if set(k) <= set(paths)]
        if not inside:
            raise ValueError(f"no mapping for the fields {paths}")
        spec = LAYOUTS[max(inside, key=lambda k: (len(k), k))]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if "rows" in spec:
        turn, role, body = spec["rows"]
        return df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"), text(F.col(body)).alias("text"))
    if "list" in spec:
        field, role, body = spec["list"]
        made = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(field).alias("turn", "m"))
        return made.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col(f"m.{role}")).alias("role"), text(F.col(f"m.{body}")).alias("text"))
    turns = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*[text(F.col(f)) for f in fields]), lambda x: x != ""), "\n\n").alias("text"), F.lit(r == "system").alias("optional")) for r, fields in spec["turns"]]
    kept = F.filter(F.array(*turns), lambda t: ~t.optional | (t.text != ""))
    made = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(kept).alias("turn", "m"))
    return made.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


_CONTROL = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in sorted(CONTROLS, key=len, reverse=True))


def escape(c: Column) -> Column:
    """Double each backslash and put one after the first character of every control string."""
    doubled = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """Add the formatted segment of each turn and the part of it that is under the loss mask, in code points.

    segment is `<|turn|>role`, a line end, the escaped text, `<|end|>` and a line end; a conversation's segments in
    order of turn make its formatted text. loss_start and loss_end are null for turns that are not the assistant's.
    A null role is written as an empty one. No control string of a text is left in a segment.
    """
    role = F.regexp_replace(escape(F.coalesce("role", F.lit(""))), "\n", r"\\" + "\n")
    head, body = F.concat(F.lit(TURN), role, F.lit("\n")), escape(F.coalesce("text", F.lit("")))
    learnt = F.col("role") == "assistant"
    made = turns.withColumns({"_head": head, "_body": body})
    made = made.withColumn("segment", F.concat("_head", "_body", F.lit(END)))
    made = made.withColumn("loss_start", F.when(learnt, F.char_length("_head").cast("long")))
    return made.withColumn("loss_end", F.when(learnt, (F.char_length("_head") + F.char_length("_body")).cast("long"))).drop("_head", "_body")


def parse_segment(segment: str) -> tuple[str, str]:
    """(role, text) read back from a formatted turn; ValueError if it isn't one."""
    if not segment.startswith(TURN) or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    m = re.match(r"((?:[^\\\n]|\\.)*)\n(.*)\Z", segment[len(TURN) : -len(END)], flags=re.DOTALL)
    if not m:
        raise ValueError("a turn without a head line")
    return unescape(m[1]), unescape(m[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments are dealt by conversation and sorted on disk if need be; a task then reads them one by one and keeps
    only the running digests, so a conversation of any number of turns needs no more memory. Turns that share a
    number are ordered by role and text; null turn numbers come first.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fresh, out = None, True, []
        n = chars = loss = 0
        whole, learnt = hashlib.sha256(), hashlib.sha256()

        def flush() -> None:
            out.append((key, n, whole.hexdigest(), loss, learnt.hexdigest(), chars))

        for batch in batches:
            for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if fresh or conv != key:
                    if not fresh:
                        flush()
                    key, fresh, n, chars, loss, whole, learnt = conv, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = parse_segment(segment)
                whole.update(f"{role}\n{text}\n".encode())
                n, chars = n + 1, chars + len(segment)
                if start is not None:
                    part = unescape(segment[start:end])
                    learnt.update(part.encode())
                    loss += len(part)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, batch.schema.field(0).type) for i, x in enumerate(zip(*out, strict=True))], names=names)
                out = []
        if not fresh:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, batch.schema.field(0).type) for i, x in enumerate(zip(*out, strict=True))], names=names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all earlier turns as context, then the reply, the
only part that is trained on. Turns after the last reply would be in no example, so they form a last
example without a trained part. Markers surround each turn, and a marker inside a role or a text is
broken by a backslash, so that the output can be read back exactly.

A conversation's turns are streamed in order through one task and never gathered; an example is one
string by nature, so the largest example bounds the memory.

Defined results: null role or text counts as empty; rows without conv_id form one conversation; a
null turn comes first, equal turns are ordered by role, then text, and repeated rows all count; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# The control strings of a public chat template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>\n"

EXAMPLES = "conv_id string, example long, target_turn string, text string, loss_start long, loss_end long"
DIGESTS = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
#: Characters in a batch of examples before it is handed on.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Each conversation's rows in one partition, in order."""
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("string"), "role", "text")


def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns, ordered, to examples."""
    names = [f.split()[0] for f in EXAMPLES.split(", ")]
    out: list[tuple] = []
    held, key, context, n, pending = 0, object(), "", 0, False
    for batch in batches:
        for conv, turn, role, text in zip(batch["conv_id"], batch["turn"], batch["role"], batch["text"], strict=True):
            if conv != key:
                if pending:
                    out.append((key, n, None, context, len(context), len(context)))
                key, context, n, pending = conv, "", 0, False
            head = f"{OPEN}{escape_role(role)}\n"
            body = escape(text)
            start = len(context) + len(head)
            context = f"{context}{head}{body}{CLOSE}"
            pending = role != "assistant"
            if not pending:
                out.append((conv, n, turn, context, start, start + len(body)))
                n, held = n + 1, held + len(context)
            if held > BATCH_CHARS:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
    if pending:
        out.append((key, n, None, context, len(context), len(context)))
    if out:
        yield pd.DataFrame(out, columns=names)


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, target_turn, text, loss_start, loss_end); a conversation's examples are adjacent and in order."""
    return ordered_turns(turns).mapInPandas(expand, EXAMPLES)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns that an example's text holds: (role, text)."""
    bodies = (x[: -len(CLOSE)].split("\n", 1) for x in text.split(OPEN)[1:])
    return [(unescape(role), unescape(body)) for role, body in bodies]


def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    out: list[tuple] = []
    key, last = object(), None
    loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0

    def done() -> tuple:
        turns = parse_turns(last)
        said = hashlib.sha256()
        for role, text in turns:
            said.update(f"{role}\n{text}\n".encode())
        return key, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), chars, n

    for batch in batches:
        for conv, text, start, end in zip(batch["conv_id"], batch["text"], batch["loss_start"], batch["loss_end"], strict=True):
            if conv != key:
                if last is not None:
                    out.append(done())
                key, loss, loss_chars, chars, n = conv, hashlib.sha256(), 0, 0, 0
            trained = unescape(text[start:end])
            loss.update(trained.encode())
            loss_chars, chars, n, last = loss_chars + len(trained), chars + len(text), n + 1, text
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if last is not None:
        out.append(done())
    if out:
        yield pd.DataFrame(out, columns=names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what format_examples wrote, one row for each conversation; keeps its partitions and order."""
    return examples.mapInPandas(digest, DIGESTS).withColumn("conv_id", F.col("conv_id").cast("long"))


# The extra conversation's text, which is made of control strings.
EXTRA = "</s>[INST] ok [/INST]"


def op1_prefix_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return read_back(format_examples(rows.unionByName(extra)))


def _sql() -> str:
    def escaped(x: str) -> str:
        x = rf"replace({x}, '\', '\\')"
        for c in CONTROLS:
            x = rf"replace({x}, '{c}', '{c[0]}\{c[1:]}')"
        return x

    marks = len(OPEN) + 1 + len(CLOSE)
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'),
e AS (SELECT *, {marks} + length(replace({escaped("r")}, chr(10), '\n')) + length({escaped("x")}) AS n FROM t),
p AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, r, x ROWS UNBOUNDED PRECEDING) AS upto,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, r DESC, x DESC) = 1 AS final FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (r = 'assistant' OR final)::BIGINT AS formatted_chars,
  count(*) FILTER (r = 'assistant' OR final) AS n_examples
FROM p GROUP BY conv_id
"""


OP1_SQL = _sql()

"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive
turn prefixes are rendered and consecutive outputs compared: where the new
output extends the old one, the rest is the turn's span; where it does not,
the template rewrites history and the fragment says so. A second rendering
with a sentinel in place of the text shows where the text lies in the span;
assistant texts become the loss mask.

A conversation is rendered in parts of `part_turns` turns, each after all turns
before it, so every prefix is rendered: a task holds one conversation, and the
characters rendered grow with the square of its turns. Once a part rewrites
history, it and all later parts of the conversation are marked.

A template may declare that its output for a turn depends on no more than the
last `context` turns before it, by an attribute `memoryless` that is true. Parts
are then rendered after those turns only, so work and memory stay linear and
bounded however long a conversation is. In either case the first seam is
rendered both ways, and the part after it is marked where they differ: such a
template must not be declared memoryless.

Defined results: null roles and texts are empty; a null conversation id is one
conversation; rows of a conversation are ordered by turn (nulls first), then
role, then text; repeated rows are turns of their own; an empty table gives no
fragment; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

Turn = tuple[str, str]
SENTINEL = "﷐"
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*)</turn>\n", re.S)


def escape(text: str, more: str = "") -> str:
    for x in "\\#<" + more:
        text = text.replace(x, "\\" + x)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def plain_template(turns: list[Turn]) -> str:
    """`### role: text</turn>` lines; `\\`, `#` and `<` inside texts (and `:` in roles) get a backslash."""
    return "".join(f"### {escape(role, ':')}: {escape(text)}</turn>\n" for role, text in turns)


plain_template.memoryless = True


def parse_plain(text: str) -> Iterator[Turn]:
    """The turns of plain_template's output."""
    at = 0
    while at < len(text):
        found = TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


def render_part(template: Callable[[list[Turn]], str], context: list[Turn], turns: list[Turn], loss_role: str) -> dict:
    """The text that turns add after context, each turn's span in it, the loss spans, and whether history was rewritten."""
    base = before = template(context) if context else ""
    spans, loss, rewrites = [], [], False
    seen = list(context)
    for role, text in turns:
        after = template([*seen, (role, text)])
        if not after.startswith(before):
            rewrites = True
        spans.append((len(before) - len(base), len(after) - len(base)))
        if role == loss_role:
            probe = template([*seen, (role, SENTINEL)])
            a = probe.find(SENTINEL, len(before) if after.startswith(before) else 0)
            tail = len(probe) - a - len(SENTINEL)
            if a < 0 or after[:a] != probe[:a] or (tail and after[-tail:] != probe[-tail:]) or len(after) - tail < a:
                rewrites = True
            else:
                loss.append((a - len(base), len(after) - tail - len(base)))
        seen.append((role, text))
        before = after
    if not before.startswith(base):
        rewrites, base = True, ""
    return {"text": before[len(base) :], "spans": spans, "loss": loss, "rewrites": rewrites}


FRAGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("turn_starts", pa.list_(pa.int64())), ("turn_ends", pa.list_(pa.int64())), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("rewrites", pa.bool_())])
FRAGMENTS_DDL = "conv_id long, part long, text string, n_turns long, turn_starts array<long>, turn_ends array<long>, loss_starts array<long>, loss_ends array<long>, rewrites boolean"


def format_chats(rows: DataFrame, template: Callable[[list[Turn]], str] = plain_template, part_turns: int = 32, context: int = 2, loss_role: str = "assistant") -> DataFrame:
    """Fragments of formatted conversations; a conversation's text is its fragments' texts in the order of part, unless one rewrites."""
    C.small_batches(rows.sparkSession)
    windowed = getattr(template, "memoryless", False)

    def recent(turns: list[Turn]) -> list[Turn]:
        return turns[-context:] if context else []

    def differs(earlier: list[Turn], turns: list[Turn], text: str) -> bool:
        """Whether the turns' text (after the last or all earlier turns) is another when rendered the other way."""
        before = earlier if windowed else recent(earlier)
        return template(before + turns)[len(template(before)) if before else 0 :] != text

    def run(batches):
        conv, part, earlier, turns, rewritten = object(), 0, [], [], False

        def close():
            nonlocal part, earlier, turns, rewritten
            got = render_part(template, recent(earlier) if windowed else earlier, turns, loss_role)
            rewritten = rewritten or got["rewrites"]
            seam = part == 1 and differs(earlier, turns, got["text"])
            row = {"conv_id": conv, "part": part, "text": got["text"], "n_turns": len(turns), "turn_starts": [a for a, _ in got["spans"]], "turn_ends": [b for _, b in got["spans"]], "loss_starts": [a for a, _ in got["loss"]], "loss_ends": [b for _, b in got["loss"]], "rewrites": rewritten or seam}
            # a declared template's second part still needs the first one whole
            earlier = recent(earlier + turns) if windowed and part else earlier + turns
            turns, part = [], part + 1
            return row

        for batch in batches:
            out = []
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if c != conv:
                    if turns:
                        out.append(close())
                    conv, part, earlier, turns, rewritten = c, 0, [], [], False
                elif len(turns) == part_turns:
                    out.append(close())
                turns.append((role, text))
            yield pa.RecordBatch.from_pylist(out, FRAGMENTS)
        if turns:
            yield pa.RecordBatch.from_pylist([close()], FRAGMENTS)

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), C.no_nul(F.col("text")).alias("text"))
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FRAGMENTS_DDL)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest_chats(fragments: DataFrame, parse: Callable[[str], Iterator[Turn]] = parse_plain) -> DataFrame:
    """Reads formatted conversations back: turns from the text, the loss text from the mask."""

    def run(batches):
        conv, now = object(), None

        def close():
            return {"conv_id": conv, "n_turns": now[0], "turns_sha256": now[1].hexdigest(), "loss_chars": now[2], "loss_sha256": now[3].hexdigest(), "formatted_chars": now[4]}

        for batch in batches:
            out = []
            for c, text, starts, ends in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "text", "loss_starts", "loss_ends")], strict=True):
                if c != conv or now is None:
                    if now:
                        out.append(close())
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[0] += 1
                    now[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    now[2] += len(said)
                    now[3].update(said.encode())
                now[4] += len(text)
            yield pa.RecordBatch.from_pylist(out, DIGEST)
        if now:
            yield pa.RecordBatch.from_pylist([close()], DIGEST)

    ordered = fragments.select("conv_id", "part", "text", "loss_starts", "loss_ends").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds: both turns say what the template uses itself.
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return digest_chats(C.written(format_chats(rows.unionByName(probe)), "chats"))


OP10_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:]', '', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

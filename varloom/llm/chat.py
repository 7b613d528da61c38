"""Chat formatting with templates that are black boxes: successive prefixes of turns are rendered and compared."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
#: Turns and characters of a part; a turn with more is a part of its own.
PART_TURNS, PART_CHARS = 64, 1 << 20
#: Two texts that differ everywhere: where the renderings of both differ is the place of the text.
PROBES = ("\ue000", "\ue001")
HEADS = {"user": "User", "assistant": "Assistant", "system": "System"}
CONTROL = re.compile(r"\\|#(?=#)|<(?=/turn>)")
HEAD = re.compile(r"### (?:(User|Assistant|System)|role=((?:[^\\:]|\\.)*)): ", re.DOTALL)
END = " </turn>\n"
SPANS = "array<struct<role string, start bigint, stop bigint, text_start bigint, text_stop bigint, loss boolean>>"


@dataclass(frozen=True)
class Template:
    """A function from turns (role, text) to a text.  ``turnwise`` says that it renders each turn for itself, one after another,
    so that long conversations may be rendered in parts; each turn of a part is held against that."""

    render: Callable[[list[Turn]], str]
    turnwise: bool = False


@dataclass
class Sample:
    """A rendering, and the spans of its turns: (role, start, stop, start of its text, stop of its text)."""

    formatted: str
    spans: list[tuple] = field(default_factory=list)
    rewritten: bool = False


def escape(text: str) -> str:
    """The text with a backslash put behind each backslash, each # before a #, and the < of each ``</turn>``: no ## and no ``</turn>`` is left."""
    return CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(turns: list[Turn]) -> str:
    """``### Role: text </turn>`` and a line end for each turn, texts (and other roles, ``role=...``) escaped."""
    heads = (HEADS.get(role) or "role=" + escape(role).replace(":", "\\:") for role, _ in turns)
    return "".join(f"### {head}: {escape(text)}{END}" for head, (_, text) in zip(heads, turns, strict=True))


def read_marked(output: str) -> list[Turn]:
    """The turns that ``marked`` made ``output`` of."""
    known = {v: k for k, v in HEADS.items()}
    turns = []
    for piece in output.split(END)[:-1]:
        head = HEAD.match(piece)
        turns.append((known[head[1]] if head[1] else unescape(head[2]), unescape(piece[head.end() :])))
    return turns


MARKED = Template(marked, turnwise=True)


def common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def located(template: Template, turns: list[Turn]) -> list[Sample]:
    """The samples of a conversation: one, or one more for each turn whose rendering changes what was there before.

    Each prefix of the turns is rendered.  Where it departs from the rendering before, the new turn starts; a change behind the end of
    the last text is a closing that moves, a change before it rewrites history.  Then the rendering before is a sample
    of its own, with the spans of the turns since the last change, and a new one begins: a turn's span is always that of the
    rendering in which it is the newest or nothing has changed since, and each turn has one.  A turn's text lies where the renderings of two probes in its place
    differ; if they differ in several places, or the rest depends on the text, it has no place (None).
    The start of a turn that rewrites history is None.
    """
    samples, now, closed = [Sample("")], "", 0
    for k, (role, text) in enumerate(turns):
        before, now = now, template.render(turns[: k + 1])
        if template.turnwise and now != before + template.render([(role, text)]):
            raise ValueError(f"the template does not render turn {k} for itself, as it is said to do")
        start: int | None = common(before, now)
        if start < closed:
            samples[-1].rewritten, start = True, None
            samples.append(Sample(""))
        a, b = (template.render([*turns[:k], (role, probe)]) for probe in PROBES)
        at = common(a, b)
        tail = a[at + 1 :]
        place = (at, len(now) - len(tail)) if len(a) == len(b) and b[at + 1 :] == tail and len(now) >= at + len(tail) and now[:at] == a[:at] and now.endswith(tail) else (None, None)
        samples[-1].formatted = now
        samples[-1].spans.append((role, start, len(now), *place))
        closed = place[1] if place[1] is not None else len(now)
    return samples


def format_conversations(
    turns: DataFrame, template: Template = MARKED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",), part_turns: int = PART_TURNS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per sample of a part of a conversation: conv_id, part, sample, whole, rewritten, formatted, spans.

    ``spans`` has for each turn of the sample its place in ``formatted`` and that of its text, in code points, and whether its text bears
    loss (roles in ``loss_roles``, if it has a place); see ``located``.  ``rewritten``: the next turn's rendering changes this one.

    Rows are ordered by turn, then role and text; nulls come first.  Null roles and texts count as empty; rows with a null id are a
    conversation.  Repeated rows are turns like others.  Other columns are not read.  An empty table gives an empty result.

    Conversations of a ``turnwise`` template are dealt out by ranges of (id, turn), so that one that holds many of the rows is many tasks, and
    rendered in parts of ``part_turns`` turns and ``part_chars`` characters at the most, or one longer turn; the parts of a conversation are in
    order of ``part``, and ``whole`` says that it has surely no other.  Rows alike in all four columns are read by one task, as a stream.  Any other template needs all turns of a conversation at once: those
    are held by one task, which renders all prefixes, so its work grows with the square of their number.
    """
    keys = ["i", F.col("n").asc_nulls_first(), "r", "t"]
    read = turns.select(
        turns[id_col].alias("i"), turns[turn_col].alias("n"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("r"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("t"),
    )
    kind = dict(read.dtypes)["i"]
    dealt = read.repartitionByRange("i", F.col("n").asc_nulls_first(), "r", F.substring("t", 1, 64)) if template.turnwise else read.repartition("i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TaskContext.get().partitionId() << 32
        held: list[Turn] = []
        conv, size, parts, known = None, 0, 0, not template.turnwise
        rows: list[tuple] = []
        made = 0

        def emit(ended: bool) -> None:
            nonlocal parts, made
            whole = not template.turnwise or (known and ended and not parts)
            for k, s in enumerate(located(template, held)):
                spans = [dict(zip(("role", "start", "stop", "text_start", "text_stop"), x, strict=True), loss=x[0] in loss_roles and x[3] is not None) for x in s.spans]
                rows.append((conv, index + parts, k, whole, s.rewritten, s.formatted, spans))
                made += len(s.formatted)
            parts += 1

        def batch() -> pa.RecordBatch:
            nonlocal made
            names = ["conv_id", "part", "sample", "whole", "rewritten", "formatted", "spans"]
            types = [key_type, pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), SPAN_TYPE]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            made = 0
            return out

        for given in batches:
            key_type = given.schema.field("i").type
            for i, r, t in zip(*(given.column(given.schema.get_field_index(c)).to_pylist() for c in "irt"), strict=True):
                if held and i != conv:
                    emit(True)
                    held, size, parts, known = [], 0, 0, True
                elif held and template.turnwise and (len(held) >= part_turns or size + len(t) > part_chars):
                    emit(False)
                    held, size = [], 0
                conv = i
                held.append((r, t))
                size += len(t)
                if made >= 4 << 20:
                    yield batch()
        if held:
            emit(False)
        if rows:
            yield batch()

    schema = f"conv_id {kind}, part bigint, sample int, whole boolean, rewritten boolean, formatted string, spans {SPANS}"
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


SPAN_TYPE = pa.list_(pa.struct([("role", pa.string()), *((k, pa.int64()) for k in ("start", "stop", "text_start", "text_stop")), ("loss", pa.bool_())]))


def digests(samples: DataFrame) -> DataFrame:
    """One row per conversation of ``format_conversations`` with the ``MARKED`` template, read back from its output: conv_id, n_turns,
    turns_sha256 (role, line end, text, line end of each turn), loss_chars, loss_sha256 (the texts under the loss mask, unescaped), formatted_chars.

    Whole conversations are digested where they are.  A digest of several parts is one hash over all of them in order, so those parts
    meet in one task, which reads them as a stream and holds none.
    """
    kind = dict(samples.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, whole, text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "part", "whole", "formatted", "spans")), strict=True):
                turns = read_marked(text)
                told = "".join(f"{role}\n{said}\n" for role, said in turns).encode()
                loss = "".join(unescape(text[s["text_start"] : s["text_stop"]]) for s in spans if s["loss"])
                data = (told, loss.encode())
                out.append((conv, part, whole, len(turns), len(loss), len(text), *(sha256(x).digest() if whole else x for x in data)))
            names = ["conv_id", "part", "whole", "n_turns", "loss_chars", "formatted_chars", "turns", "loss"]
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows: list[tuple] = []
        current: list | None = None

        def batch(key_type: pa.DataType) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return out

        def end() -> None:
            conv, n, told, loss_chars, loss, chars = current
            rows.append((conv, n, told.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for given in batches:
            key_type = given.schema.field("conv_id").type
            for r in given.to_pylist():
                if current and r["conv_id"] != current[0]:
                    end()
                    current = None
                if r["whole"]:
                    rows.append((r["conv_id"], r["n_turns"], r["turns"].hex(), r["loss_chars"], r["loss"].hex(), r["formatted_chars"]))
                    continue
                current = current or [r["conv_id"], 0, sha256(), 0, sha256(), 0]
                current[2].update(r["turns"])
                current[4].update(r["loss"])
                for k, c in ((1, "n_turns"), (3, "loss_chars"), (5, "formatted_chars")):
                    current[k] += r[c]
            if rows:
                yield batch(key_type)
        if current:
            end()
            yield batch(key_type)

    pieces = samples.select("conv_id", "part", "whole", "formatted", "spans").mapInArrow(
        read, f"conv_id {kind}, part bigint, whole boolean, n_turns bigint, loss_chars bigint, formatted_chars bigint, turns binary, loss binary"
    )
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        join, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


#: The conversation that the query adds: control strings in the texts of both roles.
ODD = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], given.schema)
    return digests(format_conversations(given.unionByName(odd)))


OP11_SQL = r"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, 3 * length(t) - length(replace(t, '\', '')) - length(regexp_replace(t, '#+', '#', 'g')) + (length(t) - length(replace(t, '</turn>', ''))) // 7 as text_chars,
    5 + 4 * length(role) - length(replace(role, '\', '')) - length(regexp_replace(role, '#+', '#', 'g')) - length(replace(role, ':', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 as other_chars
  from told
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn nulls first, role, t)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, role, t) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + case when role in ('user', 'assistant', 'system') then length(role) else other_chars end + 2 + text_chars + 9) as bigint) as formatted_chars
from sized group by conv_id
"""

r"""Chat formatting by columnar byte assembly.

Template: each turn is `### role`, a line feed, the text, `</turn>` and a line feed. Inside roles and texts
`\` becomes `\\`, `#` becomes `\h` and `<` becomes `\l` (in roles also a line feed `\n`), so neither control
string can occur there, and undoing this is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

HEAD, END = b"### ", b"</turn>\n"
#: Bytes of text that are assembled at a time; a longer conversation is assembled by itself.
BYTES_AT_ONCE = 1 << 21
_SCHEMA = "conv_id {}, n_turns bigint, formatted string, loss_spans array<struct<begin: bigint, length: bigint>>"


def _escaped(column, role: bool = False) -> pa.Array:
    out = pc.fill_null(column, "")
    for plain, coded in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), *([("\n", "\\n")] if role else [])):
        out = pc.replace_substring(out, plain, coded)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of a string column, and begin and length of each value in it."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """out[to : to + length] = source[begin : begin + length] for all segments by one scatter."""
    ends = np.cumsum(length)
    step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length)
    out[step + np.repeat(to, length)] = source[step + np.repeat(begin, length)]


def assemble(rows: pa.Table, loss_role: str = "assistant") -> pa.RecordBatch:
    """Format whole conversations; rows are ordered by conversation and turn (conv_id, role, text)."""
    roles = pc.fill_null(rows.column("role"), "").combine_chunks().dictionary_encode()
    if isinstance(roles, pa.ChunkedArray):
        roles = roles.combine_chunks()
    which = roles.indices.to_numpy()
    heads = [HEAD + x.encode() + b"\n" for x in _escaped(roles.dictionary, role=True).to_pylist()]
    head_length = np.array([len(x) for x in heads], np.int64)
    head_begin = np.cumsum(head_length) - head_length
    text, text_begin, text_length = _bytes_of(_escaped(rows.column("text")))

    length = head_length[which] + text_length + len(END)
    ends = np.cumsum(length)
    begin = ends - length
    out = np.empty(int(ends[-1]), np.uint8)
    _copy(out, begin, np.frombuffer(b"".join(heads), np.uint8), head_begin[which], head_length[which])
    _copy(out, begin + head_length[which], text, text_begin, text_length)
    _copy(out, ends - len(END), np.frombuffer(END, np.uint8), np.zeros(len(ends), np.int64), np.full(len(ends), len(END)))

    first = np.flatnonzero(_changes(rows.column("conv_id")))
    edges = np.concatenate([begin[first], [len(out)]])
    if len(out) > 2**31 - 1:
        raise ValueError("a conversation of more than 2 GB does not fit into a string")
    loss = which == roles.dictionary.to_pylist().index(loss_role) if loss_role in roles.dictionary.to_pylist() else np.zeros(len(which), bool)
    conversation = np.cumsum(_changes(rows.column("conv_id"))) - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((begin + head_length[which])[loss] - edges[conversation[loss]]), pa.array(text_length[loss])], ["begin", "length"]
    )
    n_loss = np.bincount(conversation[loss], minlength=len(first))
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays(
        [
            rows.column("conv_id").combine_chunks().take(pa.array(first)),
            pa.array(np.diff(np.concatenate([first, [len(which)]]))),
            formatted,
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_loss)]).astype(np.int32)), spans),
        ],
        ["conv_id", "n_turns", "formatted", "loss_spans"],
    )


def _changes(keys) -> np.ndarray:
    """Where a key of any type differs from the one before; nulls are alike."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    null = pc.is_null(keys).to_numpy(zero_copy_only=False)
    differs = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], differs | (null[1:] != null[:-1])])


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans (bytes of its loss_role texts).

    Turns go by turn_col, then role, then text; a null turn comes first. Null roles and texts are empty;
    rows without a conversation id form one conversation with a null id; repeated rows are turns of their
    own. Conversations meet by one shuffle and are then assembled as a stream, so a task holds one
    conversation (about four times its bytes), or some megabytes of short ones. A conversation is one value in
    the end, so it must fit into a string: over 2 GB the task fails, also for the rows without an id. Ids may
    be of any type. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += part.nbytes
                if size < BYTES_AT_ONCE:
                    continue
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(_changes(rows.column("conv_id")))[-1])
                if last:
                    yield assemble(rows.slice(0, last), loss_role)
                held = rows.slice(last).to_batches()
                size = sum(x.nbytes for x in held)
        if held and sum(x.num_rows for x in held):
            yield assemble(pa.Table.from_batches(held), loss_role)

    conv_type = chats.schema[conv_col].dataType.simpleString()
    chosen = chats.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, _SCHEMA.format(conv_type)).withColumnRenamed("conv_id", conv_col)


def _plain(col: Column, role: bool = False) -> Column:
    """Undo the escapes: what lies between doubled backslashes holds single codes only."""

    def codes(x: Column) -> Column:
        for coded, plain in (("\\h", "#"), ("\\l", "<"), *([("\\n", "\n")] if role else [])):
            x = F.replace(x, F.lit(coded), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(col, r"\\\\"), codes), "\\")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns of each formatted conversation, and its texts under the loss mask, unescaped: adds turns
    (array of role and text) and loss_texts (array of string). formatted: what format_chats() gives, with
    any further columns; an empty table stays empty."""
    parts = F.split("formatted", END.decode())
    turns = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda t: F.struct(
            _plain(F.substring_index(F.substring(t, len(HEAD) + 1, 2**31 - 1), "\n", 1), role=True).alias("role"),
            _plain(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text"),
        ),
    )
    under = F.transform(
        "loss_spans", lambda s: _plain(F.decode(F.substring(F.col("formatted").cast("binary"), (s["begin"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    )
    return formatted.withColumn("turns", turns).withColumn("loss_texts", under)


def op6_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    read = read_chats(format_chats(chats.unionByName(extra)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(13 + length(regexp_replace(role, '[\\#<\n]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::bigint as formatted_chars
from c group by conv_id
"""

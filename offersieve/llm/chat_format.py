"""Chat formatting at token level: segments are encoded one by one, reserved ids are spliced in between, loss masks come
from prefix sums over segment lengths, and control strings inside contents are escaped reversibly.

A turn is  START role \\n text END \\n . Its contents are encoded as ordinary text, so that no content can yield a reserved
id; in the written form `<|` becomes `<\\|`, and one more backslash is added to a `<\\|` that was there.

Defined results: a null text or role is empty; turns go by number, null first, ties by role and text; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives no conversations; a very long text is one turn's work. Columns other
than conv_id, turn, role and text play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "conv_id long, turn long, role string, body string, ids array<int>, mask array<byte>, chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


@cache
def encoding(path: str | None = None):
    """The vocabulary at path, and the two ids after its last one for START and END."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    top = max(ranks.values())
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), top + 2, top + 3


def format_turns(conversations: DataFrame, tokenizer: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """A row a turn, of the schema TURN, by any partition: ids and mask of the turn, and the length of its written form.
    A conversation's ids are those of its turns, one after the other."""
    names = [x.split()[0] for x in TURN.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, end = encoding(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], []]
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                head, body = _role(role) + "\n", escape(text)
                segments = [[start], enc.encode_ordinary(head), enc.encode_ordinary(body), [end], enc.encode_ordinary("\n")]
                # +1 where a segment under the loss begins, -1 where it ends: the prefix sum is the mask
                edge = np.cumsum([0, *map(len, segments)])
                marks = np.zeros(edge[-1] + 1, np.int8)
                if role == loss_role:
                    marks[edge[2]] += 1
                    marks[edge[3]] -= 1
                out[0].append(np.concatenate([np.array(s, np.int32) for s in segments]))
                out[1].append(np.cumsum(marks[:-1], dtype=np.int8))
                out[2].append(len(START) + len(head) + len(body) + len(END) + 1)
            cols = [pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int8())), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=names)

    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    return c.mapInArrow(encode, TURN)


def written_form(turns: DataFrame) -> DataFrame:
    """conv_id, text: conversations as strings, for readers without the reserved ids; for conversations that fit a row."""
    escaped = lambda c: F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")
    role = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    part = F.concat(F.lit(START), escaped(role), F.lit("\n"), escaped("body"), F.lit(END + "\n"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", part.alias("part")))).alias("parts"))
    return ordered.select("conv_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))


def read_back(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """From ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a conversation needs its turns in order, so they are sorted by Spark and streamed: a task holds one turn,
    however long the conversation.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start, end = encoding(tokenizer)
        state: list | None = None  # conv_id, turns, digest, loss characters, loss digest, characters
        done: list[tuple] = []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            ids_of, mask_of = batch.column(1), batch.column(2)
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = ids_of[i].values.to_numpy(), mask_of[i].values.to_numpy()
                for a, b in zip(np.flatnonzero(ids == start), np.flatnonzero(ids == end), strict=True):
                    role, _, body = enc.decode_bytes(ids[a + 1 : b].tolist()).decode().partition("\n")
                    text = unescape(body)
                    state[1] += 1
                    state[2].update(f"{_unrole(role)}\n{text}\n".encode())
                    loss = unescape(enc.decode_bytes(ids[a:b][mask[a:b] == 1].tolist()).decode())
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                    state[5] += len(START) + len(role) + 1 + len(body) + len(END) + 1
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "body")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(fold, schema)

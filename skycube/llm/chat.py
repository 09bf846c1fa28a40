"""Chat formatting with offset-aligned loss masks (operator 9).

A turn becomes ``<|im_start|>role<|im_sep|>text<|im_end|>``. Whole conversations are rendered,
encoded once with offsets, and a turn's tokens are found in the sorted token offsets by binary
search; tokens of assistant texts carry loss. The markers are special tokens, so a text's ends
are always ends of tokens.

Control strings inside texts and roles (anything that starts with ``<|``, and ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``) get one backslash more after their first character; taking
one away restores the text.

Rows are dealt in ranges of (conv_id, turn, role, text), so a conversation with very many turns
is sorted, rendered and encoded in several tasks. Within a task they stream in order and need no
memory beyond one segment of ``segment_chars`` characters; a segment ends between turns. A row
of the result is a whole conversation, or a segment of one that is long or lies at the end of a
range. Whole ones are digested where they are read. The hashes of others run over their
segments in order, so these, read back to plain texts, meet in one task for each conversation;
that task hashes a stream and holds one segment. Intermediate order comes from Spark's sort,
which spills.

Defined cases: null roles and texts are empty. A null turn comes first, equal turns follow role
and text; repeated rows are turns each. Conversations of null conv_id are one conversation.
Empty texts keep their turn. A conv_id that is no whole number is an error. No rows give no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_texts, new_path
from .tokens import byte_alphabet

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile(r"([<\[]\\*)(?=\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|/?INST\])")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)
FORMATTED = "conv_id long, part int, segment int, whole boolean, text string, input_ids array<int>, loss_mask array<tinyint>"
PLAIN = "conv_id long, part int, segment int, n_turns long, turns string, loss string, formatted_chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens inside a span; both lists are sorted."""
    place = np.array(offsets, np.int64).reshape(-1, 2)
    out = np.zeros(len(place), np.int8)
    for a, b in spans:
        i, j = np.searchsorted(place[:, 0], a, "left"), np.searchsorted(place[:, 1], b, "right")
        if a < b and (place[i, 0] != a or place[j - 1, 1] != b):
            raise ValueError("a token crosses the end of a turn")
        out[i:j] = 1
    return out


class ChatTokens:
    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
        back = {c: b for b, c in byte_alphabet().items()}
        size = self.tokenizer.get_vocab_size()
        self.bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def masked_texts(self, ids: np.ndarray, loss: np.ndarray) -> list[str]:
        """Text of each run of tokens under the mask."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
        return [b"".join(self.bytes[i] for i in ids[a:b].tolist()).decode() for a, b in zip(edge[::2], edge[1::2])]


_made: dict[str, ChatTokens] = {}


def chat_tokens(path: str) -> ChatTokens:
    if path not in _made:
        _made[path] = ChatTokens(path)
    return _made[path]


def format_conversations(turns: DataFrame, tokenizer: str, segment_chars: int = 1 << 20, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation, or for each segment of it; (part, segment) is their order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = chat_tokens(tokenizer).tokenizer.encode_batch
        ready: list[tuple] = []  # conv_id, segment, whole, turns
        held: list[tuple[str, str]] = []
        # The first conversation of a range may have begun in the range before it.
        now, segment, size, waiting, broken = None, 0, 0, 0, True

        def flush() -> pa.RecordBatch:
            drawn = [render(t) for *_, t in ready]
            found = encode([t for t, _ in drawn], add_special_tokens=False)
            columns = [
                pa.array([x[0] for x in ready], pa.int64()),
                pa.array([part] * len(ready), pa.int32()),
                pa.array([x[1] for x in ready], pa.int32()),
                pa.array([x[2] for x in ready], pa.bool_()),
                pa.array([t for t, _ in drawn]),
                pa.array([e.ids for e in found], pa.list_(pa.int32())),
                pa.array([mask(e.offsets, spans) for e, (_, spans) in zip(found, drawn)], pa.list_(pa.int8())),
            ]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "segment", "whole", "text", "input_ids", "loss_mask"])

        for batch in batches:
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (c != now or size > segment_chars):
                    broken = broken or c == now
                    ready.append((now, segment, not broken, held))
                    waiting += size
                    segment += 1
                    broken = broken and c == now
                    held, size = [], 0
                    if waiting > segment_chars:
                        yield flush()
                        waiting = 0
                now = c
                held.append((r, t))
                size += len(r) + len(t) + 1
        if held:
            ready.append((now, segment, False, held))
        if ready:
            yield flush()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.col(conv).try_cast("long")
    number = F.when(F.col(conv).isNull() | number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("conv_id is no whole number: "), F.col(conv).cast("string"))).cast("long"))
    rows_in = turns.select(number.alias("c"), F.col(turn).alias("n"), empty(role).alias("r"), empty(text).alias("t"))
    # Beginnings are in the order of the whole, and Spark's sampler takes no more than them to the driver.
    ordered = rows_in.repartitionByRange("c", "n", F.substring("r", 1, 16), F.substring("t", 1, 64)).sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return map_texts(ordered, rows, FORMATTED)


def digest(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each conversation, from formatted texts, token ids and masks alone."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, str, str, str]]:
        """Turns, the text of all, that under the mask, and the formatted text of each row."""
        chat = chat_tokens(tokenizer)
        for text, ids, loss in zip(*(batch.column(k) for k in (4, 5, 6))):
            turns = parse(text.as_py())
            yield len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(map(unescape, chat.masked_texts(np.asarray(ids.values), np.asarray(loss.values)))), text.as_py()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)) for n, turns, loss, text in read(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names[1:], zip(*out))]], names=names)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, loss, text = (list(x) for x in zip(*read(batch)))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(turns), pa.array(loss), pa.array(list(map(len, text)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PLAIN.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def close() -> pa.RecordBatch:
            row = (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if n.endswith("sha256") else pa.int64()) for n, x in zip(names, row)], names=names)

        for batch in batches:
            for conv, n, turns, loss, chars in zip(*(batch.column(k) for k in (0, 3, 4, 5, 6))):
                if state is None or state[0] != conv.as_py():
                    if state:
                        yield close()
                    state = [conv.as_py(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n.as_py()
                state[2].update(turns.as_py().encode())
                state[3] += len(loss.as_py())
                state[4].update(loss.as_py().encode())
                state[5] += chars.as_py()
        if state:
            yield close()

    parts = map_texts(formatted.where("NOT whole"), plain, PLAIN)
    return map_texts(formatted.where("whole"), whole, DIGEST).unionByName(map_texts(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment"), joined, DIGEST))


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    format_conversations(turns.unionByName(more), tokenizer).write.parquet(path)
    return digest(spark.read.schema(FORMATTED).parquet(path), tokenizer)


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[]\\*)(\||/?s>|/?INST\])', '\1\\\2', 'g') AS er,
         regexp_replace(text, '([<\[]\\*)(\||/?s>|/?INST\])', '\1\\\2', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 12 + 10 + 10) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting at token level.

Every turn becomes ids on its own: the reserved start id, the role, a newline, the text, the reserved end id, a
newline. Role and text are encoded separately as ordinary text, so no content can yield a reserved id; control strings
within it are also escaped reversibly (``<|`` becomes ``<\\|``, with one more backslash for each already there), so the
rendered text is unambiguous too. The loss mask is the prefix sum of +1 at an assistant text's first id and -1 after
its last. A conversation is the concatenation of its turns' rows, so no conversation has to fit one row or task.

Nulls: null role or text counts as empty; null conv_id is a conversation of its own; null turns come first. Rows that
repeat (conv_id, turn) are ordered by role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajframe.llm.common import stored
from trajframe.llm.huffman import ByteBpe, byte_bpe, byte_letters

VOCABULARY = "byte_bpe_50k.json"
#: Reserved ids, above the vocabulary, and what they render as.
START, END = 50_257, 50_258
START_TEXT, END_TEXT = "<|im_start|>", "<|im_end|>"

_TURN = re.compile(re.escape(START_TEXT) + r"([^\n]*)\n(.*?)" + re.escape(END_TEXT) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles also keep newlines out, since a newline ends them."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bpe() -> ByteBpe:
    return byte_bpe(VOCABULARY, pa.int32(), True)


def assemble(roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and loss mask of each turn."""
    of = lambda xs: [x.values.to_numpy() for x in _bpe().encode(xs)]
    (newline,) = of(["\n"])
    out = []
    start, end = (np.array([x], np.int32) for x in (START, END))
    for role, text in zip(of([escape_role(r) for r in roles]), of([escape(t) for t in texts]), strict=True):
        out.append((np.concatenate([start, role, newline, text, end, newline]), 1 + len(role) + len(newline), len(text)))
    sizes = np.array([len(x[0]) for x in out])
    begin = np.cumsum(sizes) - sizes + np.array([x[1] for x in out])
    delta = np.zeros(int(sizes.sum()) + 1, np.int64)
    learn = np.array([r == "assistant" for r in roles])
    np.add.at(delta, begin[learn], 1)
    np.add.at(delta, (begin + np.array([x[2] for x in out]))[learn], -1)
    mask = np.cumsum(delta[:-1]).astype(bool)
    return [x[0] for x in out], np.split(mask, np.cumsum(sizes)[:-1])


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, ids, loss_mask): every turn as ids and which of them a loss counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, masks = assemble(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "turn", "ids", "loss_mask"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, ids array<int>, loss_mask array<boolean>")


@cache
def _bytes_of() -> list[bytes]:
    """What each id stands for."""
    byte = {letter: x for x, letter in byte_letters().items()}
    out = {i: bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x, i in _bpe().tokenizer.get_vocab().items()}
    out |= {START: START_TEXT.encode(), END: END_TEXT.encode()}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def render(ids: np.ndarray) -> str:
    """The formatted text of ids."""
    return b"".join(map(_bytes_of().__getitem__, ids.tolist())).decode(errors="replace")


def read_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, learned, n_chars, n_ids): read back from ids and masks alone, each turn by itself.

    A conversation of any size is decoded by as many tasks as its rows lie in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for ids, mask in zip(batch.column(2), batch.column(3), strict=True):
                ids = ids.values.to_numpy()
                text = render(ids)
                role, content = _TURN.fullmatch(text).groups()
                learned = unescape(render(ids[mask.values.to_numpy(zero_copy_only=False)]))
                for col, x in zip(cols, (unescape_role(role), unescape(content), learned, len(text), len(ids)), strict=True):
                    col.append(x)
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], ["conv_id", "turn", "role", "text", "learned", "n_chars", "n_ids"])

    return turns.select("conv_id", "turn", "ids", "loss_mask").mapInArrow(run, "conv_id long, turn long, role string, text string, learned string, n_chars long, n_ids long")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row a conversation, from what :func:`read_turns` gives; turns are streamed in order, never gathered."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []
        for batch in batches:
            for conv, role, text, learned, chars, n in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)), strict=True):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
                open_[3] += len(learned)
                open_[4].update(learned.encode())
                open_[5] += chars
                open_[6] += n
            if done:
                yield rows(done)
                done = []
        if open_ is not None:
            yield rows([open_])

    def rows(done: list) -> pa.RecordBatch:
        cols = list(zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in done], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 4) else pa.int64()) for k, c in enumerate(cols)], [x.split(" ")[0] for x in schema.split(", ")])

    return read_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def format_and_read_back(conversations: DataFrame) -> DataFrame:
    """Write the formatted turns to the shared folder and return the digests read back from them."""
    return conversation_digests(stored(format_turns(conversations), "turns"))

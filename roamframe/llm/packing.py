"""Vector bin packing of token sequences.

Each bin is a training sequence with three capacities: tokens, segments, and loss-bearing
tokens.  Bins are filled one at a time: of the waiting examples that fit whole, the one
whose demand has the largest dot product with what is left of the bin (both scaled by the
capacities) goes in next; when none fits whole, the best one is cut at the bin's end and its
rest waits on.  Waiting examples are held in a window of bounded size, so memory does not
grow with the input, and what a window leaves over goes on to the next.  Partitions are
packed independently, without a shuffle; only the tail of a partition can be short, and it
is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm._tokens import DEFAULT_VOCABULARY, encoder
from roamframe.plans.workers import prepared

#: Id that ends a document.
END_ID = 1
#: Capacities of a sequence.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS = 2048, 256, 2048
#: Limit on loss-bearing tokens where a leading quarter of every text is prompt.
PROMPTED_LOSS_TOKENS = 1920
#: Waiting examples and ids of a window.
WINDOW_ROWS, WINDOW_IDS = 256, 1 << 20

SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "doc_row", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")]
)


class _Packer:
    """Open bins of one partition, in order."""

    def __init__(self, base: int, tokens: int, segments: int, loss: int):
        self.capacity = np.array([tokens, segments, loss], dtype=np.float64)
        self.base = self.next_id = base
        self.rows = 0
        self.out: list[tuple] = []
        self.items: list[list] = []  # doc_id, row, ids, start, prompt
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, prompt: int) -> None:
        self.items.append([doc_id, self.base + self.rows, ids, 0, prompt])
        self.rows += 1
        self.held += len(ids)

    def full(self) -> bool:
        return len(self.items) >= WINDOW_ROWS or self.held >= WINDOW_IDS

    def _demand(self) -> np.ndarray:
        start = np.array([x[3] for x in self.items], dtype=np.int64)
        end = np.array([len(x[2]) for x in self.items], dtype=np.int64)
        prompt = np.array([x[4] for x in self.items], dtype=np.int64)
        return np.stack([end - start, np.ones(len(end), dtype=np.int64), np.maximum(end - np.maximum(start, prompt), 0)], axis=1)

    def _emit(self, k: int, length: int, loss: int, offset: int) -> None:
        doc_id, row, ids, start, _ = self.items[k]
        piece = ids[start : start + length]
        self.out.append((doc_id, row, start, length, zlib.crc32(piece.tobytes()), len(ids), loss, self.next_id, offset))
        self.items[k][3] += length
        self.held -= length

    def fill(self, tokens: int, demand: np.ndarray, alive: np.ndarray) -> None:
        """One bin of exactly ``tokens`` tokens if the other limits allow."""
        left = np.array([tokens, self.capacity[1], self.capacity[2]], dtype=np.int64)
        offset = 0
        while left[0] > 0 and left[1] > 0:
            fits = alive & (demand[:, 0] <= left[0]) & (demand[:, 2] <= left[2])
            free = demand[:, 0] - demand[:, 2]  # tokens before the loss begins
            room = np.minimum(np.minimum(demand[:, 0], left[0]), free + left[2])
            pool = fits if fits.any() else alive & (room > 0)
            if not pool.any():
                break
            score = np.where(pool, (demand / self.capacity) @ (left / self.capacity), -1.0)
            k = int(score.argmax())
            length = int(room[k])
            loss = max(0, length - int(free[k]))
            self._emit(k, length, loss, offset)
            offset += length
            left -= (length, 1, loss)
            demand[k, 0] -= length
            demand[k, 2] -= loss
            alive[k] = demand[k, 0] > 0
        self.next_id += 1

    def pack(self, last: bool) -> None:
        """Fill bins while the window has a bin's worth; on the last call, all that waits."""
        demand = self._demand()
        alive = demand[:, 0] > 0
        tokens = int(self.capacity[0])
        while alive.any() and (self.held >= tokens or last):
            size = tokens if self.held >= tokens else 1 << (self.held.bit_length() - 1)
            self.fill(size, demand, alive)
        self.items = [x for x, a in zip(self.items, alive, strict=True) if a]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * len(SCHEMA)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=SCHEMA)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, tokens: int, segments: int, loss: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    end = np.array([END_ID], dtype="<u4").tobytes()
    packer = _Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss)
    for batch in batches:
        for doc_id, text, prompt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            ids = np.frombuffer(encode(text.as_py() or "") + end, dtype="<u4")
            packer.add(doc_id, ids, min(max(prompt or 0, 0), len(ids)))
            if packer.full():
                packer.pack(last=False)
                yield packer.batch()
    packer.pack(last=True)
    yield packer.batch()


def pack_documents(
    docs: DataFrame,
    vocabulary: str = DEFAULT_VOCABULARY,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_LOSS_TOKENS,
    prompt_tokens: str | None = None,
) -> DataFrame:
    """Pack every row's ids and end id; a row per piece.

    ``prompt_tokens`` names a column with the number of leading ids that bear no loss; by
    default all ids bear loss.  Columns: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` as they say, ``doc_row`` (unique per input row, also where doc_id
    repeats) and ``loss_tokens``.  The vocabulary's added token, where its string stands in a text, is its one id.  Null and empty texts are the end id alone; other columns
    are ignored; an empty table gives no rows.  Placement depends on nothing but the rows of
    a partition and their order, so a lost task is redone with the same ids.
    """
    prompt = F.lit(0).cast("bigint") if prompt_tokens is None else F.col(prompt_tokens).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", prompt.alias("prompt"))
    run = partial(_pack, vocabulary=vocabulary, tokens=max_tokens, segments=max_segments, loss=max_loss_tokens)
    fields = ", ".join(f"{f.name} bigint" for f in SCHEMA)
    return prepared(rows).mapInArrow(run, fields).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row", "loss_tokens")


def pack_prompted(docs: DataFrame) -> DataFrame:
    """``pack_documents`` where the leading quarter of a text, at four characters an id, is prompt and bears no loss."""
    prompted = docs.select("doc_id", "text", F.floor(F.length("text") / 16).alias("prompt"))
    return pack_documents(prompted, max_loss_tokens=PROMPTED_LOSS_TOKENS, prompt_tokens="prompt")

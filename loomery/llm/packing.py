"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

An example's ids are those of its prompt, which bear no loss, those of its text, which do, and an end id 0,
which doesn't. It is cut where a piece reaches the limit of tokens or of loss-bearing tokens. Full pieces are
sequences of their own. The others are packed in groups of `group_rows` by the dot-product heuristic: into the
open sequence goes the piece that fits and whose demands agree best with what the sequence has left, both in
shares of the limits; if none fits, the next sequence is opened.

Each task packs the pieces of its own rows, so nothing is shuffled and no key can be hot. A task's last group
may be smaller; at most one sequence of each group is left less than nearly full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import whole_texts
from .common import blocks, columns, ship

TOKENS, SEGMENTS, GROUP_ROWS = 1024, 64, 4096
_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")


def pack(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each row of demands (n, d); bins are numbered from 0. A row over the limits is an error.

    Rows with equal demands are taken in their order. An item's agreement is the dot product of its
    demands and the bin's remaining room, in shares of the limits.
    """
    over = np.flatnonzero((demands > limits).any(1))
    if len(over):
        raise ValueError(f"{len(over)} items are over the limits {limits.tolist()}, the first is {demands[over[0]].tolist()}")
    out = np.full(len(demands), -1, np.int64)
    kinds, inverse = np.unique(demands, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    order = np.argsort(inverse, kind="stable")
    start = np.searchsorted(inverse[order], np.arange(len(kinds) + 1))
    left, taken = np.diff(start), np.zeros(len(kinds), np.int64)
    share = kinds / limits
    n = 0
    while left.any():
        alive = np.flatnonzero(left)
        room = limits.astype(float).copy()
        while len(alive):
            alive = alive[(left[alive] > 0) & (kinds[alive] <= room).all(1)]
            if not len(alive):
                break
            k = alive[int(np.argmax(share[alive] @ (room / limits)))]
            out[order[start[k] + taken[k]]] = n
            taken[k] += 1
            left[k] -= 1
            room -= kinds[k]
        n += 1
    return out


def cuts(n: int, prompt: int, tokens: int, loss: int) -> list[tuple[int, int, int]]:
    """(start, length, loss-bearing ids) of the pieces of n ids: a prompt, loss-bearing ids, the end id."""
    out, s = [], 0
    while s < n:
        e, first = min(s + tokens, n), max(s, prompt)
        if min(e, n - 1) - first > loss:
            e = first + loss
        out.append((s, e - s, max(0, min(e, n - 1) - first)))
        s = e
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS,
                   loss: int = TOKENS, group_rows: int = GROUP_ROWS, prompt: str | None = None) -> DataFrame:
    """All rows' pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset there, loss.

    prompt: the column of prompts, if there is one. Null texts and prompts are empty: such a row is one piece
    with just the end id. Ids may be null or repeat; each row is packed, and repeated rows are told apart by
    their sequences only. Without rows there are no pieces. Other columns are left out. A sequence's number holds
    its task's in the upper 32 bits, so none is given twice; a task that is run again on the same rows gives the same.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("each limit must be 1 at least")
    ship(spark)
    limits = np.array([tokens, segments, loss])
    names = [*dict.fromkeys(["doc_id", "text", *([prompt] if prompt else [])])]
    d = columns(docs, *names)
    schema = StructType([d.schema["doc_id"]] + [StructField(n, LongType()) for n in _COLUMNS])
    id_type = to_arrow_type(d.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sequence = whole_texts(path).ids, TaskContext.get().partitionId() << 32

        def rows(made: list[tuple]) -> pa.RecordBatch:
            ids, *rest = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, type=id_type), *[pa.array(x, type=pa.int64()) for x in rest]], names=schema.names)

        def filled(group: list[tuple]) -> list[tuple]:
            nonlocal sequence
            demands = np.array([(p[2], 1, p[5]) for p in group], np.int64)
            bins = pack(demands, limits)
            out, offset = [], np.zeros(bins.max() + 1, np.int64)
            for i in np.lexsort((-demands[:, 0], bins)):
                p, b = group[i], bins[i]
                out.append((*p[:5], sequence + int(b), int(offset[b]), p[5]))
                offset[b] += p[2]
            sequence += int(bins.max()) + 1
            return out

        waiting: list[tuple] = []
        for b in batches:
            of = lambda n: b.column(b.schema.get_field_index(n)).to_pylist()  # noqa: E731, B023
            ids, texts = of("doc_id"), of("text")
            before = of(prompt) if prompt else [None] * len(texts)
            for lo, hi in blocks([(p or "") + (t or "") for p, t in zip(before, texts, strict=True)] if prompt else texts):
                done = []
                for doc_id, text, first in zip(ids[lo:hi], texts[lo:hi], before[lo:hi], strict=True):
                    lead, x = ids_of(first), ids_of(text)
                    x = np.concatenate([lead, x, [0]]).astype("<u4")
                    for s, n, bears in cuts(len(x), len(lead), tokens, loss):
                        piece = (doc_id, s, n, zlib.crc32(x[s : s + n]), len(x), bears)
                        if n == tokens:
                            done.append((*piece[:5], sequence, 0, bears))
                            sequence += 1
                        else:
                            waiting.append(piece)
                    while len(waiting) >= group_rows:
                        done += filled(waiting[:group_rows])
                        waiting = waiting[group_rows:]
                if done:
                    yield rows(done)
        if waiting:
            yield rows(filled(waiting))

    return d.mapInArrow(run, schema)

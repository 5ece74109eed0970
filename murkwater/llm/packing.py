"""Cost-balanced packing of documents into training sequences.

The cost of a piece is estimated as linear plus quadratic in its tokens (attention sees a piece by
itself). Documents are taken in descending length and go to the sequence of least cost that still has
room; if none has, the document is cut and its first part fills the room of the least costly sequence.

Packing runs in blocks of about ``block`` tokens within each task, without a shuffle. A block's
sequences are as long as they can be: all of the full length but for one of each power of two that is in
the remainder, so that full sequences and powers of two leave no padding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import Vocabulary, encoder
from .shared import gathered

_DDL = "doc_id {}, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def cost(tokens: int, quadratic: float) -> float:
    return tokens + quadratic * tokens * tokens


def capacities(total: int, most: int) -> list[int]:
    """Room of each sequence: full ones, then the powers of two that make up the rest."""
    rest = total % most
    return [most] * (total // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], most: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of each piece; every token of every item lies in one piece."""
    room = capacities(sum(lengths), most)
    used, spent = [0] * len(room), [0.0] * len(room)
    # sequences by the room they have left: heaps by cost, and each heap's least cost
    left: list[list[tuple[float, int]]] = [[] for _ in range(most + 1)]
    for s, r in enumerate(room):
        left[r].append((0.0, s))
    least = np.array([x[0][0] if x else np.inf for x in left])
    items = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(items)
    out = []
    while items:
        n, i, start = heapq.heappop(items)
        n = -n
        r = n + int(np.argmin(least[n:])) if n <= most else most + 1
        if r > most or least[r] == np.inf:
            r = 1 + int(np.argmin(least[1:]))  # no room for all of it: cut
        take = min(n, r)
        _, s = heapq.heappop(left[r])
        least[r] = left[r][0][0] if left[r] else np.inf
        out.append((i, start, take, s, used[s]))
        used[s] += take
        spent[s] += cost(take, quadratic)
        if r > take:
            heapq.heappush(left[r - take], (spent[s], s))
            least[r - take] = left[r - take][0][0]
        if n > take:
            heapq.heappush(items, (take - n, i, start + take))
    return out


def _packed(shared, added: list[str], path: str | None, most: int, block: int, quadratic: float, end: int):
    def special(texts: list[str]) -> dict[int, np.ndarray]:
        """Texts that hold added tokens go through the tokenizer itself."""
        odd = [i for i, x in enumerate(texts) if any(a in x for a in added)] if added else []
        if not odd:
            return {}
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return {i: np.array(t.encode(texts[i], add_special_tokens=False).ids, np.int32) for i in odd}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base, made = encoder(shared), TaskContext.get().partitionId() << 40, 0
        held: list[tuple[object, int, np.ndarray]] = []
        size = 0

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])

        def flush(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            pieces = assign([len(x[2]) for x in held], most, quadratic)
            for lo in range(0, len(pieces), 4000):
                yield out([(held[i][0], start, n, held[i][2][start : start + n].tobytes(), len(held[i][2]), base + made + s, at) for i, start, n, s, at in pieces[lo : lo + 4000]], kind)
            made += max((s for *_, s, _ in pieces), default=-1) + 1
            held.clear()
            size = 0

        kind = pa.int64()
        for table in gathered(batches, 400_000):
            kind = table.schema.field("doc_id").type
            texts = [x or "" for x in table["text"].to_pylist()]
            ids, counts = own.encode(texts)
            odd, ends = special(texts), np.cumsum(counts)
            for i, (doc, stop, n) in enumerate(zip(table["doc_id"].to_pylist(), ends.tolist(), counts.tolist(), strict=True)):
                tokens = np.append(odd[i] if i in odd else ids[stop - n : stop], np.int32(end)).astype("<u4")
                held.append((doc, i, tokens))
                size += len(tokens)
                if size >= block:
                    yield from flush(kind)
        if held:
            yield from flush(kind)

    return packed


def pack(docs: DataFrame, vocabulary: Vocabulary, added: list[str] | None = None, path: str | None = None, most: int = 1024, block: int = 1 << 20, quadratic: float = 1 / 6144, end: int = 0) -> DataFrame:
    """Pieces of the documents of ``docs`` (doc_id, text), each in a sequence of at most ``most`` tokens (a power of two).

    A document is its text's ids and the id ``end``; a null text counts as empty, so its document is one
    token. Columns: doc_id, start and length of the piece in the document, its tokens (little-endian
    unsigned 32-bit ids), doc_tokens, sequence_id and offset there. Offsets of a sequence leave no gap.
    Sequence ids are unique, but not consecutive: a task's number and a count within the task. Repeated
    rows are documents of their own. Texts that hold one of ``added`` are encoded by the tokenizer at
    ``path``, which must then be readable on executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_packed(shared, added or [], path, most, block, quadratic, end), _DDL.format(kind))

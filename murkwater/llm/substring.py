"""Substring dedup by relative Lempel-Ziv parsing over word windows.

Documents are parsed greedily against reference blocks that are indexed by their word windows: at a
window that a block knows from an earlier document a factor starts, with that document's position as its
source, and grows word by word while the source goes on with the same words. Where it ends, the parse goes
on at the next window that the block knows. A factor is never shorter than a window, so each is a
duplicate span; windows that straddle the end of one factor and the start of the next are looked up like
any other, which is the check at factor boundaries. The spans of all blocks are united before words go.

There are two kinds of blocks. A batch of documents is the first: what its own earlier documents hold is
parsed there and sent nowhere. All other windows go to the blocks of the corpus-wide index, which is cut
by the minimiser of each window, so that consecutive windows of a document meet the same block, and
stay one text there.

Windows are told apart by 56 bits of hash within a block (a block is one shuffle partition of bounded
size), so the chance of a false match does not grow with the corpus while partitions keep their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered, packed, partitions, record, unpacked
from .words import BASE, INVERSE, grams, power, word_hashes, words

_MOVED = "part int, doc binary, tag binary, start binary, n binary, seed binary, own_doc binary, own_tag binary, own_start binary, own_n binary, own_source binary, own_source_start binary"
_SPANS = "doc_id long, tag long, start int, n int, source long, source_start int"
_KIND = {"doc": np.int64, "tag": np.uint32, "start": np.int32, "n": np.int32}
_OWN = _KIND | {"source": np.int64, "source_start": np.int32}
#: Words of the grams of which a window's least one is its minimiser.
GRAM = 5


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of true flags; a run also ends where ``breaks`` is true."""
    start = flags.copy()
    start[1:] &= ~flags[:-1] | breaks[1:]
    at = np.flatnonzero(start)
    ids = np.cumsum(start)[flags] - 1
    return at, np.bincount(ids, minlength=len(at)) if len(at) else np.empty(0, np.int64)


def _minimisers(hashes: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each window the least hash among its 5-word grams: equal windows have equal minimisers.

    Grams of fewer words repeat far more often, and the block of the commonest would be far larger than others.
    """
    g = grams(hashes, min(GRAM, window))
    width = window - min(GRAM, window) + 1
    least = g[:n].copy()
    for i in range(1, width):
        np.minimum(least, g[i : i + n], out=least)
    return least


def _earliest(seed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window the first place in the block where the least document holds it."""
    order = np.argsort(seed)
    at = np.flatnonzero(np.r_[True, seed[order][1:] != seed[order][:-1]])
    many = np.diff(np.r_[at, len(seed)])
    docs = doc[order]
    least = np.repeat(np.minimum.reduceat(docs, at), many)
    first = np.minimum.reduceat(np.where(docs == least, order, len(seed)), at)
    source = np.empty(len(seed), np.int64)
    source[order] = np.repeat(first, many)
    return source


def _parse(seed: np.ndarray, doc: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of a block's texts, each against the block's windows of earlier documents.

    ``seed`` has the hash of each window, ``step`` is true where a window does not follow the one before
    it. Gives the windows that some factor covers, and each factor's first window, that of its source, and
    its number of windows. All texts are parsed side by side, a factor of each in a round.
    """
    n = len(seed)
    source = _earliest(seed, doc)
    found = doc > doc[source]
    starts = np.flatnonzero(step)
    ends = np.r_[starts[1:], n]
    end = np.repeat(ends, ends - starts)
    known = np.where(found, np.arange(n), n)
    known = np.r_[np.minimum.accumulate(known[::-1])[::-1], n]  # the next window with a source, from each on
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(seed * power(BASE, n), out=sums[1:])
    back = power(INVERSE, n)

    def grown(i: np.ndarray, s: np.ndarray) -> np.ndarray:
        """How many windows from i and from s on are equal; the first ones are."""
        low, high = np.ones(len(i), np.int64), np.minimum(end[i] - i, end[s] - s)
        while (low < high).any():
            half = (low + high + 1) // 2
            same = (sums[i + half] - sums[i]) * back[i] == (sums[s + half] - sums[s]) * back[s]
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    factors: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = known[starts]
    at = at[at < ends]
    while len(at):
        length = grown(at, source[at])
        factors.append((at, source[at], length))
        after = known[at + length]
        at = after[after < end[at]]
    if not factors:
        none = np.empty(0, np.int64)
        return found, none, none, none
    return found, *(np.concatenate(x) for x in zip(*factors, strict=True))


def _stretches(window: int, parts: int, most_bytes: int):
    schema = _schema(_MOVED)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, most_bytes):
            ids = table["doc_id"].to_numpy()
            tags = table["tag"].to_numpy().astype(np.uint32)
            w = words(table["text"])
            h = word_hashes(w)
            seeds = grams(h, window)
            if not len(seeds):
                continue
            row = w.row
            at = np.flatnonzero(row[: len(seeds)] == row[window - 1 :])  # windows within one document
            if not len(at):
                continue
            seed, part = seeds[at], (_minimisers(h, window, len(seeds))[at] >> np.uint64(16)) % np.uint64(parts)
            row = row[at]
            doc = ids[row]
            step = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
            first = (at - w.first[row]).astype(np.int32)
            found, i, s, n = _parse(seed, doc, step)
            if len(i):
                yield record(packed(doc[i] % parts, {"own_doc": doc[i], "own_tag": tags[row[i]], "own_start": first[i], "own_n": n.astype(np.int32), "own_source": doc[s], "own_source_start": first[s]}), schema)
            i, n = _runs(~found, step | np.r_[True, part[1:] != part[:-1]])
            short = seed[~found].view(np.uint8).reshape(-1, 8)[:, :7]
            for lo in range(0, len(i), 1 << 20):
                hi = min(len(i), lo + (1 << 20))
                skip = int(n[:lo].sum())
                pick = i[lo:hi]
                yield record(packed(part[pick], {"doc": doc[pick], "tag": tags[row[pick]], "start": first[pick], "n": n[lo:hi].astype(np.int32)}, n[lo:hi], {"seed": short[skip : skip + int(n[lo:hi].sum())]}), schema)

    return stretches


def _factors():
    schema = _schema(_SPANS)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = unpacked(batches, _KIND | {"seed": np.uint8} | {f"own_{k}": v for k, v in _OWN.items()})
        spans = {k: [c[f"own_{k}"]] for k in _OWN}
        if len(c["doc"]):
            wide = np.zeros((len(c["seed"]) // 7, 8), np.uint8)
            wide[:, :7] = c.pop("seed").reshape(-1, 7)
            run = np.repeat(np.arange(len(c["n"])), c["n"])
            first = np.cumsum(c["n"], dtype=np.int64) - c["n"]
            _, i, s, n = _parse(wide.view(np.uint64).ravel(), c["doc"][run], np.r_[True, run[1:] != run[:-1]])
            of, source = run[i], run[s]
            begin, other = c["start"][of] + (i - first[of]), c["start"][source] + (s - first[source])
            for k, v in zip(_OWN, (c["doc"][of], c["tag"][of], begin, n, c["doc"][source], other), strict=True):
                spans[k].append(v.astype(_OWN[k]))
        found = {k: np.concatenate(v) for k, v in spans.items()}
        names = {"doc_id": "doc", "tag": "tag", "start": "start", "n": "n", "source": "source", "source_start": "source_start"}
        for lo in range(0, len(found["doc"]), 50_000):
            yield record({name: pa.array(found[k][lo : lo + 50_000].astype(np.int64 if k == "tag" else _OWN[k])) for name, k in names.items()}, schema)

    return factors


def duplicate_factors(docs: DataFrame, window: int = 13, most_bytes: int = 8_000_000) -> DataFrame:
    """Factors of ``n`` windows from word ``start`` on that a document of smaller doc_id (``source``) holds from its word ``source_start`` on.

    Each window that an earlier document holds is in one factor, each other one in none.
    ``docs`` needs doc_id and text. ``tag`` is the text's CRC-32, so that rows which share a doc_id but
    not the text stay apart. Rows without doc_id neither lose words nor serve as a source.
    """
    parts = partitions(docs.sparkSession)
    tagged = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.crc32("text").alias("tag"))
    moved = tagged.mapInArrow(_stretches(window, parts, most_bytes), _MOVED).repartitionById(parts, F.col("part"))
    return moved.mapInArrow(_factors(), _SPANS)


def _cut(window: int, as_they_are: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, spans = batch.column(names.index("text")), batch.column(names.index("spans"))
            kept, total, removed = [], [], []
            for i, text in enumerate(texts):
                whole = (text.as_py() or "").encode()
                w = whole.split()
                total.append(len(w))
                if spans[i].is_valid and len(w):
                    x = spans[i].values
                    edge = np.zeros(len(w) + 1, np.int64)
                    start = x.field("start").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + x.field("n").to_numpy() + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    w = list(compress(w, keep.tolist()))
                removed.append(total[-1] - len(w))
                kept.append(whole if as_they_are and not removed[-1] else b" ".join(w))
            rest = [batch.column(k) for k, name in enumerate(names) if name not in ("text", "spans")]
            names = [name for name in names if name not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "text", "n_words", "n_removed"])

    return cut


def remove_duplicate_spans(docs: DataFrame, window: int = 13, most_bytes: int = 8_000_000, as_they_are: bool = False) -> DataFrame:
    """Every row of ``docs`` with the words that no duplicate window covers, joined by one space, as text.

    A window is ``window`` consecutive words; it is a duplicate if its words also start in a document
    with a smaller doc_id. Adds n_words (before) and n_removed. With ``as_they_are`` a text that loses no
    word keeps its white space. A null text becomes empty; a text
    shorter than a window keeps all its words; rows with equal doc_id never remove each other's words;
    a row without doc_id keeps all. Other columns pass unchanged; ``spans`` and ``tag`` may not be among
    them under those names, so they are set aside by position.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed")]
    names = [f"c{i}" for i in range(len(others))]
    rows = docs.select("doc_id", "text", F.crc32("text").alias("tag"), *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)])
    spans = duplicate_factors(docs, window, most_bytes).groupBy(F.col("doc_id").alias("span_doc"), F.col("tag").alias("span_tag")).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("span_doc")) & (F.col("tag") == F.col("span_tag")), "left").select("doc_id", *names, "text", "spans")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    ddl = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", *names)] + ["text string", "n_words long", "n_removed long"])
    out = joined.mapInArrow(_cut(window, as_they_are), ddl)
    return out.select("doc_id", "text", *[F.col(n).alias(c) for c, n in zip(others, names, strict=True)], "n_words", "n_removed")

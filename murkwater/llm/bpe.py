"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-token boundaries are found without regex. Code points of a whole batch become an array of classes
(letter, number, blank, other white space, other, apostrophe that a contraction may start); each class is
a transition function of a small automaton, the functions form a finite monoid under composition, and a
blocked scan over its composition table gives the automaton's state before every code point, from which
boundaries are read off. The slices between boundaries go through a cache in front of pair merging.
Token offsets are kept, so any range of tokens can be decoded on its own.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered
from .words import BASE, INVERSE, mixed, power

# Classes of code points in their context, and states of the automaton.
LETTER, NUMBER, OTHER, CLOSE, SHORT, BLANK, SPACE, INNER, BREAK = range(9)
BEGIN, OPEN, WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_LEFT, TWO_LEFT, ENDED = range(9)
#: White space as Unicode has it.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_tables: dict[str, np.ndarray] = {}


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of a class, and whether a pre-token starts there."""
    if kind == BREAK:
        return BEGIN, True
    if kind == INNER:  # white space before more white space or the end
        return WHITE, state != WHITE
    if kind == BLANK:  # the last blank of a run goes with what follows
        return OPEN, True
    if kind == SPACE:
        return BEGIN, True
    if kind == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (ENDED if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, OPEN)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, OPEN)
    if state in (IN_OTHERS, OPEN):
        return IN_OTHERS, False
    return {CLOSE: ONE_LEFT, SHORT: TWO_LEFT}.get(kind, IN_OTHERS), True


def _automaton() -> dict[str, np.ndarray]:
    """Code point classes, the monoid of transition functions and its composition table, made once a worker."""
    if not _tables:
        base = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = unicodedata.category(chr(i))[0]
            if c == "L":
                base[i] = LETTER
            elif c == "N":
                base[i] = NUMBER
        base[WHITE_SPACE] = SPACE
        base[0x20] = BLANK
        kinds = [tuple(_step(s, k)[0] for s in range(9)) for k in range(9)]
        maps = list(dict.fromkeys([tuple(range(9)), *kinds]))
        for f in maps:  # grows while it is read: closure under composition
            for g in kinds:
                h = tuple(g[x] for x in f)
                if h not in maps:
                    maps.append(h)
        at = {f: i for i, f in enumerate(maps)}
        _tables["class"] = base
        _tables["of_class"] = np.array([at[k] for k in kinds], np.uint16)
        _tables["then"] = np.array([[at[tuple(g[x] for x in f)] for g in maps] for f in maps], np.uint16).ravel()
        _tables["apply"] = np.array(maps, np.uint8)
        _tables["starts"] = np.array([[_step(s, k)[1] for k in range(9)] for s in range(9)], bool)
    return _tables


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each code point, by a blocked scan of composed functions."""
    t = _automaton()
    size = len(t["apply"])
    width = max(1, int(len(kinds) ** 0.5) // 2)
    blocks = -(-len(kinds) // width)
    f = np.zeros(blocks * width, np.uint16)  # 0 is the identity
    f[: len(kinds)] = t["of_class"][kinds]
    f = np.ascontiguousarray(f.reshape(blocks, width).T)
    before = np.empty_like(f)
    total = np.zeros(blocks, np.uint16)
    for i in range(width):
        before[i] = total
        total = t["then"][total.astype(np.int32) * size + f[i]]
    entry = np.empty(blocks, np.uint8)
    state, rows = BEGIN, t["apply"]
    for i, g in enumerate(total.tolist()):
        entry[i] = state
        state = rows[g, state]
    return np.ascontiguousarray(rows[before, entry].T).ravel()[: len(kinds)]


def pre_tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined texts, their code points, starts, ends, number of pre-tokens of each text); starts and ends count code points of the joined text."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.cumsum(np.array([len(x) + 1 for x in texts], np.int64)) - 1
    kinds = _automaton()["class"][points]
    white = (kinds == BLANK) | (kinds == SPACE)
    solid_next = np.zeros(len(kinds), bool)
    solid_next[:-1] = ~white[1:]
    solid_next[breaks[breaks > 0] - 1] = False
    kinds[white & ~solid_next] = INNER
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        wide = np.r_[points, 0, 0]
        one, two = wide[quote + 1], wide[quote + 2]
        kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = CLOSE
        pairs = one.astype(np.uint64) << np.uint64(32) | two
        kinds[quote[np.isin(pairs, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))]] = SHORT
    kinds[breaks] = BREAK
    starts = np.flatnonzero(_automaton()["starts"][states_before(kinds), kinds])
    ends = np.r_[starts[1:], len(points)]
    real = kinds[starts] != BREAK
    starts, ends = starts[real], ends[real]
    count = np.diff(np.r_[0, np.searchsorted(starts, breaks)])
    return joined, points, starts, ends, count


class Vocabulary:
    """Byte sequences and their ranks, which are also their ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    @classmethod
    def of_ranks(cls, path: str) -> Vocabulary:
        """From lines of a base64 byte sequence and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @classmethod
    def of_json(cls, path: str) -> tuple[Vocabulary, list[str]]:
        """From a byte-level BPE tokenizer file, with the added tokens that it takes out of texts first.

        Only a file whose merges make tokens of ascending ids is taken, so that ids are ranks.
        """
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        added = [x["content"] for x in model.get("added_tokens", [])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [model["model"]["vocab"]["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids of merged tokens do not ascend")
        return cls({bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}), added

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """Bytes of a sequence of ids, each id's where its offset says: ids may be any stretch of a text's, in any order."""
        if not len(ids):
            return np.empty(0, np.uint8)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        each = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        data = self.data[each + np.repeat(self.starts[ids], lengths)]
        if offsets is None:
            return data
        at = offsets.astype(np.int64) - int(offsets.min())
        if int((at + lengths).max()) != len(data):
            raise ValueError("offsets leave gaps between tokens, or tokens overlap")
        out = np.empty(len(data), np.uint8)
        out[each + np.repeat(at, lengths)] = data
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank is merged, the leftmost of equals, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 40:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(n - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[x] for x in parts]
    end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is merged into the one before
    back = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        k = back[i]
        if k >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Table:
    """A hash table from positive 64-bit keys to numbers in arrays, for many keys at once; -1 stands for none."""

    def __init__(self, most: int) -> None:
        bits = max(4, (4 * max(1, most)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in different keys that are not there yet; of those that meet in a free slot one gets it, the others go on."""
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            won = self.keys[at[left]] == keys[left]
            self.values[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != 0)]
        return out


class Pairs:
    """Which id the pair of two ids makes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append((a << 32 | b) + 1)
                    made.append(rank)
        self.table = Table(len(keys))
        self.table.add(np.array(keys, np.uint64), np.array(made, np.int64))

    def rank(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        found = self.table.find((a << 32 | b).astype(np.uint64) + np.uint64(1))
        found[found < 0] = none
        return found


def merged_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each piece) of many pre-tokens at once; each round merges the best pair of every piece."""
    lengths = np.array([len(x) for x in pieces], np.int64)
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    ids = first[np.frombuffer(b"".join(pieces), np.uint8)]
    own = np.repeat(np.arange(len(pieces)), lengths)
    place = np.arange(len(ids))
    spot, never = max(1, int(len(ids)).bit_length()), 1 << 40
    done_ids, done_own = [], []

    def keyed(i: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each of ``i``, above its place, so that the least is the leftmost of the best."""
        inside = i + 1 < len(ids)
        j = np.where(inside, i + 1, i)
        inside &= own[i] == own[j]
        out = np.full(len(i), never << spot, np.int64)
        k = i[inside]
        out[inside] = pairs.rank(ids[k], ids[k + 1], never) << spot
        return out | place[i]

    key = keyed(np.arange(len(ids)))
    while len(ids):
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        best = np.minimum.reduceat(key, start)
        open_ = best < never << spot
        if not open_.all():
            keep = np.repeat(open_, np.diff(np.r_[start, len(ids)]))
            done_ids.append(ids[~keep])
            done_own.append(own[~keep])
            ids, own, place, key = ids[keep], own[keep], place[keep], key[keep]
            best = best[open_]
            if not len(ids):
                break
        i = np.searchsorted(place, best & ((1 << spot) - 1))
        ids[i] = best >> spot
        keep = np.ones(len(ids), bool)
        keep[i + 1] = False
        ids, own, place, key = ids[keep], own[keep], place[keep], key[keep]
        i = i - np.arange(len(i))  # one symbol has gone before each earlier piece's merge
        key[i] = keyed(i)
        back = i[(i > 0) & (own[i] == own[i - 1])] - 1
        key[back] = keyed(back)
    if not done_ids:
        return np.empty(0, np.int64), lengths
    ids, own = np.concatenate(done_ids), np.concatenate(done_own)
    return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(pieces))


class Encoder:
    """Encodes texts by a cache from pre-tokens to their ids, in front of pair merging.

    The cache is keyed by a 64-bit hash of a pre-token's code points and holds pre-tokens of up to
    ``longest`` code points; it is emptied before it outgrows ``most`` of them, so memory is bounded and
    results do not depend on it. Looking up a batch takes a few array operations; only pre-tokens that
    are not there become strings.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000, longest: int = 48) -> None:
        self.vocabulary, self.most, self.longest = vocabulary, most, longest
        self.pairs = Pairs(vocabulary.ranks)
        self.clear()

    def clear(self) -> None:
        self.table = Table(self.most)
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _keys(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(points)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED270B)) * power(BASE, n), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * power(INVERSE, n)[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        joined, points, starts, ends, count = pre_tokens(texts)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        keys = self._keys(points, starts, ends)
        entry = self.table.find(keys)
        long = ends - starts > self.longest
        entry[long] = -1
        new = np.flatnonzero((entry < 0) & ~long)
        if len(new):
            fresh, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
            if len(self.starts) + len(fresh) > self.most:
                self.clear()
                return self.encode(texts) if len(fresh) <= self.most and len(new) < len(starts) else self._slowly(joined, starts, ends, count)
            at = new[first]
            ids, counts = merged_all([joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], self.vocabulary.ranks, self.pairs)
            self.table.add(fresh, np.arange(len(fresh)) + len(self.starts))
            entry[new] = inverse + len(self.starts)
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
            self.counts = np.r_[self.counts, counts]
            self.ids = np.r_[self.ids, ids.astype(np.int32)]
        store, first, many = self.ids, self.starts, self.counts
        if long.any():
            own = [merged(joined[a:b].encode("utf-8", "surrogatepass"), self.vocabulary.ranks) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            lengths = np.array([len(x) for x in own], np.int64)
            entry[long] = len(first) + np.arange(len(own))
            first = np.r_[first, len(store) + np.cumsum(lengths) - lengths]
            many = np.r_[many, lengths]
            store = np.r_[store, np.concatenate([np.array(x, np.int32) for x in own])]
        sizes = many[entry]
        upto = np.cumsum(sizes)
        ids = store[np.arange(upto[-1]) + np.repeat(first[entry] - (upto - sizes), sizes)]
        last = np.cumsum(count)
        total = np.r_[0, upto]
        return ids, total[last] - total[last - count]

    def _slowly(self, joined: str, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the cache, for a batch that alone would outgrow it."""
        ids, counts = merged_all([joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], self.vocabulary.ranks, self.pairs)
        total, last = np.r_[0, np.cumsum(counts)], np.cumsum(count)
        return ids.astype(np.int32), total[last] - total[last - count]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary) -> Encoder:
    """This worker's encoder for a broadcast vocabulary; its cache lasts from task to task."""
    key = str(vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _encoded(shared, key: str):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared)
        for table in gathered(batches, 400_000):
            ids, counts = own.encode([x or "" for x in table["text"].to_pylist()])
            lengths = own.vocabulary.lengths[ids]
            ends = np.cumsum(counts)
            total = np.r_[0, np.cumsum(lengths)]
            offsets = total[:-1] - np.repeat(total[ends - counts], counts)
            yield pa.RecordBatch.from_arrays([table[key].combine_chunks(), _lists(ids, counts), _lists(offsets, counts)], [key, "ids", "offsets"])

    return encoded


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, offsets) of each row of ``docs`` (doc_id, text): token ids and their byte offsets in the UTF-8 text.

    A null text is empty and has no ids. Special tokens in a text are ordinary text. The vocabulary
    (about a megabyte, fixed) is broadcast.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_encoded(shared, "doc_id"), f"doc_id {kind}, ids array<int>, offsets array<int>")


def _decoded(shared):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = []
                offsets = part.column("offsets") if "offsets" in part.schema.names else pa.nulls(part.num_rows)
                for x, at in zip(part.column("ids"), offsets, strict=True):
                    out.append(v.decode(x.values.to_numpy(), at.values.to_numpy() if at.is_valid else None).tobytes() if x.is_valid else b"")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return decoded


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``tokens`` with the bytes that its ids stand for, as ``decoded``; null ids give no bytes.

    If there is a column ``offsets``, each id's bytes go where it says, counted from the least: ids of any
    stretch of a text may then come in any order. Without it, or where it is null, ids are in order.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema] + ["decoded binary"])
    return tokens.mapInArrow(_decoded(shared), ddl)


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""N-gram Jaccard join: documents whose 5-word shingle sets overlap by 0.8 or more, and their classes.

Pairs are filtered under several global token orders before any pair is compared in full:

* ascending hash order, over the whole corpus: a set of n shingles that links with another has an
  overlap of at least t = ceil(0.8 n), so of the first n - t + l shingles at least l are the
  partner's too. Documents with fewer shared prefix shingles than that link with nothing.
* rare-first order, over what is left: by the number of sets that have a shingle (counted up to 16,
  ties in hash order). Shingles that no other set has use up prefix places, and a set with more of
  them than n - t links with nothing. The other sets offer the rest of their prefix as join keys.
* ascending and descending hash order, pair by pair: candidates must meet in both of these prefixes
  as well. Only the prefixes go to the pairs (32 bits of each shingle, about a fifth of a whole set);
  whole sets are fetched for the pairs that all orders leave, and intersected.

Sets that are equal are one node throughout. A key's sets are first compared with its most central
one, so that a large group of near copies becomes a star; only sets of a key that are still in
different components, and whose sizes, private shingles and bitmaps allow a link, are then compared
pairwise. (A set's bitmap has 2048 bits, of which each shingle sets one: where two bitmaps differ, so
do the sets. The join condition sees it, so pairs that it rules out are never made.)

A key that holds more than its share of all rows is dealt over several tasks in every join by key: its
rows get a salt from their node, and what they are joined with is repeated for each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import gathered, packed, partitions, record, records, unpacked, written
from .words import gram_sets, mixed

_META = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])
_SETS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
_MOVED = pa.schema([(c, pa.int32() if c == "part" else pa.binary()) for c in ("part", "node", "size", "n", "token", "own_node", "own_size", "own_count", "own_n", "own_token")])
_FOUND = pa.schema([(c, pa.int32() if c == "part" else pa.binary()) for c in ("part", "node", "size", "count", "n", "token", "rate")])
_KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64())])
_ONE = np.uint64(1)
#: Up to where the sets that have a shingle are counted, and the 64-bit words of a set's bitmap.
MANY, LIMBS = 16, 32


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'binary': 'binary'})[str(f.type)]}" for f in schema)


class Share:
    """The share of the union, per hundred, from which on two sets link."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def needed(self, n):
        """Least overlap of a set of n with any set that it links with."""
        return (self.percent * n + 99) // 100

    def links(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number for each set; equal sets have equal ones."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        every = mixed(np.concatenate([sets[i] for i in full]) + np.uint64(0x632BE59BD9B4E019))
        out[full] = mixed(np.add.reduceat(every, np.r_[0, np.cumsum(sizes[full])[:-1]]) + sizes[full].astype(np.uint64))
    return out


def _shingles(column: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """Each row's shingle hashes, ascending; their two lowest bits are left free for marks."""
    return [x & ~np.uint64(3) for x in gram_sets(column, words, lower=True)]


def _meta(words: int, most_bytes: int):
    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, most_bytes):
            sets = _shingles(table["text"], words)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests(sets).view(np.int64))], schema=_META)

    return meta


def _entries(nodes: np.ndarray, sizes: np.ndarray, taken: list[np.ndarray], parts: int, many: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """What a batch of different sets tells of the shingles ``taken`` from each.

    A shingle of at least ``many`` of the batch's sets needs no count: one entry with bit 0 set says so
    to the others, and the batch reports its own sets under own_*. Of other shingles each entry goes out.
    So a shingle that very many documents have sends fewer than ``many`` entries a batch.
    """
    lengths = np.array([len(x) for x in taken], np.int64)
    if not lengths.sum():
        return
    token = np.concatenate(taken)
    owner = np.repeat(np.arange(len(nodes)), lengths)
    order = np.argsort(token, kind="stable")
    at = np.flatnonzero(np.r_[True, token[order][1:] != token[order][:-1]])
    times = np.diff(np.r_[at, len(token)])
    common = np.empty(len(token), bool)
    common[order] = np.repeat(times >= many, times)
    speaks = ~common
    speaks[order[at]] = True
    counts = np.bincount(owner[common], minlength=len(nodes))
    have = np.flatnonzero(counts)
    if len(have):
        n = counts[have] if keep else np.zeros(len(have), np.int64)
        part = (nodes[have] % np.uint64(parts)).astype(np.int64)
        yield record(packed(part, {"own_node": nodes[have], "own_size": sizes[have].astype(np.uint32), "own_count": counts[have].astype(np.uint32), "own_n": n.astype(np.uint32)}, n, {"own_token": token[common] if keep else token[:0]}), _MOVED)
    sent = np.flatnonzero(speaks)
    to = ((token[sent] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(owner[sent] * parts + to, kind="stable")
    sent, to = sent[order], to[order]
    run = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (owner[sent][1:] != owner[sent][:-1])])
    n = np.diff(np.r_[run, len(sent)])
    entry = token[sent] | common[sent].astype(np.uint64)
    yield record(packed(to[run], {"node": nodes[owner[sent[run]]], "size": sizes[owner[sent[run]]].astype(np.uint32), "n": n.astype(np.uint32)}, n, {"token": entry}), _MOVED)


def _prefixes(words: int, share: Share, parts: int, most_bytes: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, most_bytes):
            sets = [x for x in _shingles(table["text"], words) if len(x)]
            if not sets:
                continue
            nodes, first = np.unique(digests(sets), return_index=True)
            sets = [sets[i] for i in first]
            sizes = np.array([len(x) for x in sets], np.int64)
            yield from _entries(nodes, sizes, [x[: n - share.needed(n) + max(1, n // 10)] for x, n in zip(sets, sizes.tolist(), strict=True)], parts, 2, False)

    return prefixes


def _whole(parts: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(np.uint64)
            nodes, first = np.unique(nodes, return_index=True)
            for lo in range(0, len(first), 2000):
                pick = first[lo : lo + 2000]
                sets = [np.frombuffer(batch.column(2)[int(i)].as_buffer(), np.uint64) for i in pick]
                sizes = np.array([len(x) for x in sets], np.int64)
                yield from _entries(nodes[lo : lo + 2000], sizes, sets, parts, MANY, True)

    return whole


def _shared(parts: int, many: int, keep: bool):
    """From a part's entries: how many shingles each set shares there and, with ``keep``, which and with how many."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u4 = np.uint32
        c = unpacked(batches, {"node": np.uint64, "size": u4, "n": u4, "token": np.uint64, "own_node": np.uint64, "own_size": u4, "own_count": u4, "own_n": u4, "own_token": np.uint64})
        if len(c["own_node"]):
            rate = np.full(len(c["own_token"]), many, np.uint8)
            yield from records((c["own_node"] % np.uint64(parts)).astype(np.int64), {"node": c["own_node"], "size": c["own_size"], "count": c["own_count"], "n": c["own_n"]}, c["own_n"].astype(np.int64), {"token": c["own_token"], "rate": rate}, _FOUND)
        if not len(c["node"]):
            return
        run = np.repeat(np.arange(len(c["n"])), c["n"])
        flagged = (c["token"] & _ONE) == 1
        token, node = c["token"] & ~np.uint64(3), c["node"][run]
        order = np.lexsort((flagged, node, token))
        new = np.r_[True, token[order][1:] != token[order][:-1]]
        other = new | np.r_[True, node[order][1:] != node[order][:-1]]  # first entry of each set for a shingle
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        rate = np.where(np.maximum.reduceat(flagged[order], at), many, np.minimum(np.add.reduceat(other.astype(np.int64), at), many))[group]
        answer = np.zeros(len(token), bool)
        answer[order] = other & ~flagged[order] & (rate > 1)
        of = np.empty(len(token), np.uint8)
        of[order] = rate
        count = np.bincount(run[answer], minlength=len(c["n"]))
        have = np.flatnonzero(count)
        n, which = (count[have], answer) if keep else (np.zeros(len(have), np.int64), np.zeros(len(token), bool))
        yield from records((c["node"][have] % np.uint64(parts)).astype(np.int64), {"node": c["node"][have], "size": c["size"][have], "count": count[have].astype(u4), "n": n.astype(u4)}, n, {"token": token[which], "rate": of[which]}, _FOUND)

    return shared


def _keys(share: Share, keys: bool):
    """Sets that can still link: with ``keys`` their join keys, else one row each."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u4 = np.uint32
        c = unpacked(batches, {"node": np.uint64, "size": u4, "count": u4, "n": u4, "token": np.uint64, "rate": np.uint8})
        if not len(c["node"]):
            return
        nodes, inverse = np.unique(c["node"], return_inverse=True)
        size = np.zeros(len(nodes), np.int64)
        size[inverse] = c["size"]
        count = np.bincount(inverse, c["count"], minlength=len(nodes)).astype(np.int64)
        if not keys:
            alive = np.flatnonzero(count >= np.maximum(1, share.needed(size) // 10))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(alive), np.int64)), pa.array(nodes[alive].view(np.int64)), pa.array(size[alive]), pa.array((size - count)[alive])], schema=_KEYS)
            return
        own = size - count
        places = size - share.needed(size) + 1 - own
        owner = np.repeat(inverse, c["n"])
        order = np.lexsort((c["token"], c["rate"], owner))
        owner, token = owner[order], c["token"][order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        pick = rank < places[owner]
        owner, token = owner[pick], token[pick]
        for lo in range(0, len(owner), 100_000):
            i = owner[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[lo : lo + 100_000].view(np.int64)), pa.array(nodes[i].view(np.int64)), pa.array(size[i]), pa.array(own[i])], schema=_KEYS)

    return found


def _whole_sets(words: int):
    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 1_000_000):
            sets = _shingles(table["text"], words)
            node = digests(sets).view(np.int64)
            keep = np.flatnonzero(node == table["node"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], schema=_SETS)

    return whole_sets


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.zeros((batch.num_rows, LIMBS * 64), np.uint8)
        for i, x in enumerate(batch.column(1)):
            bits[i, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(8)) % np.uint64(LIMBS * 64)] = 1
        limbs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(limbs[:, k])) for k in range(LIMBS)]], ["node", *[f"m{k}" for k in range(LIMBS)]])


def _ends(share: Share):
    """Each set's prefixes under ascending and descending hash order, as 32 bits of each shingle."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for value in batch.column(1):
                x = np.frombuffer(value.as_buffer(), np.uint64)
                places = len(x) - share.needed(len(x)) + 1
                low.append((x[:places] >> np.uint64(8)).astype(np.uint32).tobytes())
                high.append((x[len(x) - places :] >> np.uint64(8)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["node", "low", "high"])

    return ends


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chosen(batch: pa.RecordBatch, keep: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], schema=_PAIRS)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of which both prefixes (low_a, high_a, low_b, high_b) have a shingle in common."""
    for batch in batches:
        keep = []
        ends = [batch.column(k) for k in range(2, 6)]
        for i in range(batch.num_rows):
            la, ha, lb, hb = (np.frombuffer(c[i].as_buffer(), np.uint32) for c in ends)
            if len(np.intersect1d(la, lb)) and len(np.intersect1d(ha, hb)):
                keep.append(i)
        yield _chosen(batch, keep)


def _checked(share: Share):
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                if share.links(int((y[at] == x).sum()), len(x), len(y)):
                    keep.append(i)
            yield _chosen(batch, keep)

    return checked


def _linked(pairs: DataFrame, sets: DataFrame, ends: DataFrame, share: Share) -> DataFrame:
    """The pairs that link: those that meet under the other orders too, then those whose sets overlap enough."""
    left, right = (ends.select(*[F.col(c).alias(f"{c}_{x}") for c in ("low", "high")], F.col("node").alias(x)) for x in ("a", "b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "low_a", "high_a", "low_b", "high_b").mapInArrow(_meeting, "a long, b long")
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_checked(share), "a long, b long")


class Salts:
    """Numbers of parts in which joins deal the rows of hot keys.

    ``sizes`` (key, many) has each key once; ``total`` is the sum of many. A key is hot with more than a quarter of
    an even partition's rows, so there are at most 4 * parts hot keys, whatever the data: they are broadcast.
    """

    def __init__(self, sizes: DataFrame, total: int, parts: int) -> None:
        even = max(1, total // (4 * parts))
        self.hot = F.broadcast(sizes.where(F.col("many") > even).select("key", F.ceil(F.col("many") / even).cast("int").alias("salts")))

    def _known(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, node, ...), each with one of its key's salts."""
        return self._known(rows).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")

    def repeated(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, ...), each once with every salt of its key."""
        return self._known(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, most_bytes: int = 8_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    A document's set holds the distinct hashes of its ``words``-word shingles, A-Z lower-cased; a
    shorter text is one shingle; an empty or null text has none and is a component of its own. Two
    documents link when 100 * intersection >= percent * union; component_id is the least doc_id
    that links reach. Repeated rows are equal documents. A row without doc_id lends no id: it gets
    the least id of its component if a row with an id has the same set, else null.
    """
    spark, share = docs.sparkSession, Share(percent)
    parts = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    meta = written(docs.mapInArrow(_meta(words, most_bytes), _ddl(_META)), "meta")
    classes = meta.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))

    def shared(entries: DataFrame, keys: bool) -> DataFrame:
        found = entries.repartitionById(parts, F.col("part")).mapInArrow(_shared(parts, MANY if keys else 2, keys), _ddl(_FOUND))
        return found.repartitionById(parts, F.col("part")).mapInArrow(_keys(share, keys), _ddl(_KEYS))

    alive = shared(docs.select("text").mapInArrow(_prefixes(words, share, parts, most_bytes), _ddl(_MOVED)), False)
    chosen = classes.join(alive.select("node"), "node").where("least is not null").select(F.col("least").alias("doc_id"), "node")
    sets = written(docs.join(chosen, "doc_id").select("node", "text").mapInArrow(_whole_sets(words), _ddl(_SETS)), "sets")
    if not meta.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = written(sets.dropDuplicates(["node"]), "sets")
    ends = sets.select("node", "tokens").mapInArrow(_ends(share), "node long, low binary, high binary")
    keys = written(shared(sets.mapInArrow(_whole(parts), _ddl(_MOVED)), True), "keys")

    def possible(a: str, b: str) -> Column:
        """The least overlap that links sets of these sizes leaves room for the shingles that only one has."""
        need = F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + percent))
        return (F.col(f"{a}.n") - F.col(f"{a}.own") >= need) & (F.col(f"{b}.n") - F.col(f"{b}.own") >= need)

    central = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "own")).alias("hub")
    hubs = written(keys.groupBy("key").agg(central, F.count("*").alias("many")).where("many > 1").select("key", "hub.node", "hub.n", "hub.own", "many"), "hubs")
    salts = Salts(hubs, keys.count(), parts)
    dealt = salts.dealt(keys)
    first = dealt.alias("x").join(salts.repeated(hubs.drop("many")).alias("h"), ["key", "salt"]).where((F.col("x.node") != F.col("h.node")) & possible("x", "h"))
    tried = written(first.select(F.least("x.node", "h.node").alias("a"), F.greatest("x.node", "h.node").alias("b")).distinct(), "pairs")
    links = written(_linked(tried, sets, ends, share), "links")
    stars = written(components(links), "stars")
    placed = dealt.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = placed.groupBy("key", "root").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.count("*").alias("roots"))
    placed = placed.join(salts.repeated(roots.where("roots > 1").select("key", "main")), ["key", "salt"])
    open_nodes = placed.select("node").distinct()
    bitmaps = sets.select("node", "tokens").join(open_nodes, "node", "left_semi").mapInArrow(_bitmaps, "node long, " + ", ".join(f"m{k} long" for k in range(LIMBS)))
    placed = placed.join(bitmaps, "node")
    differ = sum((F.bit_count(F.col(f"x.m{k}").bitwiseXOR(F.col(f"y.m{k}"))) for k in range(1, LIMBS)), F.bit_count(F.col("x.m0").bitwiseXOR(F.col("y.m0"))))
    fits = (100 + percent) * (F.col("x.n") + F.col("y.n") - differ) >= 2 * percent * (F.col("x.n") + F.col("y.n"))
    # of a key's components the largest is not compared within itself: only sets outside it look for partners
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    second = salts.repeated(placed.where("root <> main").drop("salt")).alias("x").join(placed.alias("y"), apart & possible("x", "y") & fits)
    found = second.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = written(found, "pairs").join(tried, ["a", "b"], "left_anti")
    more = written(_linked(rest, sets, ends, share), "links")
    roots = components(links.union(more))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "root").select("node", "component_id")
    some = meta.where("n > 0").join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none)

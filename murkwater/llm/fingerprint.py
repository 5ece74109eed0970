"""Document fingerprints: a threshold-scaled sketch of 5-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range (1/2), and where there is none
the least hash, so that no text with words has an empty sketch. It depends on nothing else, so the union of
two sketches, cut by the same rule, is the sketch of the union of their sets, and texts of very unequal
length can be compared. A fingerprint is the string ``scale.hashes``: the fraction's inverse and the kept
hashes (48 bits each, ascending) in base64.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gathered, partitions
from .words import gram_sets

#: Inverse of the fraction of hashes that a sketch keeps.
SCALE = 2
#: Kept hashes of the smaller set that an estimate of containment needs.
LEAST = 4
_TOP = np.int64(2**48)


def cut(hashes: np.ndarray) -> np.ndarray:
    """What a sketch keeps of ascending distinct 48-bit hashes."""
    kept = hashes[: np.searchsorted(hashes, _TOP // SCALE)]
    return kept if len(kept) else hashes[:1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Kept hashes, ascending, of an array of distinct shingle hashes of 64 bits."""
    return cut(np.unique((hashes >> np.uint64(16)).astype(np.int64)))


def written_out(kept: np.ndarray) -> str:
    octets = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return f"{SCALE}.{base64.b64encode(octets.tobytes()).decode()}"


def read_back(text: str) -> np.ndarray:
    octets = np.frombuffer(base64.b64decode(text.split(".")[1]), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(octets), 8), np.uint8)
    wide[:, 2:] = octets
    return wide.view(">u8").ravel().astype(np.int64)


def likeness(x: np.ndarray, y: np.ndarray) -> tuple[float, float | None]:
    """Estimated (resemblance, containment of the smaller) of two sketches, 0 to 1.

    The resemblance is the share of the union's sketch that both have; its standard error is about
    sqrt(r (1 - r) / k) for k hashes in it. Two empty sets have 1, an empty one and another 0. The containment
    is None where fewer than four hashes of the smaller set are below the fraction.
    """
    if not len(x) or not len(y):
        return (1.0, 1.0) if len(x) == len(y) else (0.0, 0.0)
    union = cut(np.union1d(x, y))
    both = np.intersect1d(x, y, assume_unique=True)
    near = len(np.intersect1d(both, union, assume_unique=True)) / len(union)
    smaller = min(len(x), len(y))
    return near, len(both) / smaller if smaller >= LEAST or len(x) == len(y) == len(both) else None


def merged(a: str, b: str) -> str:
    """Fingerprint of the union of two sets: that of a text which has the shingles of both."""
    return written_out(cut(np.union1d(read_back(a), read_back(b))))


def _fingerprints(words: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 1_000_000):
            prints = [written_out(sketch(x)) for x in gram_sets(table["text"], words, lower=True)]
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns], pa.array(prints, pa.string())], [*table.column_names, "fingerprint"])

    return fingerprints


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` (doc_id, text) with the fingerprint of each text; a null text counts as empty."""
    docs = docs.select("doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(_fingerprints(words), f"doc_id {kinds['doc_id']}, text string, fingerprint string")


def _bounds(spark: SparkSession, firsts: list[int]) -> tuple[DataFrame, int]:
    """Ascending bounds as a table of one row, in groups of equal size, to be found in two short scans."""
    step = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    return spark.createDataFrame([(groups,)], "firsts array<array<long>>"), step


def _dealt(docs: DataFrame, firsts: list[int]) -> DataFrame:
    """``docs`` with the 1-based number of the last bound that is not above ``key`` as bucket, and that bound as first.

    The bounds (one number for each shuffle partition) come along as one row.
    """
    bounds, step = _bounds(docs.sparkSession, firsts)
    group = F.greatest(F.lit(1), F.size(F.filter("firsts", lambda g: g[0] <= F.col("key"))))
    rows = docs.crossJoin(F.broadcast(bounds)).withColumn("group", group)
    place = F.greatest(F.lit(1), F.size(F.filter(F.element_at("firsts", F.col("group")), lambda b: b <= F.col("key"))))
    rows = rows.withColumn("place", place).withColumn("first", F.element_at(F.element_at("firsts", F.col("group")), F.col("place")))
    return rows.withColumn("bucket", (F.col("group") - 1) * step + F.col("place")).drop("firsts", "group", "place")


_EDITED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def _with_next(words: int):
    names = [x.split()[0] for x in _EDITED.split(", ")]

    def judged(rows: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
        edited = [(t[: len(t) - len(t) // 2] + u[: len(t) // 2]) for (_, t, _), (_, u, _) in zip(rows, nexts, strict=True)]
        after = [sketch(x) for x in gram_sets(pa.array(edited, pa.string()), words, lower=True)]
        out = []
        for (i, t, s), (_, _, n), e, text in zip(rows, nexts, after, edited, strict=True):
            near, inside = likeness(s, e)
            other, within = likeness(s, n)
            out.append((i, len(t), text, written_out(s), written_out(e), near, other, inside, within))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next one has not come yet
        for table in gathered(batches, 1_000_000):
            sketches = [sketch(x) for x in gram_sets(table["text"], words, lower=True)]
            now, nexts = [], []
            for i, b, tail, text, s in zip(table["doc_id"].to_pylist(), table["bucket"].to_pylist(), table["tail"].to_pylist(), table["text"].to_pylist(), sketches, strict=True):
                row = (i, text or "", s)
                if held is not None and held[0] == b:
                    now.append(held[1])
                    nexts.append(row)
                held = None if tail else (b, row)
            if now:
                yield judged(now, nexts)

    return with_next


def edited_with_next(docs: DataFrame, words: int = 5) -> DataFrame:
    """Each text, its edited text and how alike their fingerprints are, and that of the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document by ascending doc_id; after the last comes the first. Equal doc_ids follow each
    other in text order, rows without doc_id come last. A null text is empty. A single document is its
    own next. An empty table gives no row.

    Documents are dealt by doc_id range with one shuffle; the first document of each range is also sent
    to the range before it, so no task sees more than its range. The ranges' bounds (one number for each
    shuffle partition) are the only data on the driver.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(2**63 - 1)))
    near = docs.agg(F.percentile_approx("key", [i / parts for i in range(parts)], 100 * parts).alias("p")).first().p
    if not near:
        return spark.createDataFrame([], _EDITED)
    firsts = [r.first for r in _dealt(docs.select("key"), sorted(set(near))).groupBy("bucket").agg(F.min("key").alias("first")).orderBy("bucket").collect()]
    placed = _dealt(docs, firsts).withColumn("starts", F.col("key") == F.col("first"))
    before = F.when(F.col("bucket") == 1, F.lit(len(firsts))).otherwise(F.col("bucket") - 1)
    own, copy = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail")), F.struct(before.alias("bucket"), F.lit(True).alias("tail"))
    dealt = placed.select("doc_id", "key", "text", F.explode(F.when(F.col("starts"), F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "key", "text", "to.bucket", "to.tail").repartitionById(max(parts, len(firsts)), (F.col("bucket") - 1).cast("int"))
    return dealt.sortWithinPartitions("bucket", "tail", "key", "text").mapInArrow(_with_next(words), _EDITED)

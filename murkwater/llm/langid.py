"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of characters that are no letters count as one blank, so only letters and
word edges matter. All 1-, 2- and 3-grams are hashed into a fixed number of buckets. The matrix of
log-probabilities (buckets x languages, a few hundred kilobytes for each ten languages) is broadcast and
texts are scored in batches by gathering its rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gathered

BITS = 14
_STEPS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram of a batch, and the row that it is of; rows without letters have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.utf8_lower(pc.fill_null(column, ""))
    joined = " " + " ".join(column.to_pylist()) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths + 1)
    row = np.r_[0, row]  # the leading blank
    letter = letters()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = letter | np.r_[True, letter[:-1]]
    keep[0] = True
    points, row, letter = points[keep], row[: len(keep)][keep], letter[keep]
    if len(points) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = np.uint32(32 - BITS)
    a, b = points * _STEPS[0], points * _STEPS[1]
    c = points * _STEPS[2]
    one = (a ^ a >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    two = a[:-1] ^ (b[1:] << np.uint32(3) | b[1:] >> np.uint32(29))
    two = (two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    three = two[:-1] ^ (c[2:] << np.uint32(7) | c[2:] >> np.uint32(25))
    three = (three ^ three >> np.uint32(15)) * np.uint32(0x297A2D39)
    use1, use2, use3 = letter, letter[:-1] | letter[1:], letter[1:-1]
    # the middle of a 3-gram and one end of a 2-gram are letters, so no gram has letters of two rows
    rows = np.concatenate([row[use1], np.where(letter[:-1], row[:-1], row[1:])[use2], row[1:-1][use3]])
    return np.concatenate([one[use1] >> shift, two[use2] >> shift, three[use3] >> shift]).astype(np.int64), rows


@dataclass
class Model:
    """Languages in natural order, log-probabilities by bucket and language, and log-priors."""

    languages: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learned from: the CRC-32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _counted():
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for table in gathered(batches, 500_000):
            languages = np.array(table["lang"].to_pylist(), object)
            bucket, row = gram_buckets(table["text"])
            for language in set(languages.tolist()):
                mine = (languages == language)[row]
                total.setdefault(language, np.zeros(1 << BITS, np.int64))
                total[language] += np.bincount(bucket[mine], minlength=1 << BITS)
        for language, counts in total.items():
            have = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(have), pa.string()), pa.array(have.astype(np.int32)), pa.array(counts[have])], ["lang", "bucket", "n"])

    return counted


def fit(docs: DataFrame, most_docs: int = 4000, smoothing: float = 0.5, most_languages: int = 500) -> Model:
    """Learn from text and lang of the rows of ``docs`` that are not held out and have both.

    At most about ``most_docs`` documents of each language are used, picked by a 62-bit hash of doc_id and
    text with a threshold from the language's number of documents; every document that is used counts whole.
    More than ``most_languages`` languages are an error, so that the model has a bounded size and no language is
    left out unseen. Priors come from all labelled documents. Without any, the model has no language. The languages, their sizes and the counts by bucket come to the driver, which holds the
    model anyway; texts are counted where they are read.
    """
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().limit(most_languages + 1).collect())
    if len(known) > most_languages:
        raise ValueError(f"more than {most_languages} languages: raise most_languages, which bounds the model's size")
    if not known:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    least = F.create_map(*[F.lit(x) for lang, n in known for x in (lang, int(2**62 * min(1.0, most_docs / n)))])
    drawn = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 2)
    sample = labelled.where(drawn < F.element_at(least, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(_counted(), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = [x for x, _ in known]
    at = {x: i for i, x in enumerate(languages)}
    table = np.full((1 << BITS, len(languages)), smoothing)
    if counts.num_rows:
        column = np.array([at[x] for x in counts["lang"].to_pylist()])
        table[counts["bucket"].to_numpy(), column] += counts["n"].to_numpy()
    prior = np.array([n for _, n in known], float)
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for table in gathered(batches, 500_000):
            n = table.num_rows
            languages, score = ["und"] * n, np.zeros(n)
            if m.languages:
                bucket, row = gram_buckets(table["text"])
                grams = np.bincount(row, minlength=n)
                total = np.stack([np.bincount(row, m.log_p[bucket, k], minlength=n) for k in range(len(m.languages))], 1)
                some = np.flatnonzero(grams)
                log = total[some] + m.log_prior
                log -= log.max(1, keepdims=True)
                p = np.exp(log)
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                score[some] = p[np.arange(len(some)), best]
                for i, k in zip(some.tolist(), best.tolist(), strict=True):
                    languages[i] = m.languages[k]
            rest = [table[c].combine_chunks() for c in table.column_names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(languages, pa.string()), pa.array(score)], [*table.column_names, "lang_pred", "score"])

    return scored


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text and any others) with lang_pred and score, the posterior of that language.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model knows no
    language. Ties go to the first language in natural order. Only the text counts, all of it, so repeated
    rows agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    names = [f"c{i}" for i in range(len(others))]
    rows = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)])
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["lang_pred string", "score double"])
    out = rows.mapInArrow(_scored(shared), ddl)
    back = dict(zip(others, names, strict=True)) | {"text": "text"}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns if c in back], "lang_pred", "score")

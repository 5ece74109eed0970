"""Quality rules under weak supervision.

Rules look at a document's measurements and vote good or bad, or abstain. A latent-class model is fitted
by expectation-maximisation to the counts of vote patterns over the whole corpus: it estimates how often
each rule says bad of good documents and of each kind of bad ones, and how common those are. A document
is kept by its posterior probability of being good, not by passing every rule.

One rule's word alone can't tell its errors from a kind of bad documents of which no other rule speaks.
So every defect has two rules or more: one with the limit itself and a stricter one half as far again.
Rates are estimated under two constraints, not set: the rules of a kind's defect say bad of most of its
documents, and no rule says bad of more than a fifth of the good ones. Documents just over a limit are
then that rule's errors as soon as the stricter rule doesn't follow; those that both call bad are a kind,
however rare, as two errors seldom meet. Priors weigh a few documents, whatever the corpus.

Only the pattern counts come to the driver; there are at most 4^2 * 5^6 (250000) patterns at any size.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gathered, written
from .words import SPACE, Words, grams, mixed, raw, word_hashes, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_lower", "n_unspaced", "n_exclaims", "n_echoes", "n_fresh")
#: Words of a window inside which words are told apart, so that the share of fresh words does not fall with a text's length.
WINDOW = 500
#: Letters with case that a text needs for a vote on its capitals.
LEAST_CASED = 20
_LETTER, _UPPER, _LOWER, _UNSPACED = 1, 2, 4, 8
#: Blocks of scripts written without blanks between words: Thai to Myanmar, Khmer, Tai, Javanese, kana, Han, Yi.
_UNSPACED_BLOCKS = [(0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA48F), (0xA980, 0xA9DF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
_kinds: list[np.ndarray] = []


def _code_point_kinds() -> np.ndarray:
    """For each code point whether it is a letter, upper or title case, lower case, of a script without blanks."""
    if not _kinds:
        case = {"Lu": _LETTER | _UPPER, "Lt": _LETTER | _UPPER, "Ll": _LETTER | _LOWER, "Lm": _LETTER, "Lo": _LETTER}
        table = np.array([case.get(unicodedata.category(chr(i)), 0) for i in range(sys.maxunicode + 1)], np.uint8)
        for first, last in _UNSPACED_BLOCKS:
            table[first : last + 1] |= _UNSPACED
        _kinds.append(table)
    return _kinds[0]


def _beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters beyond ASCII of UTF-8 ``data`` start, and their kinds."""
    at = np.flatnonzero(data >= 0xC0)
    if not len(at):
        return at, np.empty(0, np.uint8)
    lead = data[at].astype(np.int32)
    a, b, c = (data[np.minimum(at + i, len(data) - 1)].astype(np.int32) & 0x3F for i in (1, 2, 3))
    three, four = (lead & 0x0F) << 12 | a << 6 | b, (lead & 0x07) << 18 | a << 12 | b << 6 | c
    return at, _code_point_kinds()[np.where(lead < 0xE0, (lead & 0x1F) << 6 | a, np.where(lead < 0xF0, three, four))]


def _per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _later_copies(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row the number of items that equal an earlier item of the same row."""
    if not len(key):
        return np.zeros(n, np.int64)
    both = mixed(key ^ mixed(row.astype(np.uint64)))
    first = np.unique(both, return_index=True)[1]
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Whole-number measurements of each text of a column; see ``measurements``."""
    data, off = raw(column)
    n = len(off) - 1
    w = words(column)
    h, row = word_hashes(w), w.row
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = _per_row(~SPACE[data] & ((data & 0xC0) != 0x80), off)
    out["n_symbols"] = _per_row(_SYMBOL[data], off)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = edge[-1] = True
    stop = np.flatnonzero((data == 10) | edge[1:])  # a line ends before its \n or after the text's last byte
    begin = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    end = np.where(data[stop] == 10, stop, stop + 1)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    full = solid[end] > solid[begin]
    begin, end = begin[full], end[full]
    lines = Words(data, begin, end, np.searchsorted(begin, off))
    out["n_lines"] = np.diff(lines.first)
    out["n_dup_lines"] = _later_copies(word_hashes(lines), lines.row, n)
    g = grams(h, 8)
    at = np.flatnonzero(row[: len(g)] == row[7:]) if len(g) else np.empty(0, np.int64)
    key = mixed(g[at] ^ mixed(row[at].astype(np.uint64)))
    _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
    again = at[many[inverse] > 1]
    cover = np.bincount(again, minlength=len(h) + 8)[: len(h) + 8] - np.bincount(again + 8, minlength=len(h) + 8)[: len(h) + 8]
    out["n_repeat_words"] = _per_row(np.cumsum(cover)[: len(h)] > 0, w.first)
    at, kind = _beyond_ascii(data)
    bounds = np.searchsorted(at, off)
    out["n_upper"] = _per_row((data >= 65) & (data <= 90), off)
    out["n_lower"] = _per_row((data >= 97) & (data <= 122), off)
    out["n_letters"] = out["n_upper"] + out["n_lower"] + _per_row(kind & _LETTER > 0, bounds)
    out["n_upper"] += _per_row(kind & _UPPER > 0, bounds)
    out["n_lower"] += _per_row(kind & _LOWER > 0, bounds)
    out["n_unspaced"] = _per_row(kind & _UNSPACED > 0, bounds)
    out["n_exclaims"] = _per_row(data == ord("!"), off)
    echo = np.zeros(len(h), bool)
    if len(h):
        echo[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["n_echoes"] = _per_row(echo, w.first)
    starts = np.r_[0, np.cumsum(-(-out["n_words"] // WINDOW))]
    window = starts[row] + (np.arange(len(h)) - w.first[row]) // WINDOW
    out["n_fresh"] = out["n_words"] - _per_row(_later_copies(h, window, int(starts[-1])), starts)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, 1_000_000):
        m = measure(table["text"])
        rest = [c.combine_chunks() for c in table.columns]
        yield pa.RecordBatch.from_arrays([*rest, *[pa.array(m[k].astype(np.int64)) for k in MEASURES]], [*table.column_names, *MEASURES])


def measurements(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements of each text; a null text counts as empty.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_lines (with a word),
    n_dup_lines (those equal to an earlier one), n_repeat_words (words inside 8-word windows that are
    found twice or more), n_letters (of any script), n_upper and n_lower (those in upper or title case, and
    in lower case), n_unspaced (code points of scripts without blanks between words), n_exclaims, n_echoes
    (words equal to the word before), n_fresh (words not found earlier in their window of 500 words,
    counted from the text's start). Columns of ``docs`` with such names give way.
    """
    rows = docs.drop(*MEASURES)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{k} long" for k in MEASURES])
    return rows.mapInArrow(_measured, ddl)


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on and good up to ``good`` (the other way round if bad < good), else abstains."""

    name: str
    value: Column
    good: float
    bad: float

    def vote(self) -> Column:
        """1 good, 0 bad, -1 abstains; a value that can't be computed abstains."""
        v = self.value
        bad, good = (v >= self.bad, v <= self.good) if self.bad > self.good else (v <= self.bad, v >= self.good)
        return F.when(bad, 0).when(good, 1).otherwise(-1)


#: How much farther than a rule's limit that of the stricter rule on the same measurement lies.
FARTHER = 1.5
#: The rules of each defect: a kind of bad documents, of which most of them say bad.
DEFECTS = {
    "symbols": ("symbols", "far_symbols"),
    "same_lines": ("same_lines", "far_same_lines"),
    "shouting": ("capitals", "exclaims", "far_exclaims"),
    "exclaims": ("exclaims", "far_exclaims"),
    "echoes": ("echoes", "far_echoes"),
    "distinct": ("distinct", "far_distinct"),
    "word_length": ("word_length", "far_word_length"),
}


def rules() -> list[Rule]:
    """The rules in use; a share of no words is null, so a text without words gets no vote.

    Rules named far_ never abstain on a value. There is none for capitals, as clean texts may be all in
    capitals, nor for repeats, as the base rules come first.

    Where blanks do not part words, each code point counts as a unit beside the words that blanks part.
    """
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b) if isinstance(b, str) else b)
    units = F.col("n_words") + F.col("n_unspaced")
    cased = F.col("n_upper") + F.col("n_lower")
    near = [
        Rule("symbols", share("n_symbols", units), 0.05, 0.2),
        Rule("repeats", share("n_repeat_words", "n_words"), 0.2, 0.6),
        Rule("same_lines", share("n_dup_lines", "n_lines"), 0.2, 0.6),
        Rule("capitals", F.when(cased >= LEAST_CASED, share("n_upper", "n_letters")), 0.2, 0.5),
        Rule("exclaims", share("n_exclaims", units), 0.1, 0.5),
        Rule("echoes", share("n_echoes", "n_words"), 0.1, 0.3),
        Rule("distinct", share("n_fresh", "n_words"), 0.3, 0.08),
        Rule("word_length", share("word_chars", units), 9.0, 14.0),
    ]
    far = []
    for r in near:
        if any(f"far_{r.name}" in x for x in DEFECTS.values()):
            bad = r.bad * FARTHER if r.bad > r.good else r.bad / FARTHER
            far.append(Rule(f"far_{r.name}", r.value, math.nextafter(bad, r.good), bad))
    return near + far


def defects() -> list[tuple[int, ...]]:
    """The numbers of each defect's rules."""
    names = [r.name for r in rules()]
    return [tuple(names.index(n) for n in x) for x in DEFECTS.values()]


@dataclass(frozen=True)
class VoteModel:
    """Share of each class (good first, then kinds of bad), and each rule's chance to say bad of each class."""

    share: np.ndarray
    says_bad: np.ndarray  # class x rule

    @property
    def prior(self) -> float:
        return float(self.share[0])

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """Pattern x class; abstentions say nothing."""
        bad, good = (votes == 0).astype(float), (votes == 1).astype(float)
        return bad @ np.log(self.says_bad).T + good @ np.log1p(-self.says_bad).T + np.log(self.share)

    def classes(self, votes: np.ndarray) -> np.ndarray:
        x = self.log_joint(votes)
        x = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
        return x / x.sum(1, keepdims=True) if len(x) else x

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good."""
        return self.classes(votes)[:, 0]


def fit(
    votes: np.ndarray, counts: np.ndarray, defects: list[tuple[int, ...]] | None = None, steps: int = 500, errors: float = 0.003, strength: float = 20.0, least: float = 0.8, most: float = 0.2
) -> VoteModel:
    """Expectation-maximisation on vote patterns (rows of 1, 0, -1) with their counts.

    ``defects`` names the rules of each kind of bad documents; by default each rule is a kind of its own.
    A kind's rules say bad of at least ``least`` of its documents, and no rule says bad of more than
    ``most`` of the good ones. Within that all rates are estimated; the prior is ``strength`` documents of
    each class, of which rules say bad of ``errors`` (a kind's own rules: of ``1 - errors``), so a corpus of any size
    outweighs it, while rules that never vote and an empty corpus do no harm.
    """
    rules = votes.shape[1]
    defects = defects or [(r,) for r in range(rules)]
    kinds = len(defects)
    own = np.zeros((kinds + 1, rules), bool)
    for k, x in enumerate(defects):
        own[k + 1, list(x)] = True
    bad, said = (votes == 0).astype(float), (votes >= 0).astype(float)
    whole = np.stack([bad[:, x].all(1) for x in own[1:]], 1)
    member = np.zeros((len(votes), kinds + 1))
    member[:, 0] = np.where(whole.any(1), 0.05, 0.99)
    member[:, 1:] = np.where(whole.any(1)[:, None], 0.95 * whole / np.maximum(whole.sum(1, keepdims=True), 1), 0.01 / kinds)
    weight = counts.astype(float)[:, None]
    belief = np.where(own, 1 - errors, errors)
    low, high = np.where(own, least, 1e-6), np.ones((kinds + 1, rules)) - 1e-6
    high[0] = most
    model = None
    for _ in range(steps):
        mass = weight * member
        theta = (mass.T @ bad + belief * strength) / (mass.T @ said + strength)
        share = mass.sum(0) + np.r_[0.95, np.full(kinds, 0.05 / kinds)]
        new = VoteModel(share / share.sum(), np.clip(theta, low, high))
        member = new.classes(votes)
        if model is not None and max(np.abs(new.share - model.share).max(), np.abs(new.says_bad - model.says_bad).max()) < 1e-7:
            break
        model = new
    return new


def with_votes(measured: DataFrame) -> DataFrame:
    """``measured`` with each rule's vote in vote_<rule>."""
    return measured.withColumns({f"vote_{r.name}": r.vote().cast("int") for r in rules()})


def learn(voted: DataFrame) -> VoteModel:
    """The model of the vote patterns of all rows."""
    names = [f"vote_{r.name}" for r in rules()]
    patterns = voted.groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in patterns], int).reshape(-1, len(names))
    return fit(votes, np.array([r["count"] for r in patterns], float), defects())


def verdicts(voted: DataFrame, model: VoteModel, least: float = 0.5) -> DataFrame:
    """``voted`` with p_good, base_failed and kept, as ``judge`` has them."""
    # arrays name each rule once; a filter by sums of cases repeats it for each class, and its plan fills the driver
    votes = F.array(*[f"vote_{r.name}" for r in rules()])
    logs = np.stack([np.zeros_like(model.says_bad), np.log(model.says_bad), np.log1p(-model.says_bad)], -1)  # by the vote plus one
    share = F.lit(np.log(model.share).tolist())
    joint = F.transform(F.lit(logs.tolist()), lambda by_rule, k: F.aggregate(F.zip_with(votes, by_rule, lambda v, x: x[v + 1]), share[k], lambda a, b: a + b))
    odds = F.transform(F.array(joint), lambda j: F.aggregate(F.slice(j, 2, len(model.share)), F.lit(0.0), lambda a, b: a + F.exp(b - j[0])))[0]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("p_good", 1 / (1 + odds)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and measurements of each row of ``docs`` (doc_id, text), with votes, p_good, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated 8-word windows. kept: not
    base_failed and p_good of at least ``least``. Every row is judged by itself, so repeated rows agree;
    an empty or null text fails. An empty table gives no row. Measurements are written once to the shared
    folder, for the fit and for the verdicts.
    """
    voted = written(with_votes(measurements(docs.select("doc_id", "text")).drop("text")), "measured")
    return verdicts(voted, learn(voted), least)


def kept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; texts are read twice and never shuffled."""
    model = learn(with_votes(measurements(docs.select("text"))))
    columns = docs.columns
    renamed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("rest"))
    judged = verdicts(with_votes(measurements(renamed)), model, least).where("kept")
    return judged.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns])

import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from murkwater.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.Vocabulary.of_ranks(RANKS))


def split(own, texts):
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def test_equals_library(own, library, texts):
    every = [t or "" for t in texts.values()]
    assert split(own, every) == [library.encode_ordinary(t) for t in every]
    assert own.encode([])[0].tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abstremvld'' \n\t 　é文1²!.,-_A\U0001f600́"), max_size=40), max_size=6))
def test_odd_texts(own, library, some):
    assert split(own, some) == [library.encode_ordinary(t) for t in some]


def test_every_code_point(own, library):
    rng = random.Random(5)
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    texts = ["".join(x + rng.choice(["a", " ", "1", ".", ""]) for x in points[i : i + 4000]) for i in range(0, 0x33480, 4000)]
    assert split(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces(own, library):
    rng = random.Random(1)
    texts = ["a" * 3000, "".join(rng.choice("abcdeéz") for _ in range(5000)), " " * 2000, "\n" * 500 + "x", "!?" * 700]
    assert split(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_small_cache(library, texts):
    small = bpe.Encoder(bpe.Vocabulary.of_ranks(RANKS), most=500)
    for lo in range(0, len(texts), 7):
        some = [t or "" for t in list(texts.values())[lo : lo + 7]]
        assert split(small, some) == [library.encode_ordinary(t) for t in some]


def test_round_trip_and_offsets(spark, docs, texts, empty, library):
    v = bpe.Vocabulary.of_ranks(RANKS)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, v), v).collect()}
    assert {i: bytes(r.decoded).decode() for i, r in rows.items()} == {i: t or "" for i, t in texts.items()}
    for i in (900_012, 900_014):
        r, data = rows[i], (texts[i] or "").encode()
        stops = [*r.offsets[1:], len(data)]
        assert [library.decode_single_token_bytes(x) for x in r.ids] == [data[a:b] for a, b in zip(r.offsets, stops, strict=True)]
    digests = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, v), v)).collect()}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(empty, v).collect() == []


def test_offsets_decode_a_stretch_in_any_order():
    v = bpe.Vocabulary.of_ranks(RANKS)
    data = ("Ünï çödé — 文字 it's  x " * 9).encode()
    ids, _ = bpe.Encoder(v).encode([data.decode()])
    offsets = np.cumsum(v.lengths[ids]) - v.lengths[ids]
    order = np.random.default_rng(5).permutation(np.arange(7, 40))
    assert v.decode(ids[order], offsets[order]).tobytes() == data[offsets[7] : offsets[40]]
    assert v.decode(ids[:0], offsets[:0]).tobytes() == b""
    with pytest.raises(ValueError):
        v.decode(ids[[1, 5]], offsets[[1, 5]])


def check_pieces(rows, want, most=1024):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert bytes(r.tokens) == np.array(ids[at : at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    padding = 0
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= most
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


def test_packing_equals_tokenizer(docs, texts, empty):
    v, added = bpe.Vocabulary.of_json(JSON)
    library = Tokenizer.from_file(JSON)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert check_pieces(packing.pack(docs, v, added, JSON).collect(), want) == 0
    assert check_pieces(packing.pack(docs, v, added, JSON, block=5000).collect(), want) == 0
    assert packing.pack(empty, v).collect() == []


def test_costs_are_balanced():
    rng = random.Random(2)
    lengths = [rng.randint(1, 700) for _ in range(2000)]
    pieces = packing.assign(lengths, 1024, 1 / 6144)
    costs, tokens = {}, {}
    for _, _, n, s, _ in pieces:
        costs[s] = costs.get(s, 0) + packing.cost(n, 1 / 6144)
        tokens[s] = tokens.get(s, 0) + n
    full = [costs[s] for s in costs if tokens[s] == 1024]
    assert sum(tokens.values()) == sum(lengths) and len(full) == sum(lengths) // 1024
    assert max(full) < 1.12 * min(full)
    assert zlib.crc32(b"") == 0

import hashlib
import math
import random
import zlib

from murkwater.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    talks = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            talks.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [v[3] for v in sorted(x)] for c, x in talks.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(talks):
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, s in talks.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in kids.get(n, [])) or 1
        saved[n] = sum(saved[x] for x in kids.get(n, [])) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(talks[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shared_prefixes_of_every_length(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(40), *range(100, 140), *range(-30, 0), 305, 7_000_001]:
        length = rng.choice([0, 1, 2, 5, 7, 8, 9, 15, 16, 17, 30])
        split = rng.randint(0, length)
        rows += [(c, t, "user" if t % 2 else "assistant", f"common {t}" if t < split else f"{rng.randint(0, 2)} of {t} \U0001f600") for t in range(length)]
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rebuilt(rows))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "b", "usera"), (2, 0, "", "x"), (2, 1, "x", ""), (None, 0, "user", "a"), (None, None, None, None), (3, 5, "user", "1:"), (100, 0, "user", "é" * 3000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as block", "'x' as one", "3 as t1", "4 as depth", "5 as ends", "6 as _m")
    assert result(trie.prefix_trie(df)) == brute(rebuilt(rows))


def test_tables_and_empty(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert result(trie.prefix_trie(df)) == brute(rebuilt(df.select("conv_id", "turn", "role", "text").collect()))
    assert result(trie.prefix_trie(df.limit(0))) == []


def test_many_copies_and_a_very_long_talk(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1, 1500) for t in range(7)] + [(5000, t, "user", f"t{t}") for t in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rebuilt(rows))
    assert result(trie.prefix_trie(df)) == want
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(-50, 700)], "one long, two long, depth long, conv_id long")
    assert [r.sha for r in trie.end_hashes(ends, per_piece=4).collect()] == [hashlib.sha256(",".join(map(str, range(-50, 700))).encode()).hexdigest()]


def test_conversations_without_turns(spark):
    turns = spark.createDataFrame([(1, 1, "0" * 32 + "4")], "conv_id long, d long, id string")
    every = spark.createDataFrame([(0,), (1,), (2,)], "conv_id long")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert result(trie.trie(turns, every)) == sorted([(0, 0, None, 3, 1, 1, 0, sha("0,2")), (1, 1, 0, 1, 0, 1, 0, sha("1"))], key=str)

import random

from murkwater.llm import chat


def brute(rows):
    talks = {}
    for conv, turn, role, text in {tuple(r) for r in rows}:
        talks.setdefault(conv, []).append((turn, role, text))
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    turns = {c: [(r, t) for _, r, t in sorted(x, key=key)] for c, x in talks.items()}
    order = lambda c: (c is not None, c or 0)
    out = []
    for c, x in turns.items():
        if any(len(y) > len(x) and y[: len(x)] == x for y in turns.values()):
            continue
        same = [d for d, y in turns.items() if y == x]
        if min(same, key=order) == c:
            out.append((c, len(x), len(same), "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in x)))
    return sorted(out, key=lambda r: order(r[0]))


def result(df):
    return sorted((tuple(r) for r in chat.format_chats(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_snapshots_copies_and_ties(spark):
    rng = random.Random(4)
    rows = []
    for c in range(120):
        length = rng.randint(1, 5)
        base = rng.randint(0, 6)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base} says {t if rng.random() < 0.9 else 'other'}") for t in range(length)]
    rows += [(500, 0, None, None), (501, 0, None, ""), (502, 0, "user", "a"), (502, 0, "user", "a"), (502, 0, "user", "b"), (502, None, "system", "first"), (None, 0, "user", "a"), (None, 1, None, "x"), (503, 0, "user", "a"), (503, 1, None, "x")]
    schema = "conv_id long, turn long, role string, text string"
    assert result(spark.createDataFrame(rows, schema).repartition(4)) == brute(rows)


def test_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert result(df) == brute(df.select("conv_id", "turn", "role", "text").collect())
    assert result(df.limit(0)) == []


def test_many_copies_of_one_talk(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(2000) for t in range(3 if c else 4)]
    got = result(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r[0], r[1], r[2]) for r in got] == [(0, 4, 1)]


def test_clashing_columns_and_a_very_long_talk(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(4000)] + [(2, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(3999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as at", "1 as one", "2 as two", "3 as turns", "4 as copies", "5 as chat", "6 as kept", "7 as fresh")
    got = chat.format_chats(df).collect()
    assert [(r.conv_id, r.n_turns, r.copies, r.chat.count("<|im_end|>")) for r in got] == [(1, 4000, 1, 4000)]

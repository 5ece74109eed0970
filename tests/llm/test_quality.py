import collections
import re

import numpy as np

from murkwater.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_measurements_equal_brute_force(docs, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}
    failed = {r.doc_id: r.base_failed for r in quality.judge(docs).collect()}
    assert all(failed[i] == (b[0] < 20 or 100 * b[4] > 30 * b[0]) for i, b in ((i, brute(t)) for i, t in texts.items()))


def test_agrees_with_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good = {(bool(r.quality), r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert good.get((True, False), 0) == 0
    assert good.get((False, True), 0) <= 0.05 * (good.get((False, True), 0) + good[False, False])


def test_model_finds_kinds_and_accuracies():
    rng = np.random.default_rng(3)
    n = 20_000
    kind = rng.choice(4, n, p=[0.85, 0.07, 0.05, 0.03])
    chance = np.array([[0.004, 0.004, 0.004, 0.004], [0.95, 0.02, 0.02, 0.02], [0.02, 0.9, 0.85, 0.02], [0.02, 0.02, 0.3, 0.9]])
    votes = np.where(rng.random((n, 4)) < 0.1, -1, np.where(rng.random((n, 4)) < chance[kind], 0, 1))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts)
    good = model.posterior(patterns)[inverse] >= 0.5
    assert (good == (kind == 0)).mean() > 0.97
    assert abs(model.prior - 0.85) < 0.03 and model.says_bad[0].max() < 0.01


def test_expression_equals_model(docs):
    voted = quality.with_votes(quality.measurements(docs.select("doc_id", "text")))
    model = quality.learn(voted)
    names = [f"vote_{r.name}" for r in quality.rules()]
    rows = quality.verdicts(voted, model).collect()
    want = model.posterior(np.array([[r[n] for n in names] for r in rows]))
    assert np.allclose([r.p_good for r in rows], want)


def test_empty(empty):
    assert quality.judge(empty).collect() == []


def test_kept_rows_are_whole(docs):
    judged = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = quality.kept(docs)
    assert rows.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} == judged
    one = docs.where("doc_id = 0")
    assert rows.where("doc_id = 0").collect() in ([], one.collect())


def _others():
    """Clean texts that are unlike the rest: other scripts with a few Latin names, and very long ones."""
    rng = np.random.default_rng(11)
    pick = lambda letters, n, m: ["".join(rng.choice(list(letters), m)) for _ in range(n)]
    russian = pick("абвгдежзиклмнопрстуфхцчшыюя", 400, 6)
    han = "".join(chr(0x4E00 + i) for i in range(3000))
    names = ["IBM", "NASA", "CPU", "DNA", "HTML", "USB"]
    out = []
    for _ in range(9):
        out.append(" ".join(["IBM", *rng.permutation(russian)[:200]]))
        out.append(" ".join(f"{x}{rng.choice(names)}{y}\u3002" for x, y in zip(pick(han, 30, 18), pick(han, 30, 12), strict=True)))
        out.append(" ".join(f"{x}" for x in pick("กขคงจฉชซญดตถทธนบปผพฟมยรลวสหอ", 25, 40)))
        out.append(" ".join(f"word{i}" for i in rng.integers(0, 4000, 60_000)))
    return out


def test_clean_texts_of_other_scripts_and_lengths_stay(spark, sf):
    names = [f"vote_{r.name}" for r in quality.rules()]
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    others = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(_others())], "doc_id long, text string")
    got = quality.judge(docs.union(others)).where("doc_id >= 10000000").collect()
    assert len(got) == 36
    assert [(r.doc_id, n) for r in got for n in names if r[n] == 0] == []
    assert all(r.kept for r in got)


def test_case_counts_in_every_script(spark):
    texts = ["ВСЕ БУКВЫ ЗДЕСЬ ЗАГЛАВНЫЕ " * 8, "Καλημέρα κόσμε όμορφε σήμερα " * 8, "IBM", "字字字 IBM NASA 字字字字字字字字", "one two " * 200 + "three"]
    voted = quality.with_votes(quality.measurements(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = sorted(voted.collect(), key=lambda r: r.doc_id)
    assert [r.vote_capitals for r in got] == [0, 1, -1, -1, 1]
    assert [(r.n_letters, r.n_upper, r.n_lower, r.n_unspaced) for r in got][:4] == [(176, 176, 0, 0), (200, 8, 192, 0), (3, 3, 0, 0), (18, 7, 0, 11)]
    assert got[4].vote_distinct == 0 and got[4].n_fresh == 3


def test_far_junk_goes_however_rare(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    plain = [f"w{i}" for i in range(40)]
    junk = [" ".join(x for w in plain[:8] for x in [w] * 6), "!!! ".join(plain) + "!!!", " ".join("q" * 60 + w for w in plain)]
    doubled = " ".join(x for w in plain[:14] for x in [w] * 2) + " " + " ".join(plain[14:])
    both = docs.union(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate([*junk, doubled])], "doc_id long, text string"))
    got = {r.doc_id: r for r in quality.judge(both).where("doc_id >= 10000000").collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[10_000_000 + i].kept for i in range(4)] == [False, False, False, True]


def _corpus(rng, n, errors, junk=0.07):
    """Votes of four rules and their stricter twins: good documents with errors of the rules, and two kinds of junk."""
    kind = rng.choice(3, n, p=[1 - junk - 0.02, junk, 0.02])
    bad = np.zeros((n, 8), bool)
    bad[:, :4] = (rng.random((n, 4)) < errors) & (kind == 0)[:, None]
    bad[kind == 1] = [True, False, False, False, True, False, False, False]
    bad[kind == 2] = [False, True, True, False, False, True, True, False]
    bad[(kind == 1) & (rng.random(n) < 0.05), 4] = False
    votes = np.where(bad, 0, 1)
    votes[:, :4][rng.random((n, 4)) < 0.1] = -1
    return kind, votes


PAIRS = [(0, 4), (1, 5), (2, 6), (3, 7)]


def test_error_rates_are_estimated_and_clean_documents_stay():
    for errors in (0.005, 0.02, 0.1):
        kind, votes = _corpus(np.random.default_rng(7), 30_000, errors)
        patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        verdicts = []
        for more in ({}, {"errors": 0.001}, {"errors": 0.01}, {"strength": 6.0}, {"strength": 60.0}, {"least": 0.7}, {"most": 0.4}):
            model = quality.fit(patterns, counts, PAIRS, **more)
            verdicts.append(model.posterior(patterns)[inverse] >= 0.5)
            # junk of which only the first rule says bad may be taken for its errors
            assert abs(model.says_bad[0, :4] - errors).max() < 0.2 * errors + 0.001 + 0.05 * 0.07
        assert all((v == verdicts[0]).all() for v in verdicts)
        assert (verdicts[0][kind == 0]).mean() > 0.9999
        assert (verdicts[0][kind > 0]).mean() < 0.2 * (kind == 1).sum() / (kind > 0).sum()  # a tenth of them is without the first vote


def test_fit_equals_plain_loops():
    votes = np.array([[1, 1, 1, 1], [0, 1, 1, 1], [0, 1, 0, -1], [1, 0, 1, 0], [-1, 0, 1, 0], [0, -1, 0, 1]])
    counts = [500, 12, 30, 20, 6, 9]
    defects = [(0, 2), (1, 3)]
    share, member = None, []
    for v in votes.tolist():
        whole = [all(v[r] == 0 for r in d) for d in defects]
        member.append([0.05, *(0.95 * w / sum(whole) for w in whole)] if any(whole) else [0.99, 0.005, 0.005])
    for _ in range(500):
        theta, mass = [], [sum(c * x[k] for c, x in zip(counts, member)) for k in range(3)]
        for k in range(3):
            row = []
            for r in range(4):
                own = k > 0 and r in defects[k - 1]
                said = sum(c * x[k] for c, x, v in zip(counts, member, votes) if v[r] >= 0)
                bad = sum(c * x[k] for c, x, v in zip(counts, member, votes) if v[r] == 0)
                t = (bad + 20 * (0.997 if own else 0.003)) / (said + 20)
                row.append(min(max(t, 0.8 if own else 1e-6), 0.2 if k == 0 else 1 - 1e-6))
            theta.append(row)
        share = [mass[0] + 0.95, mass[1] + 0.025, mass[2] + 0.025]
        share = [x / sum(share) for x in share]
        member = []
        for v in votes.tolist():
            joint = []
            for k in range(3):
                p = share[k]
                for r in range(4):
                    p *= 1 if v[r] < 0 else theta[k][r] if v[r] == 0 else 1 - theta[k][r]
                joint.append(p)
            member.append([p / sum(joint) for p in joint])
    model = quality.fit(votes, np.array(counts), defects)
    assert np.allclose(model.share, share, atol=1e-5) and np.allclose(model.says_bad, theta, atol=1e-4)


def test_no_votes_ties_and_repeated_rows(spark):
    model = quality.fit(np.empty((0, 4), int), np.empty(0), [(0, 2), (1, 3)])
    assert model.posterior(np.array([[1, 1, 1, 1], [-1, -1, -1, -1]])).min() > 0.5
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text), (2, text + " ### *** $$$ %%% " * 10)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as p_good", "3 as vote_symbols")).collect()
    assert len({(r.kept, r.p_good) for r in got if r.doc_id != 2}) == 1 and all(r.kept for r in got if r.doc_id != 2)


def test_plan_names_each_rule_a_few_times(docs):
    """The filter by posteriors does not repeat the rules for every class: the plan has at most two cases a rule, and fits the driver."""
    plan = quality.kept(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and 0 < plan.count("CASE WHEN") <= 2 * len(quality.rules())

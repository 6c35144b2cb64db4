import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoframe.llm import neardup
from chronoframe.llm.mixing import DIMENSIONS, mix_sources, mixing_report, sample_mixed
from chronoframe.llm.neardup import Darts, Shingles, keep_one_of_each, near_duplicates
from chronoframe.llm.quality import binomial_tail, keep_good, quality_rules, risk_controlled
from chronoframe.llm.toxicity import ORDER, Model, discounts, drop_toxic, fit_curve, grams, score_toxicity, spell

SF = "/root/testdata/sf0.001"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(4), []
    for _ in range(60):
        words = _words(rng, rng.randint(3, 150)).split()
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            other = list(words)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = "changed"
            rows.append(" ".join(other).upper())
    passage = _words(rng, 60)
    rows += [f"{_words(rng, 50)} {passage} {_words(rng, 50)}" for _ in range(40)] + ["", None, "", "one", "one"]
    return spark.createDataFrame([(i, t, "a") for i, t in enumerate(rows)], "doc_id long, text string, class_id string").repartition(3)


def _classes(rows, limit=0.8):
    """Brute force: weighted Jaccard similarity of the counts of five-word shingles."""

    def shingles(text):
        w = re.findall(r"\w+", (text or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i, _ in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in rows:
        for j, t in rows:
            if i < j:
                a, b = sets[i], sets[j]
                same = (a & b).total() if a and b else 0
                if (s or "") == (t or "") or a and b and same >= limit * (a | b).total():
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_equal_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = _classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == want
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_groups_below_the_threshold_give_linear_rows(spark, monkeypatch):
    """Copies of one text, changed so much that most pairs lie below the threshold, over several packs."""
    monkeypatch.setattr(neardup, "PACK", 16)
    rng = random.Random(12)
    base = _words(rng, 80).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(80)] = f"other{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    want = _classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    monkeypatch.setattr(neardup, "_across", lambda *a, f=neardup._across: made.append(neardup.materialized(f(*a))) or made[-1])
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()} == want and 1 < len(set(want.values())) < 120
    # at most (labels - 1) links for each of the 36 pairs of packs, where all pairs would be 7140
    assert 0 < made[0].count() < 8 * 120


def test_joining_links_are_exact():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    packs = [[{"node": bytes([s, i]), "label": bytes([i % 7]), "s": np.sort(rng.choice(pool, rng.integers(20, 60), replace=False)).tobytes()} for i in range(30)] for s in (0, 1)]
    for a, b, same in ((packs[0], packs[1], False), (packs[0], packs[0], True)):
        got = list(neardup.joining_links(a, b, 0.6, same))
        label = {m["node"]: m["label"] for m in a + b}
        sets = {m["node"]: set(np.frombuffer(m["s"], np.uint64).tolist()) for m in a + b}
        linked = lambda x, y: len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])
        want = {(x["node"], y["node"]) for x in a for y in b if x["label"] != y["label"] and linked(x["node"], y["node"])}
        assert all((x, y) in want for x, y in got) and len(got) < 7

        def groups(pairs):
            top = {v: v for v in label.values()}
            for x, y in pairs:
                x, y = label[x], label[y]
                top = {k: min(top[x], top[y]) if v in (top[x], top[y]) else v for k, v in top.items()}
            return top

        assert groups(got) == groups(want)


def test_keep_one_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 5, 6, 7, 8)], "doc_id long, text string, `node` int, `__key` int, `a.b` int, id int")
    assert [tuple(r) for r in keep_one_of_each(df).collect()] == [(1, "a b c", 1, 2, 3, 4)]


def test_near_duplicates_odd(spark, docs):
    df = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "q"), (5, "q")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates(df).collect()) == [("5", "5"), ("5", "5"), ("None", "None"), ("None", "None")]
    assert keep_one_of_each(df).count() == 2 and near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_without_or_with_repeated_ids(spark):
    a, b, c = (_words(random.Random(i), 60) for i in range(3))
    near = " ".join([*a.split()[:-1], "changed"])
    rows = [(None, "x y z"), (None, "x y z"), (None, "q r s"), (None, None), (5, b), (5, c), (5, c), (7, near), (3, a), (3, "other"), (None, b)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [(None, "x y z"), (None, "q r s"), (None, None), (5, b), (5, c), (3, a), (3, "other")]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want)
    low = spark.createDataFrame([(1, a), (1, near), (2, a)], "doc_id long, text string")
    assert keep_one_of_each(low).count() == 1


def test_darts_estimate_weighted_jaccard():
    darts, s, rng = Darts(512), Shingles(1), random.Random(8)
    for _ in range(6):
        a = Counter(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 200)))
        b = Counter(a) + Counter(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 100)))
        text = lambda c: " ".join(w for w, n in c.items() for _ in range(n))
        x, y = (darts.signature(s.of(text(c), weighted=True)) for c in (a, b))
        want = sum((a & b).values()) / sum((a | b).values())
        assert abs((x == y).mean() - want) < 5 * math.sqrt(want * (1 - want) / 512) + 0.01


def test_quality_base(spark):
    rng = random.Random(2)
    texts = [_words(rng, 80), "a b c d " * 30, "x", "", None, "##$ " * 60, "same line here\n" * 40, _words(rng, 10) + "\n\n" + _words(rng, 60), "é\u00a0ü " * 55, "a\tb\x0bc\x0cd\re " * 20]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = {r["doc_id"]: r for r in quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = list(zip(w, w[1:], w[2:], strict=False))
        often = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) == (not r["kept"])
    assert quality_rules(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_binomial_is_exact(spark):
    cases = [(50, 0, 0.1), (50, 2, 0.1), (1000, 3, 0.01), (20000, 60, 0.005), (10, 9, 0.5), (0, 0, 0.1)]
    for n, k, p in cases:
        got = spark.range(1).select(binomial_tail(F.lit(n), F.lit(k).cast("long"), p)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k < n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_bound_false_rejection(spark):
    rows = [(i, "en", 1, 0.0 if i % 400 else 0.35) for i in range(4000)] + [(5000 + i, "en", 0, 0.45) for i in range(300)] + [(9000 + i, "xx", 1, 0.0) for i in range(20)] + [(9500, "xx", 0, 0.45)]
    df = spark.createDataFrame(rows, "id long, s string, quality int, m double")
    cut = risk_controlled(df.drop("quality"), df.select("id", "quality"), "id", "s", grid={"m": [0.5, 0.4, 0.3]}, alpha=0.002)
    assert [tuple(r) for r in cut.collect()] == [("en", 0.4)]  # 0.3 would reject ten of 4000; xx has too few labels


def _raked(cells, keep, targets, rounds=400):
    """Brute force: expected tokens of the cells under caps, every factor by bisection."""
    total = keep * sum(cells.values())

    def solved(goal, own):
        if goal >= sum(t for t, _ in own) * (1 - 1e-12):
            return 1e6
        lo, hi = 0.0, 1e12
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(t, mid * w) for t, w in own) < goal else (lo, mid)
        return lo

    w = {c: keep * t for c, t in cells.items()}
    goals = []
    for i, d in enumerate(DIMENSIONS):
        there = {k: sum(t for c, t in cells.items() if c[i] == k) for k in targets[d]}
        f = solved(total, [(there[k], v) for k, v in targets[d].items()])
        goals.append({k: min(there[k], f * v) for k, v in targets[d].items() if there[k] and v})
    for _ in range(rounds):
        for i in range(3):
            f = {k: solved(g, [(cells[c], w[c]) for c in cells if c[i] == k]) for k, g in goals[i].items()}
            w = {c: min(x * f.get(c[i], 0.0), cells[c] * 1e12) for c, x in w.items()}
    return {c: min(cells[c], x) for c, x in w.items()}


@pytest.mark.parametrize("keep", [0.03, 0.1, 0.5])
def test_mixing(spark, keep):
    rng = random.Random(1)
    rows = [(i, " ".join(["|" if rng.random() < 0.4 and i % 5 == 0 else "w"] * rng.randint(1, 900)), rng.choice(["s0"] * 6 + ["s1", "s2", None]), rng.choice(["en", "en", "fr"])) for i in range(1500)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"s0": 0.3, "s1": 0.3, "s2": 0.3, "*": 0.1}, "lang": {"en": 0.5, "fr": 0.5, "*": 0.0}, "topic": {"short": 0.1, "medium": 0.5, "long": 0.3, "tabular": 0.1}}
    got = mix_sources(df, keep=keep, targets=targets)
    rows_ = got.collect()
    cells, expected = Counter(), Counter()
    for r in rows_:
        c = (r["source"] or "*", r["lang"] or "*", r["topic"])
        cells[c] += r["n_tokens"]
        expected[c] += r["n_tokens"] * r["probability"]
    want = _raked(cells, keep, targets)
    total = sum(expected.values())
    for c in cells:
        assert expected[c] == pytest.approx(want[c], abs=2e-3 * total), c
    report = {(r["dimension"], r["value"]): r for r in mixing_report(df, keep, targets).collect()}
    for i, d in enumerate(DIMENSIONS):
        for k, v in targets[d].items():
            share = sum(x for c, x in expected.items() if c[i] == k) / total
            if v:
                assert report[d, k]["expected"] == pytest.approx(share, abs=1e-9) and report[d, k]["target"] == v
                if keep < 0.5:  # half of all tokens leaves too few of the rare values
                    assert share == pytest.approx(v, rel=5e-3), (d, k)
    assert total == pytest.approx(keep * sum(cells.values()), rel=5e-3)
    kept = {r["doc_id"] for r in rows_ if r["kept"]}
    sample = sample_mixed(df, keep=keep, targets=targets)
    assert sample.columns == df.columns and {r["doc_id"] for r in sample.collect()} == kept and 0 < len(kept) < 1200
    assert mix_sources(df.limit(0)).count() == 0 and len(rows_) == len(rows)


def test_mixing_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "src0", "en", 9, 8, 7), (1, "a b", "src0", "en", 9, 8, 7)], "doc_id long, text string, source string, lang string, `a.b` int, c0 int, tokens int")
    assert {tuple(r) for r in sample_mixed(df, keep=1.0).collect()} == {(1, "a b", "src0", "en", 9, 8, 7)}


def test_toxicity(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(800):
        words, toxic = _words(rng, 60).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["zzrude", "zzvile", "zzgrim"]) + rng.choice(["", "ly", "est"])
        rows.append((i, " ".join(words), 1.0))
        if i % 2:
            labels.append((i, int(toxic)))
    rows += [(None, "x", 0.0), (9001, None, 0.0), (9002, "", 0.0)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(df, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in range(800)) >= 790
    assert got[9001]["predicted"] == got[9002]["predicted"] == 0
    kept = drop_toxic(df, known)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert score_toxicity(df, known.limit(0)).agg(F.max("score")).first()[0] == 0
    assert score_toxicity(df.limit(0), known).count() == 0


def test_toxicity_rare_words():
    assert discounts(np.array([1] * 60 + [2] * 20 + [3] * 10 + [4] * 5))[1] < 1  # a word met once keeps mass of its own
    common = ["abcd", "bcda", "cdab", "dabc", "aabb"]

    def counted(words, n):
        codes, place, _ = spell(words)
        g = grams(codes, place, ORDER)[0]
        return g, np.full(len(g), n)

    def shared(words):
        codes, place, _ = spell(words)
        found = []
        for order in range(2, ORDER + 1):
            g, at = grams(codes, place, order)
            found.append(g if order == 2 else g[place[at] >= order - 1])
        g = np.concatenate(found)
        return g, np.ones(len(g), int)

    join = lambda a, b: tuple(np.concatenate(x) for x in zip(a, b, strict=True))
    model = Model([counted(common, 40), join(counted(common, 40), counted(["zyxz"], 4))], shared([*common, "zyxz"] + ["zabc", "zbcd"] * 9))
    rude, rare, plain, new = model.word_ratios(["zyxz", "zyxa", "abcd", "qqqq"])
    assert rude > 0.5 and rude > rare and abs(plain) < 0.2 and abs(new) < 0.05


def test_toxicity_gram_packing():
    codes, place, owner = spell(["ab", "c" * 60, "7\u4e00"])
    assert owner.max() == 2 and (codes < 1 << 10).all() and (place == 0).sum() == 4  # the long word is spelled in two parts
    g, at = grams(codes, place, 3)
    assert g[0] == 1 << 10 | ord("a") and g[1] == (1 << 10 | ord("a")) << 10 | ord("b") and place[at[0]] == 1


def test_toxicity_curve_follows_prior_without_labels():
    slope, offset = fit_curve(np.zeros(0), np.zeros(0), np.zeros(0))
    assert (slope, offset) == (60.0, -3.0)


def test_keep_good_agrees_with_rules(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = keep_good(docs, labels)
    want = {r["doc_id"] for r in quality_rules(docs, labels).filter("kept").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality rules", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    now, seen = docs, defaultdict(set)
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialized(f(spark, now, SF))
        seen[name] = {r["doc_id"] for r in now.collect()}
        assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == seen["mixing sources to target weights"] and all(r["decodes"] for r in out)
    before = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in seen["quality rules"]]
    assert seen["MinHash near-dedup"] == set(_classes(before).values())


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing names."""
    long = " ".join(f"word{i % 977} other{i % 1013}" for i in range(60_000))
    good = _words(random.Random(3), 90)
    rows = [(None, None, None, None, None, 1, 2), (1, "", "en", "src0", 0, 1, 2), (2, long, "en", "src1", 9, 1, 2), (3, good, "de", "src2", 9, 1, 2), (3, good, "de", "src2", 9, 1, 2), (None, good + " x", None, None, 9, 1, 2), (4, "a " * 3000, "en", "src0", 9, 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, __id int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(3, 1, 0), (2, 1, None), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.materialized(f(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
        assert now.exceptAll(before).isEmpty(), name
        if name == "toxicity":
            assert now.count() == len(rows)
        if name == "MinHash near-dedup":
            assert sorted(r["doc_id"] or 0 for r in now.collect()) == [2, 3]
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == len(rows) and last.filter("not decodes").isEmpty()


def test_long_texts_through_every_operator(spark):
    long = " ".join(f"word{i % 977} other{i % 1013}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "en"), (2, long, "en"), (3, long + " end", "en")], "doc_id long, text string, lang string")
    assert {r["class_id"] for r in near_duplicates(df).collect()} == {1}
    r = quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert r["n_words"] == 120_000 and not r["base_failed"] and r["n_repeat_words"] == 0
    assert score_toxicity(df, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")).count() == 3


def test_operators_leave_the_session_as_it_is(spark):
    from chronoframe.llm import common

    before = {k: spark.conf.get(k) for k in common.ARROW}
    common.materialized(common.arrow_map(spark.range(5), lambda b: [(x,) for x in b["id"]], "id long")).collect()
    assert {k: spark.conf.get(k) for k in common.ARROW} == before

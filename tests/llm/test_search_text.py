import itertools
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamap.llm import neighbours, surrogates, toxicity


def test_hilbert_curve_steps_to_neighbours():
    for n, b in ((2, 4), (3, 3), (4, 2), (5, 2)):
        g = np.array(list(itertools.product(range(1 << b), repeat=n)))
        k = neighbours.hilbert_keys(g, b)
        assert sorted(k.tolist()) == list(range(len(g)))
        assert (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, queries, k):
    out = []
    for q in queries:
        v = next(v for i, v in rows if i == q)
        s = sorted(((-float(np.dot(np.float32(v).astype(float), np.float32(w).astype(float))), i) for i, w in rows if i != q))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def test_search_is_exact_within_windows_and_keeps_ties(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(1000 + i, [1.0, 2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    bad = [(301, None), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [math.nan] * 8), (305, []), (None, [1.0] * 8), (306, [math.inf] * 8), (307, [1.0])]
    d = spark.createDataFrame(rows + bad, "id long, v array<float>")
    got = [tuple(x) for x in neighbours.search(d, d.filter("id % 20 = 0").select("id"), k=5).orderBy("query_id", "rank").collect()]
    want = brute(rows, sorted(i for i, _ in rows if i % 20 == 0), 5)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)
    assert neighbours.search(d.limit(0), d.limit(0).select("id")).count() == 0


def test_search_recall_with_narrow_windows(spark):
    x = np.random.default_rng(1).normal(size=(3000, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    found = neighbours.search(d, d.filter("id % 100 = 0").select("id"), k=10, window=100, block=256).collect()
    s = x[::100] @ x.T
    hits = 0
    for a, q in enumerate(range(0, 3000, 100)):
        s[a, q] = -np.inf
        hits += len(set(np.argsort(-s[a])[:10].tolist()) & {f.id for f in found if f.query_id == q})
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_measured_windows_keep_recall(spark, kind, monkeypatch):
    """The window is measured on a sample of queries; recall over all queries follows, however the vectors lie."""
    monkeypatch.setattr(neighbours, "EXACT", 1000)
    monkeypatch.setattr(neighbours, "SAMPLE", 60)
    n, draw = 6000, np.random.default_rng(4)
    v = draw.normal(size=(n, 32)) if kind == "isotropic" else draw.normal(size=(60, 32))[draw.integers(0, 60, n)] + 0.2 * draw.normal(size=(n, 32))
    v = v.astype(np.float32).astype(float)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    got = {}
    for r in neighbours.search(d, d.filter("id % 20 = 0").select("id"), k=10, curves=24).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q in range(0, n, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += sum(x >= np.sort(s)[-10] - 1e-9 for x in got[q])
    assert hits / (10 * n / 20) >= 0.9


def test_needed_window():
    d = np.array([[5, 9], [100, 2], [7, 7], [300, 400]])
    assert neighbours.needed_window(d, 0.5) == 7 and neighbours.needed_window(d, 0.99) == 300 and neighbours.needed_window(np.zeros((0, 2))) == 1


def test_copies_with_one_id_are_neighbours_of_each_other(spark):
    d = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in neighbours.search(d, d.filter("id = 20").select("id"), k=2).collect())
    assert got == [(20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 3, 0.5), (20, 2, 3, 0.5)]


@pytest.mark.parametrize(("curves", "window"), [(4, None), (1, 1)])
def test_results_do_not_depend_on_size_windows_or_curves(spark, curves, window, monkeypatch):
    monkeypatch.setattr(neighbours, "EXACT", 7)  # many times fewer than queries, and than classes
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(600)] + [(1000 + i, [float(r.randint(-1, 1)) for _ in range(11)] + [1.0]) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, v array<float>")
    got = [tuple(x) for x in neighbours.search(d, d.filter("id % 20 = 0").select("id"), k=10, curves=curves, window=window).orderBy("query_id", "rank").collect()]
    want = brute(rows, sorted(i for i, _ in rows if i % 20 == 0), 10)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_exact_check_finds_all_that_reach_the_bar_and_keeps_ties():
    draw = np.random.default_rng(6)
    for v in (draw.integers(-1, 2, (400, 6)).astype(float), draw.normal(size=(8, 6))[draw.integers(0, 8, 400)] * 9 + 0.1 * draw.normal(size=(400, 6))):
        classes, first, s = np.arange(400), draw.permutation(400), v @ v.T
        np.fill_diagonal(s, -np.inf)
        bars = np.where(classes[:40] % 3 == 0, -np.inf, np.sort(s[:40], axis=1)[:, -5])
        want = [[j for j in np.lexsort((first, -np.round(s[i], 9))) if s[i, j] >= bars[i] - 1e-9 and j != i][:5] for i in range(40)]
        got = [[] for _ in want]
        for at in range(0, 400, 50):
            q, c, x = neighbours.above(classes[:40], v[:40], bars - 1e-9, classes[at : at + 50], first[at : at + 50], v[at : at + 50], 5)
            for i, j, y in zip(q.tolist(), c.tolist(), x.tolist(), strict=True):
                got[i].append((-round(y, 9), first[j], j))
        assert [[j for *_, j in sorted(g)[:5]] for g in got] == want


def corpus(n=3000, seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choice(["ba", "ko", "mi", "tu", "re", "lo"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.12)
        for _ in range(r.randint(2, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "zorgh" + r.choice(plain), "zorgh" + r.choice(plain)]))
        rows.append((i, " ".join(words)))
        if r.random() < 0.5:
            labels.append((i, toxic))
    return rows, labels, {i: t for i, t in labels}


def test_toxicity_on_held_out_rows(spark):
    rows, labels, truth = corpus()
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5001, "you are an idiot , moron"), (5001, "you are an idiot , moron")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model, seen = toxicity.train(docs, lab)
    assert ("zorgh", False) in model.entries
    out = toxicity.score(seen, model).withColumn("h", toxicity.held_out()).collect()
    assert len(out) == len(rows) + 4 and all(0 <= x.score <= 1 for x in out)
    mine = [x for x in out if x.h and x.doc_id in truth]
    hit = sum(x.predicted == truth[x.doc_id] for x in mine)
    assert len(mine) > 200 and hit / len(mine) > 0.97
    assert all(x.predicted == 0 for x in out if x.doc_id in (None, 5000)) and all(x.predicted == 1 for x in out if x.doc_id == 5001)
    kept = toxicity.keep_clean(docs.withColumn("votes", F.lit("k")), lab)
    assert kept.columns == ["doc_id", "text", "votes"] and kept.filter("text like '%idiot%'").isEmpty()


def test_every_disguise_is_looked_for():
    for c, plain in toxicity.DISGUISE.items():
        word = next(w for w in toxicity.INSULTS if w.isascii() and 4 <= len(w) <= 12 and chr(plain) in w[1:])
        text = word[0] + word[1:].replace(chr(plain), chr(c))
        # An exclamation mark alone is no disguise, as it may only end a sentence.
        text = "id!0t" if chr(c) == "!" else text
        votes, _ = toxicity.findings(f"you {text}", ())
        said = {v for i, v in enumerate(toxicity.VOTERS) if votes >> i & 1}
        assert "disguised" in said and "clean" not in said, text


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, "fine words here" if i % 5 else "what a stupid idiot you moron") for i in range(200)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model, seen = toxicity.train(docs, none)
    assert all(x.predicted == (x.doc_id % 5 == 0) for x in toxicity.score(seen, model).collect())
    model, seen = toxicity.train(docs.limit(0), none)
    assert toxicity.score(seen, model).count() == 0


def test_classifier_is_trained_in_blocks_of_doubles():
    r = np.random.default_rng(1)
    x = (r.random((20000, 224)) < 0.05).astype(np.float32)
    y = 1 / (1 + np.exp(-(x[:, :20].sum(axis=1, dtype=float) * 2 - 3)))
    tracemalloc.start()
    w = toxicity.logistic(x, y, np.ones(len(y)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Not a copy of all rows as doubles (36 MB), as the driver has little memory.
    assert most < 16e6
    full = np.column_stack([x, np.ones(len(x))]).astype(float)
    ridge = np.r_[np.full(224, 1e-3 * len(y)), 1e-9]
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(full.T @ (p - y) + ridge * w).max() < 1e-2


def test_label_model_discounts_correlated_voters():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.2
    v = np.zeros((20000, len(toxicity.VOTERS)))
    v[:, :3] = (y & (r.random(20000) < 0.7))[:, None] | (~y & (r.random(20000) < 0.01))[:, None]
    v[:, 3] = np.where(y, r.random(20000) < 0.7, r.random(20000) < 0.01)
    v[:, toxicity.NEGATIVE] = np.where(y, r.random(20000) < 0.05, r.random(20000) < 0.9)[:, None]
    m = toxicity.LabelModel.fit(v, np.ones(len(v)), 0.2)
    assert m.worth[0] < 0.6 * m.worth[3] and m.correlation[0, 1] > 0.9 and m.accuracy[3] > 0.85
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.93


TEXTS = [
    "Call Mr John Smith or John Smith at +1 (743) 555-3824, mail und.92@mail6.example.com.",
    "Frau Weber, 227.5.221.1 and 9807915762804490; 4111 1111 1111 1111 ok UND.92@MAIL6.EXAMPLE.COM und.92@mail6.example.com",
    None, "", "123-45-6789 and DE89 3704 0044 0532 0130 00 and 9233a8ecf7c5b09fe5949719b6b82bc439e9329b!",
    "господин Иван Петров и Мария Иванова", "no data here 12 34", "Dr. Mary Jones, Mary Jones, Mary Brown; 1.2.3.4 1.2.3.5",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_surrogates_keep_format_and_coreference(spark):
    d = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, _map string")
    out = surrogates.replace_entities(d)
    assert out.columns == [*d.columns, "n_entities"] and out.count() == 2 * len(TEXTS)
    got = {r.doc_id: r for r in out.collect()}
    words = got[None].text.split()
    assert words[2:4] == words[5:7] and words[1] == "Mr" and "John" not in words and "Smith" not in words
    assert got[None].text.startswith("Call Mr ") and " at +1 (" in got[None].text and got[None].text.endswith(".com.")
    assert got[1].text.split()[-1].upper() == got[1].text.split()[-2] and got[1].text.split()[-1] in got[None].text
    a, b = got[1].text.split(" and ")[1].split(";")[0], got[1].text.split("; ")[1][:19]
    assert luhn(b) and not luhn(a) and b != "4111 1111 1111 1111" and b[0] == "4"
    assert got[2].text is None and got[3].text == "" and got[6].text == TEXTS[6] and got[6].n_entities == 0
    assert not any(x in (got[4].text + got[5].text) for x in ("6789", "3704", "9233a8", "Иван ", "Мария", "Петров"))
    jones = got[7].text.replace("Dr. ", "").replace(";", ",").split(",")
    assert jones[0].strip() == jones[1].strip() != jones[2].strip() and jones[0].split()[0] == jones[2].split()[0]
    assert surrogates.replace_entities(d.limit(0)).count() == 0
    other = {r.doc_id: r.text for r in surrogates.replace_entities(d, key="another").collect()}
    assert other[None] != got[None].text


def test_surrogates_stay_distinct_where_draws_collide(spark):
    e = spark.createDataFrame([(f"{a}.{b}.{c}.7",) for a in range(1, 10) for b in range(1, 10) for c in range(1, 10)] + [(f"{a}@b.co",) for a in "abcdefghijklmnopqrstuvwxyz"] + [(f"Mr {n}{m}son",) for n in ("Ab", "Be", "Co", "Du") for m in "abcdefghijklmnopqrstuvwxyz"], "entity string")
    m = surrogates.mapping(e).collect()
    assert len(m) == e.count() == len({x.replacement for x in m}) and not {x.entity for x in m} & {x.replacement for x in m}

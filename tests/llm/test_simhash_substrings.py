import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from stratamap.llm import components, simhash, substrings


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    r = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "É a b", *[" ".join(r.choice("Ab cD é\x1cx ñ z 9".split(" ")) for _ in range(r.randint(1, 700))) for _ in range(40)]]
    assert simhash.fingerprint_texts(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_components_of_near_fingerprints(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = [0, 7, 15, *base]
    for b in base[:20]:
        for _ in range(12):
            f = b
            for bit in r.sample(range(64), r.randint(0, 5)):
                f ^= 1 << bit
            fps.append(f)
    u = sorted(set(fps))
    up = list(range(len(u)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(u)):
        for j in range(i):
            if bin(u[i] ^ u[j]).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = collections.defaultdict(set)
    for i, f in enumerate(u):
        want[root(i)].add(f)
    d = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in u], "fp long")
    got = collections.defaultdict(set)
    for x in simhash.linked_classes(d).collect():
        got[x.root].add(x.fp & (1 << 64) - 1)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a b", "k"), (3, "A B", "k"), (None, "a b", "k"), (None, "x y z w q", "k")], "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (None, None)}
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) in ([(0, "x y z w q"), (3, "A B")], [(0, "x y z w q"), (3, "a b")])
    assert kept.count() == 3
    assert simhash.keep_one(d.limit(0)).count() == simhash.near_duplicates(d.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000)], "a long, b long")
    got = {r.node: r.root for r in components.components(d).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[2001] == 2000


def test_rounds_and_one_task_give_the_same_components(spark):
    r = random.Random(5)
    links = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(300)]
    d = spark.createDataFrame(links, "a long, b long")
    up = {x: x for a, b in links if a != b for x in (a, b)}
    while any(up[a] != up[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    for together in (0, 299, 300):
        found = [(x.node, x.root) for x in components.components(d, together).collect()]
        assert len(found) == len(up) and dict(found) == up
    assert components.components(d.limit(0)).count() == 0


def test_few_links_take_no_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: (cuts.append(df), cut(df))[1])
    d = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {x.root for x in components.components(d).collect()} == {0} and len(cuts) == 1


def brute_removal(docs, n):
    count = collections.Counter(t[i : i + n] for _, t in docs for i in range(len(t) - n + 1))
    out = []
    for k, t in docs:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                m[i : i + n] = True
        left = bytes(np.frombuffer(t, np.uint8)[~m])
        out.append((k, len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_removal_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SCAN", 2000)
    monkeypatch.setattr(substrings, "PIECE", 300)
    r = random.Random(7)
    w = lambda n: bytes(r.choice(b"abcd \n") for _ in range(n))
    parts = [w(r.randint(20, 90)) for _ in range(10)]
    docs = [(i, b"".join(r.choice(parts)[r.randint(0, 5) :] if r.random() < 0.6 else w(r.randint(1, 60)) for _ in range(r.randint(0, 7)))) for i in range(90)]
    docs += [(200, b"a" * 200), (201, b"abc" * 70), (202, b"a" * 41), (203, docs[5][1]), (204, docs[5][1] + b"!"), (205, w(1500)), (206, b"")]
    d = spark.createDataFrame([(i, t.decode(), "x") for i, t in docs] + [(300, None, "x")], "doc_id long, text string, data string")
    got = sorted((x.doc_id, x.n_bytes, sum(y.high - y.low for y in x.removed), len(x.removed), hashlib.sha256(bytes(x.kept)).hexdigest()) for x in substrings.deduplicate(d, length=40, gram=8).collect())
    assert got == brute_removal([*docs, (300, b"")], 40)


def test_removal_of_odd_rows(spark):
    long = "lorem ipsum " * 60
    d = spark.createDataFrame([(None, long), (None, long), (7, "short"), (7, None)], "doc_id long, text string")
    got = [(x.doc_id, bytes(x.kept)) for x in substrings.deduplicate(d).collect()]
    assert sorted(got, key=str) == sorted([(None, b""), (None, b""), (7, b"short"), (7, b"")], key=str)
    assert substrings.deduplicate(d.limit(0)).count() == 0


def test_long_ids_next_to_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3, 2**63 - 1]
    d = spark.createDataFrame([(i, f"{k} " * 10 + "words that differ " + str(k) * 40, "x") for k, i in enumerate(ids)], "doc_id long, text string, fp string").coalesce(1)
    assert {r.doc_id for r in simhash.near_duplicates(d).collect()} == {r.doc_id for r in simhash.keep_one(d).collect()} == set(ids)
    assert {r.doc_id for r in substrings.deduplicate(d).collect()} == set(ids)


def test_very_long_text_and_many_copies(spark):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, text), (2, text[300_000:300_500]), (3, "unique " + text[:399])] + [(None, text[1000:1700])] * 30
    out = {x.doc_id: x for x in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bytes(out[None].kept) == b"" and bytes(out[2].kept) == b"" and out[3].removed == []
    assert [(x.low, x.high) for x in out[1].removed] == [(1000, 1700), (300_000, 300_500)]
    assert simhash.fingerprint_texts([text]).tolist() == [brute_fingerprint(text)]

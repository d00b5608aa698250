"""The registered queries on a small table of odd rows and on the smallest given one: columns, types and what they promise."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratamap.llm import packing, queries, simhash, surrogates, toxicity

SMALL = "/root/testdata/sf0.001"
TYPES = {
    "op3_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_hilbert_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op5_weak_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_shard_best_fit": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_repeated_substrings": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_token_store": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op9_simhash_components": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_ogg_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op1_surrogates": {"doc_id": "bigint", "text": "string"},
    "op2_pack_best_fit": {"doc_id": "bigint", "tokens": "bigint", "bin": "string", "capacity": "int", "start": "bigint"},
}
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (2**60 + 1, "You idiot, you stupid moron.", "en", "a", 1), (None, None, None, None, None), (2**60 + 3, "", "en", None, 0), (7, LONG, "en", "a", 9), (8, LONG, "en", "b", 9),
    (7, "Mr John Smith, mail jo.smith@example.org", "en", "b", 3), (7, "Mr John Smith, mail jo.smith@example.org", "en", "b", 3), (None, "plain text of a few words", "x", "c", 2), (20, " \t\n ", "en", "", 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with columns more than they need, whose names operators use themselves."""
    at = str(tmp_path_factory.mktemp("odd"))
    extra = {c: F.lit("k") for c in ("score", "bin", "piece", "feature", "error", "shard", "fp", "n_entities", "votes", "rank", "at", "row", "keys", "bytes", "hash", "th", "id", "anchor", "n", "size")}
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, 0, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    v = [(20, [1.0, 0.0, 2.0], 0), (21, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (40, None, 1), (22, [0.0, 0.0, 0.0], 1), (23, [None, 1.0, 1.0], 1), (24, [float("nan"), 1.0, 1.0], 1), (60, [1.0, 1.0, 1.0], 1), (2**60 + 3, [-1.0, 0.5, 0.5], 1)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


def rows_of(spark, name, at):
    d = queries.QUERIES[name](spark, at)
    assert {k: v for k, v in d.dtypes if k in TYPES[name]} == TYPES[name]
    return d.collect()


def test_every_query_has_its_columns_on_no_rows(spark, empty):
    for name in TYPES:
        assert rows_of(spark, name, empty) == [], name
    assert set(TYPES) == set(queries.QUERIES)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def per_row(found, of, key=None):
    """The same values, as often, for the ids and texts of the rows."""
    assert collections.Counter(found) == collections.Counter((i, *of(t)) for i, t, *_ in ROWS)


def test_bytes_and_hashes_of_odd_rows(spark, odd):
    data = lambda t: (t or "").encode()
    pad = lambda b: b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    got = rows_of(spark, "op10_ogg_media", odd)
    per_row([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], lambda t: (len(data(t)), len(pad(data(t))), hashlib.sha256(pad(data(t))).hexdigest(), zlib.crc32(pad(data(t))[-64:])))
    assert len({r.media_sha256 for r in got}) == len({(t or "") for _, t, *_ in ROWS}) and all(r.error is None and r.feature for r in got)
    got = rows_of(spark, "op8_token_store", odd)
    per_row([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], lambda t: (len(ids(t)) // 4, zlib.crc32(ids(t))))
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))] and [r.doc_id or -1 for r in order] == sorted(r.doc_id or -1 for r in got)
    got = rows_of(spark, "op7_repeated_substrings", odd)
    # Only the long text occurs twice; it repeats itself too.
    per_row([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], lambda t: (len(data(t)), len(data(t)), 1, hashlib.sha256(b"").hexdigest()) if t == LONG else (len(data(t)), 0, 0, hashlib.sha256(data(t)).hexdigest()))
    got = rows_of(spark, "op6_shard_best_fit", odd)
    per_row([(r.doc_id, r["size"], r.text_crc32) for r in got], lambda t: (len(data(t)) + 16, zlib.crc32(data(t))))
    home, slots = {}, collections.defaultdict(list)
    for r in got:
        assert home.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_groups_and_mixes_of_odd_rows(spark, odd):
    got = rows_of(spark, "op9_simhash_components", odd)
    fp = {i: f"{int(x):016x}" for i, x in enumerate(simhash.fingerprint_texts([t for _, t, *_ in ROWS]).tolist())}
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == collections.Counter((row[0], fp[i]) for i, row in enumerate(ROWS))
    blank = {r.component_id for r in got if r.fingerprint == "0" * 16}
    assert blank == {20} and {r.component_id for r in got if r.doc_id == 8} == {7}
    got = rows_of(spark, "op3_mix_sources", odd)
    per_row([(r.doc_id, r["size"]) for r in got], lambda t: (len(words(t)),))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=1) and mine[0].source_size == sum(r["size"] for r in mine)
    got = rows_of(spark, "op2_pack_best_fit", odd)
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.tokens
    assert total == collections.Counter({i: sum(len(words(t)) for j, t, *_ in ROWS if j == i) for i in {x[0] for x in ROWS}})
    got = rows_of(spark, "op5_weak_toxicity", odd)
    per_row([(r.doc_id,) for r in got], lambda t: ())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and [r.predicted for r in got if r.doc_id == 2**60 + 1] == [1]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    got = rows_of(spark, "op1_surrogates", odd)
    same = [(i, t) for i, t, *_ in ROWS if not (t or "").startswith("Mr")]
    assert collections.Counter((r.doc_id, r.text) for r in got if not (r.text or "").startswith("Mr")) == collections.Counter(same)
    two = {r.text for r in got if (r.text or "").startswith("Mr")}
    assert len(two) == 1 and "Smith" not in (t := two.pop()) and "jo.smith" not in t and t.startswith("Mr ") and t.endswith(".org")


def test_neighbours_of_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in rows_of(spark, "op4_hilbert_neighbours", odd))
    assert got == [(20, 1, 21, 3.0), (20, 2, 60, 3.0), (20, 3, 2**60 + 3, 0.0), (60, 1, 20, 3.0), (60, 2, 21, 3.0), (60, 3, 2**60 + 3, 0.0)]


def test_surrogate_cases(spark):
    texts = ["Mr John Paul Smith met Mary Ann O'Brien", "Dr McDonald wrote", "DE89 3704 0044 0532 0130 00 is valid, DE11 3704 0044 0532 0130 00 not"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in surrogates.replace_entities(d).orderBy("doc_id").collect()]
    assert not re.search("John|Paul|Smith|Mary|Ann |Brien", got[0]) and "McDonald" not in got[1] and got[1].endswith(" wrote")
    value = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    a, b = (x.replace(" ", "") for x in re.findall(r"DE\d\d(?: \d{4}){4} \d\d", got[2]))
    assert value(a) == 1 and a != "DE89370400440532013000" and b[:2] == "DE"


def test_best_fit_of_several_lengths_is_never_worse_than_any_set_alone():
    r = np.random.default_rng(3)
    sizes = sorted((int(x) for x in np.minimum(4096, r.lognormal(5.5, 1.3, 400) + 1)), reverse=True)
    bins, caps = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert caps == [min(c for c in packing.LENGTHS if c >= x) for x in loads]
    for least in (512, 1024, 2048, 4096):
        alone = packing.fill(sizes, tuple(c for c in packing.LENGTHS if c in (least, 4096)))
        assert sum(map(packing.cost, caps)) <= sum(packing.cost(packing.downsized(sum(sizes[i] for i in b), packing.LENGTHS)) for b in alone)


def test_queries_equal_their_sql_here_too(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        d, e = queries.QUERIES[name](spark, SMALL), c.sql(sql)
        names = sorted(d.columns)
        assert names == sorted(e.columns), name
        a, b = sorted(tuple(x[k] for k in names) for x in d.collect()), sorted(tuple(x[e.columns.index(k)] for k in names) for x in e.fetchall())
        assert len(a) == len(b) and all(x == pytest.approx(y, rel=1e-12) for x, y in zip(a, b, strict=True)), name


def test_pipeline_stage_by_stage(spark, odd, empty):
    for at in (odd, empty):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        seen = [docs]
        for name, stage in corpus_pipeline.STAGES:
            out, _ = corpus_pipeline.stored(stage(spark, seen[-1], at), name)
            if name != "packing":
                assert out.columns == docs.columns, name
            seen.append(out)
        assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "source_mix", "packing"]
        texts = [[r.text for r in d.collect()] for d in seen[:-1]]
        if at == empty:
            assert not any(texts)
            continue
        assert len(texts[0]) - len(texts[1]) == 1 and not any("idiot" in (t or "") for t in texts[1])
        # Blank texts are one group, and so are the copies of the long one and of the letter.
        assert sorted(len(t or "") for t in texts[2]) == sorted([len(" \t\n "), len(LONG), len("plain text of a few words"), len("Mr John Smith, mail jo.smith@example.org")])
        assert sum("Smith" in (t or "") for t in texts[3]) == 0 and len(texts[3]) == 4
        assert set(texts[4]) <= set(texts[3]) and None not in texts[4] and "" not in texts[4]
        assert sum(r.tokens for r in seen[5].collect()) == sum(len(words(t)) for t in texts[4])
        assert {r.doc_id for r in seen[5].collect()} <= {r.doc_id for r in docs.collect()}


def test_words_of_the_list_that_clean_texts_hold_do_not_count(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i * 7919))
    rows = [(i, f"sau {'idiot moron scum' if i % 4 == 0 else 'ein haus'} {word(i)} {word(i + 500)} {word(i + 1000)} {word(i + 1500)}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model, _ = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert ("sau", None) in model.entries and ("sau", True) not in model.entries
    assert toxicity.findings("sau", model.entries)[1][3] == 0 and toxicity.findings("sau", ())[1][3] > 0

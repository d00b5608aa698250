import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stratamap.llm import ogg, tokenstore

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", " lead", "tail ", "x\n\ny", "a \nb", "don't 's it''s", " nb sp a  b", "e<|endoftext|>f <|endoftext|> g", "a\tb c", "数字 123 4.5... !! ?", "\n", "a\n", "a\r\nb", "x" * 3000, "é è\nÈ"]
ODD += ["a. b, c.\nd", "!!. x", "a!, b", "$ . x", "x., y", "a,. b c", ". a", ", a", "x \x01. y", "1, 2. 3", "a.\n\nb. ", "it's, don't. 's. x", "Ġ Ġ. x", "x́, y", "a.b. c d.\n", "b.. c"]


def crc_by_bits(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 4095, 4096, 4097, 70_000])
def test_ogg_round_trip(n):
    data = random.Random(n).randbytes(n)
    p = ogg.padded(data)
    assert len(p) % 64 == 0 and len(p) >= 64 and p[:n] == data and not any(p[n:])
    m = ogg.write(p)
    r = ogg.read(m)
    assert r["error"] is None and r["payload"] == p and r["times"][0] == 0 and r["streams"] == 2 and r["pages"] == m.count(b"OggS")
    assert ogg.page_crc(m[:200]) == crc_by_bits(m[:200])


def test_ogg_finds_damage():
    m = ogg.write(ogg.padded(b"payload OggS " * 9000))
    assert ogg.read(m)["error"] is None
    r = random.Random(3)
    for _ in range(60):
        k = r.randrange(len(m))
        assert ogg.read(m[:k] + bytes([m[k] ^ 1 << r.randrange(8)]) + m[k + 1 :])["error"]
        assert ogg.read(m[:k])["error"]
    assert ogg.read(None)["error"] == "no media" and ogg.read(b"")["error"]


def test_ogg_columns(spark):
    d = spark.createDataFrame([(1, bytearray(b"abc"), "k"), (2, None, "k"), (None, bytearray(b""), "k")], "doc_id long, payload binary, feature_ string")
    got = {r.doc_id: r for r in ogg.read_media(ogg.store_media(d, "payload", "media").drop("payload"), "media").collect()}
    assert got[1].payload_sha256 == hashlib.sha256(ogg.padded(b"abc")).hexdigest() and got[2].media_sha256 == got[None].media_sha256
    assert ogg.read_media(ogg.store_media(d.limit(0), "payload", "media"), "media").count() == 0


def test_word_encoder_equals_the_library():
    r = random.Random(2)
    words = [*ODD, "foo", "Bar.", "baz,", "q!", "(x)", "1.5", "a-b", "é", "."]
    texts = ODD + ["".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", ". ", ", ", ""]) for _ in range(r.randint(1, 40))) for _ in range(400)]
    tok, e = Tokenizer.from_file(PATH), tokenstore.WordEncoder(PATH)
    for batch in (texts[:100], texts[100:], texts[:50]):
        for t, got in zip(batch, e(batch), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_words_of_letters_by_merges_alone():
    tok, e = Tokenizer.from_file(PATH), tokenstore.WordEncoder(PATH)
    assert e.apart is not None
    signs = [chr(c) for c in range(0x20, 0x2A0)] + list("ßẞﬁ日\0\1\u0300'")
    r = random.Random(9)
    texts = [f"one {c} {c}{c} a{c}b\n{c}z x{c}. {c}, end" for c in signs]
    texts += [" ".join("".join(r.choice(signs) for _ in range(r.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    texts += ["x " + " ".join("".join(r.choice("etaoinéüø") for _ in range(r.randint(1, 12))) for _ in range(3 * tokenstore.PIECE)), "a\nb\nÀ\nc"]
    for t, got in zip(texts, e(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_chunks_and_checksums():
    ids = np.random.default_rng(1).integers(0, 50000, 30_000).astype(np.uint32)
    cut = lambda ids: tokenstore.cut_points(tokenstore.marks(ids), len(ids))
    cuts = cut(ids)
    assert cuts[-1] == len(ids) and all(b - a <= tokenstore.MOST for a, b in zip([0, *cuts], cuts, strict=False))
    moved = np.concatenate([ids[:100] + 1, ids[100:]])
    assert len(set(cuts) & set(cut(moved))) > 0.8 * len(cuts)
    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *cuts], cuts, strict=False)]
    two = parts + parts[:3]
    got = tokenstore.joined_crcs(np.array([zlib.crc32(p) for p in two], np.uint64), np.array([len(p) for p in two], np.int64), np.array([0, len(parts)]))
    assert got.tolist() == [zlib.crc32(b"".join(parts)), zlib.crc32(b"".join(parts[:3]))]


def test_store_round_trip(spark):
    r = random.Random(8)
    shared = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 99)) for _ in range(4000))
    texts = [*ODD, None, shared, f"prefix {shared}", shared]
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    store = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tokenstore.write_store(d, PATH, store)
    tok = Tokenizer.from_file(PATH)
    want = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows]
    a, b = tokenstore.read_store(spark, store).collect(), tokenstore.read_ids(spark, store).collect()
    assert sorted(((x.doc_id, x.n_tokens, x.ids_crc32) for x in a), key=str) == sorted(((i, len(v) // 4, zlib.crc32(v)) for i, v in want), key=str)
    assert sorted(((x.doc_id, bytes(x.ids)) for x in b), key=str) == sorted(want, key=str)
    at = 0
    for x in sorted(a, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    assert [x.doc_id or -1 for x in sorted(a, key=lambda x: x.start)] == sorted(x.doc_id or -1 for x in a)
    chunks, recipes = spark.read.parquet(f"{store}/chunks"), spark.read.parquet(f"{store}/recipes")
    refs = recipes.selectExpr("explode(hashes) as hash")
    assert chunks.filter("kind = 'chunk'").count() == refs.distinct().count() < refs.count()
    tokenstore.write_store(d.limit(0), PATH, store + "e")
    assert tokenstore.read_store(spark, store + "e").count() == 0


def rewritten(spark, path, change):
    rows = change([r.asDict() for r in spark.read.parquet(path).orderBy("ordinal").collect()])
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.parquet(path + "x")
    tokenstore.remove(spark, path)
    spark.read.parquet(path + "x").write.parquet(path)


@pytest.mark.parametrize("damage", ["missing", "doubled", "exchanged", "renamed", "none"])
def test_manifest_notices_changed_recipes(spark, damage, monkeypatch):
    monkeypatch.setattr(tokenstore, "FAN", 3)
    store = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    d = spark.createDataFrame([(i, f"text number {i}, of some length") for i in range(20)], "doc_id long, text string")
    tokenstore.write_store(d, PATH, store)
    assert spark.read.parquet(f"{store}/manifest").groupBy("level").count().orderBy("level").collect() == [(1, 7), (2, 3), (3, 1)]

    def change(rows):
        if damage == "missing":
            return rows[:-1]
        if damage == "doubled":
            return [*rows, rows[3]]
        if damage == "exchanged":
            a, b = rows[4], rows[5]
            a["hashes"], b["hashes"], a["root"], b["root"] = b["hashes"], a["hashes"], b["root"], a["root"]
        if damage == "renamed":
            rows[7]["doc_id"] = 700
        return rows

    rewritten(spark, f"{store}/recipes", change)
    if damage == "none":
        assert tokenstore.read_store(spark, store).count() == 20
    else:
        for reader in (tokenstore.read_store, tokenstore.read_ids):
            with pytest.raises(ValueError, match="manifest"):
                reader(spark, store)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert tokenstore.by_words(PATH) and not tokenstore.by_words(path)
    tok, e = Tokenizer.from_file(path), tokenstore.WordEncoder(path)
    texts = ["Hello, World. twice", "a  b\nC", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(tokenstore, "CACHE", 50)
    tok, e, r = Tokenizer.from_file(PATH), tokenstore.WordEncoder(PATH), random.Random(5)
    for _ in range(30):
        texts = [" ".join(r.choice(["often", "seldom, ", "word."]) + str(r.randint(0, 30)) for _ in range(60)) for _ in range(4)]
        for t, got in zip(texts, e(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(e.number) < 200


def test_ogg_times_come_from_granule_positions():
    data = random.Random(1).randbytes(100_032)
    m = ogg.write(data)
    plain = ogg.read(m)["times"]
    assert plain == pytest.approx([i * ogg.PACKET / ogg.RATE for i in range(len(plain))])

    def moved(by, at_least):
        out, at = [], 0
        while at < len(m):
            magic, version, flags, granule, serial, number, _, n = ogg.HEADER.unpack_from(m, at)
            lacing = m[at + 27 : at + 27 + n]
            body = m[at + 27 + n : at + 27 + n + sum(lacing)]
            out.append(ogg._page(serial, number, granule + by if serial == ogg.DATA_SERIAL and granule > at_least else granule, flags, lacing, body))
            at += 27 + n + len(body)
        return b"".join(out)

    # A stream that begins late, and one with a hole before its last pages.
    late = ogg.read(moved(80_000, 0))
    assert late["error"] is None and late["payload"] == data and late["times"] == pytest.approx([t + 10 for t in plain]) and late["gap_samples"] == 0
    hole = ogg.read(moved(16_000, 70_000))
    assert hole["payload"] == data and hole["gap_samples"] == 16_000 and hole["times"][0] == 0 and hole["times"][-1] > plain[-1] + 1


def test_ogg_reader_finds_the_next_page_behind_damage():
    data = random.Random(2).randbytes(200_000)
    p = ogg.padded(data)
    m = ogg.write(p)
    k = m.index(b"OggS", 60_000) + 500
    r = ogg.read(m[:k] + bytes([m[k] ^ 1]) + m[k + 1 :])
    assert "checksum" in r["error"] and 0 < len(p) - len(r["payload"]) <= 2 * ogg.PACKET * ogg.PAGE_PACKETS
    assert r["payload"][:40_000] == p[:40_000] and r["payload"][-40_000:] == p[-40_000:]


BIG = 2**60


def test_long_ids_next_to_nulls(spark):
    ids = [BIG + 1, None, BIG + 3, 2**63 - 1]
    d = spark.createDataFrame([(i, f"some words of text number {k} here", "f", "e") for k, i in enumerate(ids)], "doc_id long, text string, feature string, error string").coalesce(1)
    store = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    tokenstore.write_store(d, PATH, store)
    assert {r.doc_id for r in tokenstore.read_store(spark, store).collect()} == {r.doc_id for r in tokenstore.read_ids(spark, store).collect()} == set(ids)
    got = ogg.read_media(ogg.store_media(d.selectExpr("*", "binary(text) as payload"), "payload", "media"), "media").collect()
    assert {r.doc_id for r in got} == set(ids) and got[0].feature == "f" and got[0].error_ is None and "n_samples" in got[0].feature_

"""Token ids in a content-addressed store.

A store is a folder of three tables. ``chunks/kind=chunk`` has each distinct chunk once (hash, n, width, payload: its ids
as little-endian integers of width bytes); ``recipes`` has, in ascending doc_id order, each document's chunk hashes, its
ordinal, its first token's place in the corpus and the Merkle root over its chunks; ``manifest`` has the levels of a tree
over the recipes in their order: a node's hash is over up to ``FAN`` nodes of the level below (at the lowest, over a
recipe's id, ordinal, place, length and root), and the highest level is one node, the root of the store.
(``chunks/kind=doc`` holds the documents as they were cut; it is only read to write the recipes.)

Chunks end where a rolling hash of the last ``WINDOW`` ids has ``MASK`` bits zero, so that they depend on content only and
texts with shared passages share chunks. A task sends a chunk's payload once, so that one that very many documents share
doesn't gather in one task.

Reading verifies: each payload is hashed again, each recipe's root is computed anew from the verified chunks, the
manifest's root from the recipes, and any difference (a recipe that is missing, doubled, moved or exchanged too) stops it.

Nulls: a null text is encoded as the empty text (the end id alone); rows with null or repeated doc_ids are documents like
others, nulls first. Very long texts have many chunks. An empty table gives an empty store and no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, remove, shared_dir, sorted_starts, table

WINDOW, MASK, LEAST, MOST = 16, 0xFF, 64, 2048
END_ID = 2
#: Distinct words whose ids a Python worker keeps, chunk hashes that it knows to be sent, and texts whose chunks it keeps.
CACHE, SENT, KNOWN = 600_000, 200_000, 40_000
#: New words that are encoded as one text, and bytes of texts that are encoded at once.
TOGETHER, AT_ONCE = 5_000, 8 << 20
#: Nodes below a node of the manifest.
FAN = 1024
ODD = np.uint32(0x9E3779B1)


def by_words(path: str) -> bool:
    """Whether the tokenizer file's own pre-tokens allow words to be encoded apart: the byte-level pattern on texts as they
    are, pairs merged without chance, and no added token that takes white space with it."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    level = d.get("pre_tokenizer") or {}
    plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space", True)
    tokens = d.get("added_tokens") or []
    tame = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not any(c.isspace() for c in t["content"]) for t in tokens)
    fixed = d["model"].get("type") == "BPE" and not d["model"].get("dropout") and not d["model"].get("continuing_subword_prefix") and not d["model"].get("end_of_word_suffix")
    return bool(plain and tame and fixed and not d.get("normalizer") and not d.get("truncation") and not d.get("padding"))


def separator(path: str) -> int | None:
    """The token of a byte that no merge of the tokenizer file takes part in and that UTF-8 never holds (0xC0), if it has one."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    sign = BYTES[0xC0]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or [])
    return None if model.get("ignore_merges") or any(sign in a or sign in b for a, b in pairs) else model["vocab"].get(sign)


def byte_signs() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable in Latin-1, else the
    next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


BYTES = byte_signs()
#: Code points of these as a table by byte; byte 0 (in no word of letters) stands for the separator.
POINTS = np.array([ord(BYTES[b or 0xC0]) for b in range(256)], "<u4")
#: Words that the tokenizer's pattern leaves whole whatever its Unicode version is: Latin letters alone.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+$"
#: Words of letters that go through the model as one string.
PIECE = 256
BAD, SOLID, SIGN = 1, 2, 4


class WordEncoder:
    """Encodes whole texts by the tokenizers library, word by word with a bounded cache.

    A byte-level tokenizer's own pre-tokens never reach over a single blank or newline between two other characters
    (except the blank that leads a word), nor from a letter or digit into a full stop or comma before a blank. So a text
    without runs of white space is the sum of such pieces; any other text is encoded as a whole, and so is every
    text where by_words() finds another kind of tokenizer. New pieces are encoded together, as one text: each begins
    with the only token in it that begins with a blank or is a newline. Where words are letters alone, the pattern has
    nothing to find in them; these go straight through the library's merges, apart by a byte that never merges.

    Words are numbered; ``pool`` holds the ids of all words one after the other, word i's from begin[i], size[i] of them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), by_words(path)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "\u0120\u010a"]] = True
        self.apart = separator(path) if self.words else None
        if self.apart is not None:
            from tokenizers import pre_tokenizers

            self.merges = Tokenizer.from_file(path)
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([])
            self.merges.model._resize_cache(0)  # no word comes twice
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.end = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.size, self.uses = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        #: Of a word, as bits: it may not stand in a text that is cut; a sign behind it is a piece of its own; it is such a sign.
        self.flags = np.zeros(1 << 16, np.uint8)
        for mark, ids in zip(("\1.", "\1,"), self._encode([".", ","]), strict=True):
            self._add([mark], ids, np.array([len(ids)]))
            self.flags[self.number[mark]] = SIGN

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _room(self, ids: int, words: int) -> None:
        if (need := self.end + ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.end], np.zeros(need, np.uint32)])
        if (need := len(self.number) + words) > len(self.begin):
            more = need
            self.begin, self.size, self.uses, self.flags = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.begin, self.size, self.uses, self.flags))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, flag: int | None = None) -> None:
        self._room(len(ids), len(words))
        n = len(self.number)
        self.pool[self.end : self.end + len(ids)] = ids
        self.begin[n : n + len(words)] = self.end + np.cumsum(sizes) - sizes
        self.size[n : n + len(words)] = sizes
        self.flags[n : n + len(words)] = [SOLID if w[-1:].isalnum() else 0 for w in words] if flag is None else flag
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.end += len(ids)

    def _learn_letters(self, lead: str, words: list[str]) -> list[str]:
        """Learns those of the words (after lead) that are letters alone, and returns the others."""
        bodies = [w[1:] for w in words] if lead == "\n" else words
        easy = pc.match_substring_regex(pa.array(bodies, pa.large_string()), LETTERS).to_pylist()
        some, bodies = [w for w, e in zip(words, easy, strict=True) if e], [b for b, e in zip(bodies, easy, strict=True) if e]
        if not some:
            return words
        # A newline is a pre-token of its own, a blank belongs to its word's.
        lead = "\n\0" if lead == "\n" else lead
        runs = [lead + f"\0{lead}".join(bodies[i : i + PIECE]) for i in range(0, len(bodies), PIECE)]
        runs = [POINTS[np.frombuffer(r.encode(), np.uint8)].tobytes().decode("utf-32-le") for r in runs]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(runs, add_special_tokens=False)])
        ids = ids[ids != self.apart]
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(some):
            return words
        self._add(some, ids, np.diff(np.append(at, len(ids))), SOLID)
        return [w for w, e in zip(words, easy, strict=True) if not e]

    def _learn(self, words: list[str]) -> None:
        lines, plain = [w for w in words if w[:1] == "\n"], [w for w in words if w[:1] != "\n"]
        if self.apart is not None:
            lines, plain = self._learn_letters("\n", lines), self._learn_letters(" ", plain)
        for lead, some in (("", lines), (" ", plain)):
            # Where no white space is in any word (or empty word), all of them can be cut out of a text.
            if len("".join(some).split() if lead == "" else " ".join(some).split()) != len(some):
                bodies = [w if lead else w[1:] for w in some]
                bad = [w for w, x in zip(some, bodies, strict=True) if not x or x != x.strip()]
                some = [w for w, x in zip(some, bodies, strict=True) if x and x == x.strip()]
                for w in bad:
                    self._add([w], np.zeros(0, np.uint32), np.zeros(1, np.int64))
                    self.flags[self.number[w]] |= BAD
            parts = [some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)]
            while parts:
                part = parts.pop()
                ids = self._encode([lead + lead.join(part)])[0]
                at = np.flatnonzero(self.begins[ids])
                if len(at) == len(part):
                    self._add(part, ids, np.diff(np.append(at, len(ids))))
                elif len(part) > 64:
                    parts += [part[: len(part) // 2], part[len(part) // 2 :]]
                else:
                    found = self._encode([lead + w for w in part])
                    self._add(part, np.concatenate(found), np.array(list(map(len, found))))

    def _forget(self) -> None:
        """Keeps the words that came up in two batches or more since the last time, at most half of what may be kept."""
        n = len(self.number)
        least = max(2, int(np.sort(self.uses[:n])[-min(n, CACHE // 2)]) + 1)
        words = [w for w, i in self.number.items() if self.uses[i] >= least and w[0:1] != "\1" and not self.flags[i] & BAD]
        at = np.array([self.number[w] for w in words], np.int64)
        sizes = self.size[at].astype(np.int64)
        ids = self._gather(self.begin[at], sizes)
        self._clear()
        self._add(words, ids, sizes)

    def _gather(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        ids, counts = self.flat(texts)
        ends = np.cumsum(counts).tolist()
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Calls are for a few megabytes at a time."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.words:
            found = self._encode(texts)
            return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array(list(map(len, found)), np.int64)
        if len(self.number) > CACHE:
            self._forget()
        marked = pa.array(texts, pa.large_string())
        for sign, to in (("\n", " \n"), (". ", " \1. "), (", ", " \1, ")):
            marked = pc.replace_substring(marked, sign, to)
        split = pc.split_pattern(marked, " ")
        first = split.offsets.to_numpy()[:-1].astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [distinct[i] for i in index[first].tolist()]
        get = self.number.get
        numbers = [get(w, -1) for w in distinct]
        if -1 in numbers:
            # Heads that occur as nothing else are learned too; that a word is asked for in vain does no harm.
            self._learn([w for w, i in zip(distinct, numbers, strict=True) if i < 0])
            numbers = [self.number[w] for w in distinct]
        numbers = np.array(numbers, np.int64)
        self.uses[numbers] += 1
        word = numbers[index]
        flags = self.flags[word]
        bad = (flags & BAD) > 0
        bad[first] = [not h or h != h.strip() for h in heads]
        # A full stop or comma behind another sign would belong to that sign's pre-token.
        bad[1:] |= (flags[1:] & SIGN > 0) & (flags[:-1] & SOLID == 0)
        alone = np.logical_or.reduceat(bad, first) | np.array(["\1" in t for t in texts])
        led = self._encode([t if a else h for t, h, a in zip(texts, heads, alone.tolist(), strict=True)])
        counts = np.array(list(map(len, led)), np.int64)
        ids = np.concatenate(led)
        self._room(len(ids), 0)
        self.pool[self.end : self.end + len(ids)] = ids  # not kept
        begin, size = self.begin[word], self.size[word].astype(np.int64)
        size[np.repeat(alone, np.diff(np.append(first, len(word))))] = 0
        begin[first], size[first] = self.end + np.cumsum(counts) - counts, counts
        return self._gather(begin, size), np.add.reduceat(size, first)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of id runs whose rolling hash over the last WINDOW ids asks for a cut. Within the first LEAST ids of a document no
    cut is taken, so that documents may follow each other here: further on a window holds ids of its own document only."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * ODD
    h ^= h >> np.uint32(15)
    m, more = 1, np.empty_like(h)
    while m < WINDOW and len(h) > m:
        np.multiply(h[:-m], ODD + np.uint32(2 * m), out=more[m:])
        h[m:] += more[m:]
        m *= 2
    return np.flatnonzero((h >> np.uint32(16)) & np.uint32(MASK) == 0) + 1


def cut_points(found: np.ndarray, n: int) -> list[int]:
    """Ends of a document's chunks, LEAST to MOST ids each (the last one may be shorter), from its marks and length."""
    out, at = [], 0
    for m in [*found[(found >= LEAST) & (found < n)].tolist(), n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or (m == n and m > at):
            out.append(at := m)
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """Root over chunks' hashes (which are over a width of 2 or 4 and the ids): pairs are hashed with a mark of their own for
    inner nodes; an odd one moves up."""
    level, sha = hashes or [hashlib.sha256(b"").digest()], hashlib.sha256
    while len(level) > 1:
        up = [sha(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = [*up, level[-1]] if len(level) % 2 else up
    return level[0]


def unpack(payload: bytes, width: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}")


POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), bits in the order of CRC-32, modulo its polynomial."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64).copy(), np.zeros(len(b), np.uint64)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(k) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ np.uint64(POLY), b >> np.uint64(1))
    return out


def joined_crcs(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of rows of byte strings, from each string's CRC-32 and length; first: where each row begins (none is empty).
    A string's CRC counts times x to the power of the bits behind it in its row."""
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(crcs))))
    through = np.cumsum(sizes)
    ends = np.append(through[first[1:] - 1], through[-1:])
    after = ends[row] - through
    power = np.full(len(crcs), 1 << 31, np.uint64)  # x to the power 0
    square = np.array([1 << 30], np.uint64)  # x
    for _ in range(3):
        square = _times(square, square)  # x to the power 8: a byte
    for k in range(int(after.max(initial=0)).bit_length()):
        power = np.where(after >> k & 1, _times(np.repeat(square, len(power)), power), power)
        square = _times(square, square)
    return np.bitwise_xor.reduceat(_times(power, crcs), first)


STORED = "doc_id long, uid long, hashes array<binary>, n_tokens long, hash binary, n int, width int, payload binary"


def _chunk_table(spark: SparkSession, store: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{STORED}, kind string").parquet(f"{store}/chunks").filter(F.col("kind") == kind)


def chunks(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """From (doc_id, uid, text), by the tokenizer file at path: a row per document (kind doc: hashes of its chunks, n_tokens)
    and rows for the chunks (kind chunk: hash, n, width, payload), each of them once or more."""

    sent, known = set(), {}  # of a task: each gets its own with the function

    def work(texts):
        encode = encoder(path)
        width = 2 if max(len(encode.begins), end_id + 1) <= 1 << 16 else 4

        def rows(own: list[int], held: list[str], copies: list[tuple[int, int | tuple]]):
            flat, counts = encode.flat(held)
            done = []
            ends = np.cumsum(counts + 1)
            every, inner = np.full(int(counts.sum()) + len(counts), end_id, np.uint32), np.ones(int(counts.sum()) + len(counts), bool)
            inner[ends - 1] = False
            every[inner] = flat
            packed, found = every.astype(f"<u{width}").tobytes(), marks(every)
            cuts = np.searchsorted(found, ends - counts - 1, side="right"), np.searchsorted(found, ends, side="right")
            row, kind, hashes, total, digest_of, size_of, payload = [], [], [], [], [], [], []
            begin = 0
            for i, (n, a, b) in enumerate(zip((counts + 1).tolist(), cuts[0].tolist(), cuts[1].tolist(), strict=True)):
                mine, from_ = [], begin
                for to in cut_points(found[a:b] - begin, n):
                    part = packed[from_ * width : (begin + to) * width]
                    digest = hashlib.sha256(bytes([width]) + part).digest()
                    mine.append(digest)
                    if digest not in sent:
                        if len(sent) < SENT:
                            sent.add(digest)
                        row.append(own[i])
                        kind.append("chunk")
                        hashes.append(None)
                        total.append(None)
                        digest_of.append(digest)
                        size_of.append(begin + to - from_)
                        payload.append(part)
                    from_ = begin + to
                done.append((mine, n))
                begin += n
            # Documents, then those whose text was met before: in this run (by its place there) or in an earlier one.
            texts_of = [*zip(own, done, strict=True), *((i, done[x] if isinstance(x, int) else x) for i, x in copies)]
            row += [i for i, _ in texts_of]
            kind += ["doc"] * len(texts_of)
            hashes += [x[0] for _, x in texts_of]
            total += [x[1] for _, x in texts_of]
            for c in (digest_of, size_of, payload):
                c += [None] * len(texts_of)
            for d, x in zip(place, done, strict=True):
                if len(known) < KNOWN and len(x[0]) <= 64:
                    known[d] = x
            place.clear()
            return row, [kind, hashes, total, digest_of, size_of, [width] * len(row), payload]

        own, held, copies, size, place = [], [], [], 0, {}
        for i, t in enumerate(texts):
            t = t.as_py() or ""
            digest = xxhash.xxh3_128_digest(t.encode())
            if digest in known:
                copies.append((i, known[digest]))
            elif digest in place:
                copies.append((i, place[digest]))
            else:
                place[digest] = len(held)
                own.append(i)
                held.append(t)
                size += len(t)
            if size > AT_ONCE:
                yield rows(own, held, copies)
                own, held, copies, size = [], [], [], 0
        if held or copies:
            yield rows(own, held, copies)

    return arrow_map(docs, ["doc_id", "uid"], ["text"], work, "kind string, hashes array<binary>, n_tokens long, hash binary, n int, width int, payload binary")


def write_store(docs: DataFrame, path: str, store: str, end_id: int = END_ID) -> None:
    """Writes the store of (doc_id, text), encoded by the tokenizer file at path."""
    spark = docs.sparkSession
    c = chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text"), path, end_id)
    doc = F.col("kind") == "doc"
    # A document goes by its own number, a chunk by its hash, of which one stays.
    route = F.when(doc, F.xxhash64("uid")).otherwise(F.xxhash64("hash"))
    one = F.row_number().over(Window.partitionBy("route", "hash").orderBy("uid")) == 1
    c = c.withColumn("route", route).withColumn("first", one).filter(doc | F.col("first")).drop("route", "first")
    c.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").partitionBy("kind").parquet(f"{store}/chunks")
    docs_ = _chunk_table(spark, store, "doc").select("doc_id", "uid", "hashes", "n_tokens", F.lit(1).alias("one"))
    placed = sorted_starts(docs_, ["doc_id", "uid"], {"start": "n_tokens", "ordinal": "one"}).drop("one")
    recipes = arrow_map(placed, ["doc_id", "uid", "ordinal", "start", "n_tokens", "hashes"], ["hashes"], lambda hs: iter([(None, [[merkle(h) for h in hs.to_pylist()]])]), "root binary")
    recipes.write.parquet(f"{store}/recipes")
    _levels(spark.read.parquet(f"{store}/recipes"), f"{store}/manifest")


NODE = "number long, docs long, tokens long, hash string"


def _levels(recipes: DataFrame, path: str):
    """Writes the levels of the tree over recipes, and returns the highest one's node (null for no recipes)."""
    spark = recipes.sparkSession
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "ordinal", "start", "n_tokens", F.hex("root"))
    nodes, level = recipes.select(F.col("ordinal").alias("number"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.sha2(text, 256).alias("hash")), 0
    while True:
        level += 1
        below = F.array_sort(F.collect_list(F.struct("number", "hash")))
        up = nodes.withColumn("up", F.floor(F.col("number") / FAN)).groupBy("up").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), below.alias("below"))
        up = up.select(F.col("up").cast("long").alias("number"), "docs", "tokens", F.sha2(F.array_join(F.transform("below", lambda x: x["hash"]), "|"), 256).alias("hash"))
        up.write.parquet(f"{path}/level={level}")
        nodes = spark.read.schema(NODE).parquet(f"{path}/level={level}")
        few = nodes.take(2)  # one node is left at the top
        if len(few) < 2:
            return few[0] if few else None


def check_manifest(spark: SparkSession, store: str) -> None:
    """ValueError if the recipes are not those that the manifest was made of."""
    again = f"{store}/check-{uuid.uuid4().hex}"
    found = _levels(spark.read.parquet(f"{store}/recipes"), again)
    remove(spark, again)
    levels = spark.read.schema(f"{NODE}, level int").parquet(f"{store}/manifest")
    top = levels.agg(F.max("level")).first()[0]
    said = levels.filter(F.col("level") == top).drop("level").take(2) if top else []
    if said != ([found] if found else []):
        raise ValueError("the recipes do not match the manifest")


def verified_chunks(spark: SparkSession, store: str) -> DataFrame:
    """hash, n, crc (of the ids as 32-bit integers) of every chunk, whose payload is hashed again."""

    def work(hashes, widths, payloads):
        if not len(hashes):
            return
        all_widths, sizes, crcs = widths.to_numpy(), pc.binary_length(payloads).to_numpy(), []
        if (all_widths == all_widths[0]).all():
            joined = b"".join(payloads.to_pylist())
            w, at = int(all_widths[0]), 0
            wide = memoryview(unpack(joined, w).astype("<u4")).cast("B")
            view, mark = memoryview(joined), hashlib.sha256(bytes([w]))
            for h, n in zip(hashes.to_pylist(), sizes.tolist(), strict=True):
                d = mark.copy()
                d.update(view[at : at + n])
                if d.digest() != h:
                    raise ValueError(f"damaged chunk {h.hex()}")
                crcs.append(zlib.crc32(wide[at // w * 4 : (at + n) // w * 4]))
                at += n
        else:
            for h, w, p in zip(hashes.to_pylist(), all_widths.tolist(), payloads.to_pylist(), strict=True):
                if hashlib.sha256(bytes([w]) + p).digest() != h:
                    raise ValueError(f"damaged chunk {h.hex()}")
                crcs.append(zlib.crc32(unpack(p, w).astype("<u4")))
        yield None, [sizes // all_widths, crcs]

    return arrow_map(_chunk_table(spark, store, "chunk"), ["hash"], ["hash", "width", "payload"], work, "n int, crc long")


def _rebuilt(recipes: DataFrame, parts: DataFrame, fields: list[str]) -> DataFrame:
    """Recipes with their chunks' fields as arrays in order, from (uid, number, fields)."""
    got = parts.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("number", *fields))).alias("parts"))
    return recipes.join(got, "uid", "left").select("doc_id", "start", "n_tokens", "root", *[F.col(f"parts.{f}").alias(f"part_{f}") for f in fields])


def _check_recipe(hs: list[bytes] | None, n: int, total: int, root: bytes) -> None:
    if hs is None or n != total or merkle(hs) != root:
        raise ValueError("a recipe does not match its chunks")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from chunks and recipes that are verified on the way."""
    check_manifest(spark, store)
    recipes = spark.read.parquet(f"{store}/recipes")
    refs = recipes.select("uid", F.posexplode("hashes").alias("number", "hash"))
    both = _rebuilt(recipes, refs.join(verified_chunks(spark, store), "hash"), ["hash", "n", "crc"])

    def work(hashes, n, crc, total, root):
        if not len(hashes):
            return
        sizes = n.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        hs = hashes.to_pylist()
        counts = np.array([len(h or []) for h in hs], np.int64)
        first = np.cumsum(counts) - counts
        whole = np.add.reduceat(sizes, first) if counts.all() else np.full(len(counts), -1)
        for h, x, t, r in zip(hs, whole.tolist(), total.to_pylist(), root.to_pylist(), strict=True):
            _check_recipe(h, x, t, r)
        crcs = joined_crcs(crc.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), sizes * 4, first)
        yield None, [crcs.astype(np.int64)]

    return arrow_map(both, ["doc_id", "start", "n_tokens"], ["part_hash", "part_n", "part_crc", "n_tokens", "root"], work, "ids_crc32 long")


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start and ids (little-endian 32-bit integers as bytes) of every document, verified in the same way."""
    check_manifest(spark, store)
    recipes = spark.read.parquet(f"{store}/recipes")
    refs = recipes.select("uid", F.posexplode("hashes").alias("number", "hash"))
    both = _rebuilt(recipes, refs.join(_chunk_table(spark, store, "chunk").select("hash", "width", "payload"), "hash"), ["hash", "width", "payload"])

    def work(hashes, widths, payloads, total, root):
        out = []
        for hs, ws, ps, t, r in zip(*(c.to_pylist() for c in (hashes, widths, payloads, total, root)), strict=True):
            for h, w, p in zip(hs or [], ws or [], ps or [], strict=True):
                if hashlib.sha256(bytes([w]) + p).digest() != h:
                    raise ValueError(f"damaged chunk {h.hex()}")
            _check_recipe(hs, sum(len(p) // w for w, p in zip(ws or [], ps or [], strict=True)), t, r)
            out.append(b"".join(unpack(p, w).astype("<u4").tobytes() for w, p in zip(ws, ps, strict=True)))
        yield None, [out]

    return arrow_map(both, ["doc_id", "start"], ["part_hash", "part_width", "part_payload", "n_tokens", "root"], work, "ids binary")


def op8_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents encoded, stored and read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    store = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, store)
    return read_store(spark, store)

"""Exact removal of repeated byte strings by column-wise construction over many documents.

Every string of ``LENGTH`` bytes that starts at two places or more is removed at each of them, by three steps.

1. Each window of LENGTH bytes has an anchor: its leftmost ``GRAM``-byte gram of smallest hash. Equal windows have equal
   anchors at the same distance. Neighbouring windows with one anchor make a segment (about 600 bytes), so that equal
   windows meet among the segments of one anchor, aligned at it. Anchors that occur once are dropped.
2. Equal segments are counted by a partial aggregation; what occurs twice is repeated as a whole. Only one of each
   distinct segment goes on, and only where an anchor has several.
3. The segments of an anchor are the documents of a column-wise construction: each round inserts the next symbol of every
   segment at once, which updates the collection's order (its segments sorted by what precedes the column, read
   backwards: the positional form of the Burrows-Wheeler transform) and the common prefixes of neighbours in it. A
   segment whose common prefix with a neighbour reaches LENGTH at a column has a repeated window there.

Rounds are at most 2 * LENGTH, not the longest document's length, and a batch of anchors holds at most ``BATCH`` bytes, so
the columns of a batch are read from memory one after the other. External files of a column's order and prefixes would take
2 * LENGTH rounds of 16 bytes for every segment, about ten times the text (the README has figures). An anchor with more
than ``hot`` distinct segments does not become a group: its windows' hashes are counted instead, over all tasks.

Texts go by their 128-bit hash: what copies of a text repeat is found once and holds for each of them. Nulls: a null text is
empty; a text under LENGTH bytes loses nothing; very long texts are scanned in pieces. Ids take no part, so that null, repeated
and very large ones come back as they are. An empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remove, stored, table

LENGTH, GRAM = 400, 32
#: Bytes that are scanned at once; a longer document is scanned in pieces that overlap by a window.
SCAN, PIECE = 1 << 18, 1 << 19
POSITION = np.uint64((1 << 20) - 1)
BATCH, HOT = 8 << 20, 20_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SEGMENT = "start long, span long, times long, windows int, left int, anchor long, content binary"


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram that starts at each byte (gram: a power of two), built by doubling."""
    h, m, k = (b.astype(np.uint64) + np.uint64(1)) * ODD[0], 1, 1
    while m < gram:
        h = h[:-m] * ODD[k % 6] + h[m:]
        h ^= h >> np.uint64(31)
        m, k = 2 * m, k + 1
    h *= ODD[5]
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks of w from either side."""
    n = len(x)
    y = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple]:
    """(piece, start, span, times, windows, left, anchor, content) of the pieces' segments. Neighbours with the same
    content (text of a short period) become one row with how many times it stands there."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = b"".join(pieces)
    if sizes.max(initial=0) < length:
        return []
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    h = _gram_hashes(np.frombuffer(data, np.uint8), gram)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(data), dtype=np.int64) - firsts[owner]
    low = _sliding_min((h & ~POSITION) | inside[: len(h)].astype(np.uint64), length - gram + 1)
    n = len(low)
    starts = np.flatnonzero(inside[:n] + length <= sizes[owner[:n]])
    anchor = firsts[owner[starts]] + (low[starts] & POSITION).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(starts)))
    begin, where = starts[at], anchor[at]
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    content = [digest(view[a:b]) for a, b in zip(begin.tolist(), (begin + run - 1 + length).tolist(), strict=True)]
    rows, before = [], None
    for p, s, w, left, a, c in zip(owner[begin].tolist(), inside[begin].tolist(), run.tolist(), (where - begin).tolist(), h[where].view(np.int64).tolist(), content, strict=True):
        if before and before[7] == c and before[0] == p and before[1] + before[2] == s:
            before[2] += w
            before[3] += 1
        else:
            rows.append(before := [p, s, w, 1, w, left, a, c])
    return rows


def scan(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The segments of (th, data)."""

    def found(held: list[tuple]) -> tuple[list[int], list]:
        rows = segments([x[1] for x in held], length, gram)
        out = [(held[r[0]][0], r[1] + held[r[0]][2], *r[2:]) for r in rows]
        return [x[0] for x in out], [list(c) for c in zip(*out, strict=True)][1:] if out else [[] for _ in SEGMENT.split(", ")]

    def work(texts):
        held, size = [], 0
        for i, data in enumerate(texts):
            data = data.as_py()
            for at in range(0, len(data) - length + 1, PIECE):
                piece = data[at : at + PIECE + length - 1]
                held.append((i, piece, at))
                size += len(piece)
                if size > SCAN:
                    yield found(held)
                    held, size = [], 0
        if held:
            yield found(held)

    return arrow_map(docs, ["th"], ["data"], work, SEGMENT)


def repeated_columns(group: np.ndarray, left: np.ndarray, data: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (its group, its anchor's place in it, its bytes), the windows that another of its group has at
    the same column, as places in the segment. Segments are different from each other."""
    n = len(data)
    sizes = np.array([len(x) for x in data], np.int64)
    start = -left.astype(np.int64)
    low, high = int(start.min()), int((start + sizes).max())
    flat, first = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes
    base = first - start
    order = np.argsort(group, kind="stable")
    # Common prefixes begin at column diverge[i] for the rows at i - 1 and i of the order; the last is a sentinel.
    diverge = np.full(n + 1, low, np.int64)
    g = group[order]
    diverge[0] = high + 1
    diverge[1:n][g[1:] != g[:-1]] = high + 1
    rows, columns = [], []
    for k in range(low, high):
        there = (k >= start[order]) & (k < start[order] + sizes[order])
        symbol = np.full(n, 256, np.int64)
        symbol[there] = flat[base[order[there]] + k]
        key = group[order] * 257 + symbol
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        same = np.zeros(n, bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (symbol[by[1:]] < 256)
        next_diverge = np.full(n + 1, k + 1, np.int64)
        hit = np.flatnonzero(same)
        if len(hit):
            a, b = by[hit - 1] + 1, by[hit] + 1
            in_order = np.argsort(a, kind="stable")
            spans = np.empty(2 * len(hit), np.int64)
            spans[0::2], spans[1::2] = a[in_order], b[in_order]
            next_diverge[hit[in_order]] = np.maximum.reduceat(diverge, spans)[0::2]
        order, diverge = order[by], next_diverge
        longest = k + 1 - np.minimum(diverge[:n], diverge[1:])
        full = np.flatnonzero(longest >= length)
        if len(full):
            rows.append(order[full])
            columns.append(np.full(len(full), k + 1 - length))
    if not rows:
        return [np.zeros(0, np.int64)] * n
    r, c = np.concatenate(rows), np.concatenate(columns)
    c = c - start[r]
    by = np.lexsort((c, r))
    r, c = r[by], c[by]
    return np.split(c, np.searchsorted(r, np.arange(1, n)))


def runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Neighbouring numbers as [from, to) pairs."""
    if not len(places):
        return [], []
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + 1).tolist()


RANGES = "anchor long, content binary, low array<int>, high array<int>"
RANGE_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def compare(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Repeated windows of (anchor, content, left, bytes), which come sorted by anchor, in batches of whole anchors."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        codes = np.unique(np.array([x[0] for x in held]), return_inverse=True)[1]
        found = repeated_columns(codes, np.array([x[2] for x in held]), [x[3] for x in held], length)
        rows = [(x[0], x[1], *runs(f)) for x, f in zip(held, found, strict=True) if len(f)]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, RANGE_TYPES, strict=True)], names=["anchor", "content", "low", "high"])

    held, size, mine = [], 0, set()
    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("anchor", "content", "left", "bytes")), strict=True):
            if not held or row[0] != held[-1][0]:
                mine = set()
                if size > BATCH:
                    yield done(held)
                    held, size = [], 0
            # The same segment comes again from rows with equal texts and ids.
            if row[1] not in mine:
                mine.add(row[1])
                held.append(row)
                size += len(row[3])
    if held:
        yield done(held)


def compare_hot(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """As compare(), for anchors with very many segments: counts their windows by column and hash."""

    def work(lefts, contents):
        for i, (left, data) in enumerate(zip(lefts.to_pylist(), contents, strict=True)):
            data = data.as_py()
            n = len(data) - length + 1
            yield [i] * n, [list(range(n)), [k - left for k in range(n)], [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)]]

    w = arrow_map(rows.dropDuplicates(["anchor", "content"]), ["anchor", "content"], ["left", "bytes"], work, "w int, col int, wh binary")
    often = w.groupBy("anchor", "col", "wh").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    hit = w.join(often, ["anchor", "col", "wh"], "left_semi").groupBy("anchor", "content").agg(F.array_sort(F.collect_list("w")).alias("low"))
    return hit.select("anchor", "content", "low", F.transform("low", lambda x: x + 1).alias("high"))


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """Of (id, th, data), where th is a hash of data and id one of the row's id, a row per th of a text that repeats something: th,
    spans (byte ranges, unmerged)."""
    spark, hot = docs.sparkSession, HOT if hot is None else hot
    every, path = stored(scan(docs, length, gram), "segments")
    twice = every.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    some, _ = stored(every.join(twice, "anchor", "left_semi"), "segments")
    remove(spark, path)
    content = some.groupBy("anchor", "content").agg(F.sum("times").alias("n"), F.min(F.struct("th", "start", "left", "windows")).alias("one"))
    content, _ = stored(content, "contents")
    several = content.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    need = content.join(several, "anchor").select("anchor", "content", "m", "one.*")
    wanted = need.groupBy("th").agg(F.collect_list(F.struct("anchor", "content", "m", "left", "start", "windows")).alias("want"))
    # One of a text's copies: those that have its least id (more than one only if these repeat too).
    one = docs.select("th", "id").join(wanted.select("th"), "th", "left_semi").groupBy("th").agg(F.min("id").alias("id"))
    by_doc = docs.join(one.join(wanted, "th"), ["th", "id"])
    # Only the pieces go on, so that the text is not copied for each of them.
    piece = lambda x: F.struct(x["anchor"].alias("anchor"), x["content"].alias("content"), x["m"].alias("m"), x["left"].alias("left"), F.substring(F.col("data"), x["start"].cast("int") + 1, x["windows"] + (length - 1)).alias("bytes"))
    parts = by_doc.select(F.explode(F.transform("want", piece)).alias("x")).select("x.*")
    parts, parts_path = stored(parts, "parts")
    calm = parts.filter(F.col("m") <= hot).drop("m").repartition("anchor").sortWithinPartitions("anchor")
    ranges = calm.mapInArrow(lambda it: compare(it, length), RANGES).unionByName(compare_hot(parts.filter(F.col("m") > hot), length))
    ranges, _ = stored(ranges, "ranges")
    remove(spark, parts_path)
    whole = content.filter("n > 1").select("anchor", "content", F.lit(True).alias("whole"))
    hits = ranges.join(whole, ["anchor", "content"], "full").select("anchor", "content", "low", "high", "whole")
    at = some.join(hits, ["anchor", "content"])
    pairs = F.arrays_zip("low", "high")
    spans = F.when(F.col("whole"), F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("span")).alias("high")))).otherwise(F.transform(pairs, lambda p: F.struct((F.col("start") + p["low"]).alias("low"), (F.col("start") + p["high"]).alias("high"))))
    # A set: each task hands on one of what copies of a text have in common.
    return at.withColumn("spans", spans).groupBy("th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut_spans(data: bytes, low: list[int], high: list[int], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the windows that start in [low, high), and the maximal runs removed."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        b += length - 1
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    out, at = [], 0
    for a, b in merged:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), merged


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """A row per document: doc_id, kept (the remaining bytes), n_bytes, removed (byte ranges)."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("id"), F.unhex(F.md5(data)).alias("th"), data.alias("data"))
    spans = repeated_intervals(docs.select("id", "th", "data"), length, gram, hot)
    both = docs.join(spans, "th", "left").select("doc_id", "data", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))

    def work(texts, lows, highs):
        rows, kept, sizes, removed, held = [], [], [], [], 0
        for i, (x, low, high) in enumerate(zip(texts, lows, highs, strict=True)):
            x = x.as_py()
            k, m = (x, []) if not low.is_valid else cut_spans(x, low.as_py(), high.as_py(), length)
            rows.append(i)
            kept.append(k)
            sizes.append(len(x))
            removed.append([{"low": a, "high": b} for a, b in m])
            held += len(k)
            if held > BATCH:
                yield rows, [kept, sizes, removed]
                rows, kept, sizes, removed, held = [], [], [], [], 0
        if rows:
            yield rows, [kept, sizes, removed]

    return arrow_map(both, ["doc_id"], ["data", "low", "high"], work, "kept binary, n_bytes long, removed array<struct<low:long,high:long>>")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that they repeat. repeats says whether a document has any (1 or 0)."""
    d = deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["high"] - x["low"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).cast("int").alias("repeats"))

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a keyed random order and joined to one circular stream of words. A source asks for
target / block words slots (at least ``LEAST`` slots of smaller blocks, if its target is small), and these are the
weights of the schedule: slot t stands at the golden-ratio point t * g mod N (in whole numbers: g is coprime to N and next to
N / phi, so that each of N equally spaced points comes once and every run of slots holds each source in proportion). The
points are mapped through the cumulative weights; a source gets the slots whose points fall into its interval, one more
or less than it asks for. Slots are ranked within their source, and what the source is to give is cut into as many blocks of equal
words as it has slots: the slot of rank k reads block k of the stream, which begins anew after the last word. What a
document gives is what the slots that join its blocks read of it; a schedule that is read only to its middle gives about
half of each source.

Nulls: a null text has no words and is taken no word of; a null source is a source of its own, ordered last; null
or repeated doc_ids are rows like others. Ties in the keyed order are broken by the keys and the size. Very long texts are
read in several blocks. An empty table gives no rows. More than ``MOST_SOURCES`` sources are an error.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BUCKETS, cut, free, pair_key, table, word_count

WEIGHTS = (3, 1, 2)
#: Words of all slots, over words of all documents; and how often a document may be read at most.
EPOCHS, MAX_REPEAT = 1.5, 2
BLOCK_TOKENS = 8192
GOLDEN = (5**0.5 - 1) / 2
#: Slots that a source with any target has at least (or one for each word of it).
LEAST = 64
#: Slots that one row of the plan expands to at most.
CHUNK = 1 << 16
#: The plan has a row for each source, whose cumulative sums are taken in one task.
MOST_SOURCES = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (source, source_size), a row per source: src (its rank by code point, null last) and target.

    The budget is shared by weight; what is over max_repeat times a source's size is shared anew by weight. That
    ends where sources up to some ratio of limit to weight stand at their limits and the others share one level;
    in order of the ratio, a source stands at its limit as long as the level of those left is higher.
    The input has a row per source, so its windows are over that few rows."""
    every, w = Window.partitionBy(), len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("src", (F.row_number().over(by_name) - 1).cast("long"))
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % w + 1).cast("int")))
    d = d.withColumn("limit", F.col("source_size") * max_repeat)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_left", F.sum("source_size").over(every) * F.lit(epochs) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    d = d.withColumn("_w", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    d = d.withColumn("_full", F.col("limit") * F.col("_w") < F.col("weight") * F.col("_left"))
    d = d.withColumn("_level", F.max(F.when(~F.col("_full"), F.struct(-F.row_number().over(ratio), F.col("_left") / F.col("_w")))).over(every)["col2"])
    target = F.when(F.col("_full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("_level"))
    return d.select("source", "source_size", "src", F.coalesce(target, F.lit(0.0)).alias("target"))


def _step(n: int) -> tuple[int, int]:
    """g next to n / phi and coprime to n, and its inverse modulo n."""
    g = max(1, round(n * GOLDEN))
    while gcd(g, n) != 1:
        g += 1
    return g % n or 1, pow(g, -1, n) if n > 1 else 0


def _times(a: Column, b: int, n: int) -> Column:
    """a * b mod n for n below 2**46, in longs: b is taken in pieces of 16 bits."""
    out, shift = F.lit(0).cast("long"), b
    parts = []
    while shift:
        parts.append(shift & 0xFFFF)
        shift >>= 16
    for p in reversed(parts):
        out = ((out * 65536) % n + (a * p) % n) % n
    return out


def planned(sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Adds to source_targets(): quota (whole words), first and slots (the equally spaced points in its interval of the
    cumulative weights), and every (all slots)."""
    one, so_far = Window.partitionBy(), Window.orderBy("src")
    d = sources.withColumn("quota", F.round("target").cast("long"))
    block = F.least(F.lit(float(block_tokens)), F.greatest(F.lit(1.0), F.col("quota") / LEAST))
    d = d.withColumn("_w", F.col("quota") / block)
    d = d.withColumn("_all", F.sum("_w").over(one)).withColumn("every", F.ceil("_all").cast("long")).withColumn("_to", F.sum("_w").over(so_far))
    # Point y lies at (y + 1/2) / every of all weights.
    upto = lambda x: F.ceil(x / F.nullif(F.col("_all"), F.lit(0.0)) * F.col("every") - 0.5).cast("long")
    d = d.withColumn("first", F.coalesce(upto(F.col("_to") - F.col("_w")), F.lit(0).cast("long")))
    return d.withColumn("slots", F.coalesce(upto(F.col("_to")) - F.col("first"), F.lit(0).cast("long"))).drop("_w", "_all", "_to")


def schedule(sources: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """From source_targets(), a row per slot: slot, src, rank (its place among the slots of its source)."""
    return _scheduled(planned(sources, block_tokens))


def _scheduled(plan: DataFrame) -> DataFrame:
    d = plan.filter("slots > 0").select("src", "first", "slots", "every")
    n = d.agg(F.max("every")).first()[0] or 0
    if n == 0:
        return d.select(F.lit(0).cast("long").alias("slot"), "src", F.lit(0).cast("long").alias("rank")).limit(0)
    _, inverse = _step(n)
    d = d.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))))
    d = d.repartition("src", "at")
    d = d.withColumn("y", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + CHUNK, F.col("slots")) - 1)))
    d = d.select(_times(F.col("y"), inverse, n).alias("slot"), "src").withColumn("bin", F.floor(F.col("slot") / CHUNK))
    inner = d.withColumn("r", F.row_number().over(Window.partitionBy("src", "bin").orderBy("slot")) - 1)
    counts = d.groupBy("src", "bin").agg(F.count("*").alias("n"))
    counts = counts.select("src", "bin", (F.sum("n").over(Window.partitionBy("src").orderBy("bin")) - F.col("n")).alias("o"))
    return inner.join(counts, ["src", "bin"]).select("slot", "src", (F.col("o") + F.col("r")).cast("long").alias("rank"))


def placed(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Adds to (keys: a struct, source, size): the source's plan, and at, a document's first word in its source's stream. Also
    the plan itself."""
    # Rows without a doc_id are spread by the text's hash.
    d = docs.withColumn("_h", F.xxhash64(F.lit(seed), "keys.*")).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    d = d.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    sums = cut(d.groupBy("_k", "_b").agg(F.sum("size").alias("_n"), F.first("source").alias("source")))
    sizes = cut(sums.groupBy("_k").agg(F.first("source").alias("source"), F.sum("_n").alias("source_size")))
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = cut(planned(source_targets(sizes.drop("_k")), block_tokens))
    begin = sums.select("_k", "_b", (F.sum("_n").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_n")).alias("_o"))
    begin = begin.join(plan.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source", "first", "every"), "_k")
    w = Window.partitionBy("_k", "_b").orderBy("_h", "keys", "size")
    d = d.withColumn("_i", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d = d.withColumn("row", F.row_number().over(w)).join(begin, ["_k", "_b"])
    return d.withColumn("at", F.col("_o") + F.col("_i")).withColumn("bucket", F.col("_b")).drop("_k", "_h", "_b", "_o", "_i"), plan


def _block_of(at: Column, quota: Column, slots: Column) -> Column:
    """The block that a word of the stream stands in: the first quota mod slots blocks have one word more than the others."""
    base, more = F.floor(quota / slots), quota % slots
    return F.when(at < more * (base + 1), F.floor(at / F.greatest(base + 1, F.lit(1)))).otherwise(more + F.floor((at - more * (base + 1)) / F.greatest(base, F.lit(1)))).cast("long")


def _begin_of(block: Column, quota: Column, slots: Column) -> Column:
    return (block * F.floor(quota / slots) + F.least(block, quota % slots)).cast("long")


def mix(docs: DataFrame, keys: list[str], block_tokens: int = BLOCK_TOKENS, max_repeat: int = MAX_REPEAT, read: float = 1.0) -> DataFrame:
    """The mix of (keys, source, size): a row per document and piece of a block that is read from it:
    slot (when), epoch, first and words (which of the document's words). A document that nothing is read from has
    one row with slot null and words 0. read: the share of the schedule's slots that is read, from its beginning. A column
    of these whose name a key has gets underscores behind it."""
    d, plan = placed(docs.select(F.struct(*keys).alias("keys"), "source", "size"), block_tokens)
    q, c = F.col("quota"), F.greatest(F.col("slots"), F.lit(1))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    d = d.withColumn("_from", F.col("at") + F.col("epoch") * F.col("source_size"))
    d = d.withColumn("_to", F.least(F.col("_from") + F.col("size"), q))
    reads = (F.col("_to") > F.col("_from")) & (F.col("size") > 0) & (F.col("slots") > 0)
    d = d.filter(reads | (F.col("epoch") == 0))
    d = d.withColumn("rank", F.explode_outer(F.when(reads, F.sequence(_block_of(F.col("_from"), q, c), _block_of(F.col("_to") - 1, q, c)))))
    slots = _scheduled(plan)
    if read < 1:
        n = plan.agg(F.max("every")).first()[0] or 0
        slots = slots.filter(F.col("slot") < int(n * read))
    d = d.join(slots, ["src", "rank"], "left")
    joined = F.col("slot").isNotNull()
    first = F.greatest(F.col("_from"), _begin_of(F.col("rank"), q, c))
    words = F.when(joined, F.least(F.col("_to"), _begin_of(F.col("rank") + 1, q, c)) - first).otherwise(0)
    # Of rows without a slot, only one of a document that has no other counts; they add no words.
    names = ["source", "size", "source_size", "target", "src", "bucket", "row", "slot", "epoch", "first", "words"]
    d = d.withColumn("first", (first - F.col("_from")).cast("long")).withColumn("words", words.cast("long"))
    return d.select("keys.*", *[F.col(c).alias(n) for c, n in zip(names, free(names, keys), strict=True)])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets, a row per document with the words taken of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    docs = cut(docs)  # narrow rows; the texts are read once
    pieces = mix(docs, ["doc_id", "text_hash"])
    one = pieces.groupBy("src", "bucket", "row", "doc_id", "source", "size", "source_size", "target")
    return one.agg(F.sum("words").alias("taken"), F.count("slot").alias("pieces"), F.min("slot").alias("first_slot")).drop("src", "bucket", "row")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix as documents with all their columns: one row for each time that at least half of a document is read, so
    texts are never cut. A document without words is never read. Rows with equal id, source and text stand for each other.
    Texts are shuffled once."""
    key = F.concat(pair_key(doc_id, text), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    at = "_stratamap_key"
    slim = cut(docs.select(key.alias(at), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    reads = mix(slim, [at]).groupBy("src", "bucket", "row", at, "size", "epoch").agg(F.sum("words").alias("words"))
    times = reads.filter((F.col("words") > 0) & (F.col("words") * 2 >= F.col("size"))).groupBy("src", "bucket", "row", at).agg(F.count("*").alias("times"))
    # How many of the rows with a key are read once or more, twice or more, and so on.
    counts = times.groupBy(at).agg(F.array(*[F.count(F.when(F.col("times") >= t, 1)) for t in range(1, MAX_REPEAT + 1)]).alias("_stratamap_rows"))
    both = docs.withColumn(at, key).join(counts, at)
    n = F.row_number().over(Window.partitionBy(at).orderBy(F.lit(1)))
    both = both.withColumn("_stratamap_n", n).withColumn("_stratamap_n", F.size(F.filter("_stratamap_rows", lambda c: c >= F.col("_stratamap_n"))))
    again = F.explode(F.when(F.col("_stratamap_n") > 0, F.sequence(F.lit(1), F.col("_stratamap_n"))))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], again.alias("_stratamap_time")).drop("_stratamap_time")

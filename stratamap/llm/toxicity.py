"""Toxicity by weak supervision: many voters, a generative label model over them, and a linear classifier.

1. A lexicon is found in a bounded sample of labelled rows: words, and beginnings of words, that occur in toxic texts and
   hardly in others. A fixed list of abusive words, written without a look at any label, is added, less those that the
   sample's other texts hold as often. The entries are dealt to
   ``GROUPS`` voters; further voters look at how many different entries, how dense, at insults addressed to someone, at
   disguised spellings, and two vote for the other class (nothing found, or nothing found in a long text). A voter
   abstains where it sees nothing.
2. The label model takes the counts of all vote patterns over all documents (at most 2 ** voters rows, in practice a few
   thousand). Its expectation maximisation estimates each voter's accuracy and how often it speaks in either class;
   voters that agree more often than two independent ones of their accuracies would are correlated, and a voter's
   evidence is divided by the number of voters that it is worth with those. No label enters here except the share of
   toxic rows in the sample, as the prior.
3. A logistic regression is trained on posterior labels, over the votes, counts of findings, and ``TERMS`` words of its own:
   those whose occurrence goes with the posterior of a bounded sample of ``TRAIN_ROWS`` distinct documents (the smallest
   hashes), whether a voter knows them or not. So it can find texts in which no voter speaks. Its threshold is moved to
   0.5 on the labelled sample.

Labels are read only of rows whose crc32(doc_id) mod 5 is not 0; several labels of a doc_id count as toxic if one does.
Without labels the fixed list alone votes. Nulls: a null or empty text scores like any text without findings; rows with null
or repeated doc_ids are scored like others (a null doc_id is never held out). Very long texts are read whole. Columns keep
their names whatever they are. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, free, remove, stored, table

#: Bounds of what is learned from: labelled rows of either class, lexicon entries, documents for the classifier, its words.
TOXIC_ROWS, CLEAN_ROWS, ENTRIES, TRAIN_ROWS, TERMS = 4000, 8000, 1500, 40_000, 200
GROUPS, SHORTEST, LONGEST = 8, 4, 7
#: Rows of the classifier's sample that are doubles at a time.
BLOCK = 2048
#: An entry's share of the toxic sample, and of what it occurs in that is toxic.
SHARE, PURITY = 0.01, 0.97
#: Purity under which a word of the fixed list does not count.
DOUBT = 0.9
# Common abusive words of four languages, as any dictionary marks them.
INSULTS = """
arse arsehole ass asshole assholes bastard bastards bimbo bitch bitches blockhead bollocks bozo buffoon bullshit clown clowns
coward cowards crap creep creeps cretin cretins cunt degenerate despicable dickhead dimwit dipshit disgrace disgusting dork
douche douchebag dumb dumbass dummy dunce fatso filth filthy fool foolish fools freak fuck fucked fucker fucking garbage
gobshite halfwit hag hypocrite idiot idiotic idiots ignoramus imbecile imbeciles jackass jerk jerks knobhead lame liar lowlife
loser losers lunatic maggot moron moronic morons motherfucker muppet nitwit numbskull nutjob parasite pathetic pervert pig pigs
piss prick psycho punk rat retard retarded rubbish scum scumbag shit shithead shitty simpleton skank slag slob slut snake sod
stupid swine tosser traitor tramp trash troll twat twit useless vermin vile wanker weirdo whore wimp witch worthless wretch
arschloch blöd blödmann depp drecksau dumm dummkopf fresse hure hurensohn idiotin mistkerl mistkerle miststück penner sau
scheisse scheiße schlampe schwachkopf schwein spinner trottel vollidiot wichser
abruti bâtard bouffon connard connasse conne crétin débile enculé imbécile merde ordure pourri putain pute salaud salope
cabrón cerdo estúpido gilipollas idiota imbécil maldito mierda pendejo puta tonto zorra
""".split()
DISGUISE = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W\d_]+")
DISGUISES = re.compile("[" + re.escape("".join(map(chr, DISGUISE))) + "]")
DISGUISED = re.compile(r"(?<!\w)(?=\w*[a-z])(?=[a-z@$!]*\d|[a-z0-9!]*[@$])[a-z0-9@$!]{4,12}(?!\w)")
ADDRESSED = re.compile(r"\b(?:you|you're|youre|u|du|sie|tu|vous|usted|eres)\s+(?:are\s+|r\s+|bist\s+|es\s+|êtes\s+)?(?:an?\s+|so\s+|such\s+|ein[e]?\s+|un[e]?\s+|the\s+)?([^\W\d_]+)")
VOTERS = [*(f"lexicon{i}" for i in range(GROUPS)), "insult", "two", "four", "dense", "addressed", "disguised", "clean", "clean_long"]
NEGATIVE = np.array([v.startswith("clean") for v in VOTERS])
FEATURES = 8 + len(VOTERS)


Entries = tuple[tuple[str, bool | None], ...]


@lru_cache(maxsize=4)
def _index(entries: Entries) -> tuple[dict[str, int], dict[str, int], frozenset[str], frozenset[str]]:
    words = {e: i for i, (e, whole) in enumerate(entries) if whole}
    heads = {e: i for i, (e, whole) in enumerate(entries) if whole is False}
    return words, heads, frozenset(e[:3] for e, whole in entries if whole is not None), INSULT_SET - {e for e, whole in entries if whole is None}


def findings(text: str | None, entries: Entries) -> tuple[int, list[float]]:
    """A text's votes (bit i: voter i speaks) and features. entries: (text, whether it is a
    whole word; None: a word of the fixed list that does not count)."""
    low = (text or "").lower()
    return _findings(low, WORD.findall(low), entries)


def _findings(low: str, words: list[str], entries: Entries) -> tuple[int, list[float]]:
    words_of, heads_of, starts, insulting = _index(entries)
    hits: Counter = Counter()
    insults = 0
    for w in [w for w in words if w[:3] in starts]:
        found = {words_of[w]} if w in words_of else set()
        found |= {heads_of[w[:n]] for n in range(SHORTEST, LONGEST + 1) if w[:n] in heads_of}
        hits.update(found)
    insults = sum(w in insulting for w in set(words))
    total, rate = sum(hits.values()), 0.0
    distinct, n = len(hits), max(1, len(words))
    rate = total / n
    groups = {e % GROUPS for e in hits}
    addressed = sum(m[1] in insulting or m[1] in words_of for m in ADDRESSED.finditer(low)) if hits or insults else 0
    disguised = sum(m[0].translate(DISGUISE) in insulting for m in DISGUISED.finditer(low)) if DISGUISES.search(low) else 0
    votes = sum(1 << g for g in groups)
    for k, on in enumerate((insults > 0, distinct >= 2, distinct >= 4, rate >= 0.004 and total >= 2, addressed > 0, disguised > 0, not (hits or insults or disguised), not (hits or insults or disguised) and n >= 50)):
        votes |= int(on) << GROUPS + k
    bits = [float(votes >> i & 1) for i in range(len(VOTERS))]
    return votes, [np.log1p(total), np.log1p(distinct), min(1.0, 20 * rate), np.log1p(insults), np.log1p(addressed), np.log1p(disguised), float(total > 0), float(len(groups)) / GROUPS, *bits]


INSULT_SET = frozenset(INSULTS)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows that are not held out, the smallest hashes of either class."""
    ids = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Only ids that have a text count; each task hands on no more than the limit.
    some = lambda y, n: ids.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(n)
    ids = some(1, TOXIC_ROWS).unionByName(some(0, CLEAN_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def sketch(texts):
        words = [WORD.findall((t or "").lower()) for t in texts.to_pylist()]
        five = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
        yield None, [[min(xxhash.xxh32_intdigest(x, k) for x in f) for f in five] for k in (0, 1)]

    # Near copies would count as evidence over and over: of texts with an equal least shingle hash, one stays (twice).
    rows = arrow_map(rows, ["text", "toxic"], ["text"], sketch, "s0 long, s1 long")
    for k in ("s0", "s1"):
        w = Window.partitionBy("toxic", k).orderBy(F.xxhash64("text"), "text")
        rows = rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return rows.select("text", "toxic")


def lexicon(sample: DataFrame) -> list[tuple[str, bool | None]]:
    """Words and beginnings of words of the toxic sample: (text, whether it is a whole word), and the words of the fixed list
    that the sample speaks against (text, None): they stand in two of its other texts or more, and hardly more often in toxic
    ones, as words do that mean something else in the corpus."""

    def count(texts, toxic):
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for text, y in zip(texts.to_pylist(), toxic.to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            mine = {f"={w}" for w in words if 3 <= len(w) <= 16}
            for n in range(SHORTEST, LONGEST + 1):
                mine |= {w[:n] for w in words if len(w) >= n}
            seen[y].update(mine)
        keys = list(seen[0].keys() | seen[1].keys())
        yield [0] * len(keys), [keys, [seen[1][k] for k in keys], [seen[0][k] for k in keys]]

    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    # The clean sample stands for more rows than the toxic one; shares are compared, not counts.
    found = arrow_map(sample, [], ["text", "toxic"], count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.col("toxic") / sizes[1]
    pure = share / (share + F.col("clean") / sizes[0])
    found, _ = stored(found.withColumn("pure", pure), "counts")
    against = found.filter(F.col("entry").isin([f"={w}" for w in INSULTS]) & (F.col("clean") >= 2) & (F.col("pure") < DOUBT)).orderBy("entry").collect()
    pure = F.col("pure")
    found = found.filter((F.col("toxic") >= max(5, SHARE * sizes[1])) & (pure >= PURITY))
    found = found.orderBy(F.desc("toxic"), "clean", "entry").limit(ENTRIES)
    out = specific([(r.entry, r.toxic) for r in found.collect()])
    return [*out, *((r.entry[1:], None) for r in against)]


def specific(counts: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Of entries with their counts (words marked by =), falling: a beginning is left out if nearly all its texts have
    one longer entry, for which it only stands in; an entry under a beginning that stays adds nothing."""
    longer: dict[str, int] = {}
    for entry, n in counts:
        text = entry.lstrip("=")
        for k in range(SHORTEST, len(text) + (entry[0] == "=")):
            longer[text[:k]] = max(longer.get(text[:k], 0), n)
    chosen: list[tuple[str, bool]] = []
    heads: set[str] = set()
    for entry, n in counts:
        whole, text = entry[0] == "=", entry.lstrip("=")
        if not whole and longer.get(text, 0) >= 0.8 * n:
            continue
        if not any(text[:k] in heads for k in range(SHORTEST, len(text) + 1)):
            chosen.append((text, whole))
            if not whole:
                heads.add(text)
    return chosen


@dataclass
class LabelModel:
    """Voters' speaking rates in either class, their evidence, and the prior."""

    prior: float
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    worth: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> LabelModel:
        """votes: patterns (rows) by voters, 1 where one speaks."""
        m = cls(min(max(prior, 1e-3), 0.5))
        v, c = votes.astype(float), counts.astype(float)
        # The start: a majority of those that speak.
        balance = v @ np.where(NEGATIVE, -1.0, 1.0)
        p = np.where(balance > 0, 0.95, np.where(balance < 0, 0.02, m.prior))
        m.worth = np.ones(v.shape[1])
        for _ in range(rounds):
            one, two = c * p, c * (1 - p)
            m.rates = np.stack([(two @ v + 0.5) / (two.sum() + 1), (one @ v + 0.5) / (one.sum() + 1)])
            m.accuracy = np.where(NEGATIVE, two @ v + 0.5, one @ v + 0.5) / (c @ v + 1)
            # Voters never count against their own class, or its names could be exchanged.
            for k in np.flatnonzero(m.accuracy < 0.5):
                m.rates[:, k] = m.rates[:, k].mean()
            m.correlation = cls._correlation(v, one, two, m.rates)
            m.worth = 1 / np.maximum(1.0, np.maximum(m.correlation, 0).sum(axis=1))
            p = m.posterior(v)
        return m

    @staticmethod
    def _correlation(v: np.ndarray, one: np.ndarray, two: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Of votes within the classes: what voters share beyond their accuracies."""
        cov = sum((w[:, None] * (v - r)).T @ (v - r) for w, r in ((two, rates[0]), (one, rates[1])))
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return cov / d[:, None] / d[None, :]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        r = np.clip(self.rates, 1e-4, 1 - 1e-4)
        said, silent = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        z = np.log(self.prior / (1 - self.prior)) + (votes * said + (1 - votes) * silent) @ self.worth
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bits(votes: np.ndarray) -> np.ndarray:
    return (np.asarray(votes, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on soft labels, by Newton steps. x may be narrow numbers;
    only ``BLOCK`` rows at a time are doubles, as this runs on the driver."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-9
    for _ in range(steps):
        g, h = penalty * w, np.diag(penalty + 1e-6)
        for k in range(0, len(x), BLOCK):
            b, of = np.column_stack([x[k : k + BLOCK], np.ones(len(x[k : k + BLOCK]))]), weight[k : k + BLOCK]
            p = 1 / (1 + np.exp(-np.clip(b @ w, -30, 30)))
            g += b.T @ (of * (p - y[k : k + BLOCK]))
            h += (b * (of * p * (1 - p))[:, None]).T @ b
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    entries: Entries
    label_model: LabelModel
    terms: tuple[str, ...]
    #: Of the features, the terms and the constant.
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features and terms."""
        z = np.concatenate([x[k : k + BLOCK].astype(np.float64) @ self.weights[:-1] for k in range(0, len(x), BLOCK)]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


SEEN = ("_stratamap_votes", "_stratamap_features", "_stratamap_terms")


def _observe(df: DataFrame, keep: list[str], entries: Entries, terms: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Adds votes, features and the terms that occur (numbers of terms) to the kept columns."""
    number = {t: i for i, t in enumerate(terms)}

    def work(texts):
        votes, features, found = [], [], []
        for t in texts.to_pylist():
            low = (t or "").lower()
            words = WORD.findall(low)
            v, f = _findings(low, words, entries)
            votes.append(v)
            features.append(f)
            found.append(sorted({number[w] for w in words if w in number}) if number else [])
        yield None, [votes, features, found]

    return arrow_map(df, keep, [text], work, f"{SEEN[0]} long, {SEEN[1]} array<float>, {SEEN[2]} array<int>")


def own_terms(sample: DataFrame, model: LabelModel, most: int = TERMS) -> tuple[str, ...]:
    """Words of the sample (text, votes) that go with the posterior: those whose mean posterior lies furthest above the
    sample's, in standard errors, and above one half; words of fewer than five documents don't count."""

    def count(texts, votes):
        p = model.posterior(bits(votes.to_numpy(zero_copy_only=False))) if len(votes) else []
        n, s = Counter(), Counter()
        for t, y in zip(texts.to_pylist(), p, strict=True):
            words = {w for w in WORD.findall((t or "").lower()) if 3 <= len(w) <= 24}
            n.update(words)
            if y > 0.01:
                for w in words:
                    s[w] += float(y)
        keys = list(n)
        yield [0] * len(keys), [keys, [n[k] for k in keys], [s[k] for k in keys]]

    words = arrow_map(sample, [], ["text", SEEN[0]], count, "word string, n long, s double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    z = F.round((F.col("s") / F.col("n") - 0.5) * F.sqrt("n"), 6)
    return tuple(r.word for r in words.filter((F.col("n") >= 5) & (z > 0)).orderBy(F.desc(z), "word").limit(most).collect())


def best_shift(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds to take off so that 0.5 separates the labelled rows with the best F1 (the middle of a tie)."""
    z = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / np.clip(1 - scores, 1e-9, 1))
    levels = np.unique(z)
    if len(levels) < 2 or not toxic.any():
        return 0.0
    cuts = (levels[1:] + levels[:-1]) / 2
    f1 = []
    for t in cuts if len(cuts) < 400 else np.quantile(cuts, np.linspace(0, 1, 400)):
        hit = z >= t
        tp, fp, fn = ((weight * m).sum() for m in (hit & toxic, hit & ~toxic, ~hit & toxic))
        f1.append((2 * tp / max(1e-9, 2 * tp + fp + fn), t))
    top = max(f for f, _ in f1)
    tied = [t for f, t in f1 if f >= top - 1e-9]
    return float(tied[len(tied) // 2])


def _gathered(seen: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Votes, features and terms (a row of floats for each document), and the kept columns of a bounded frame, by Arrow: no
    Python object for a value."""
    t = seen.toArrow()
    column = lambda c: t[c].combine_chunks()
    x = np.zeros((len(t), FEATURES + n), np.float32)
    x[:, :FEATURES] = column(SEEN[1]).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    found = column(SEEN[2])
    x[np.repeat(np.arange(len(t)), found.value_lengths().to_numpy(zero_copy_only=False)), FEATURES + found.flatten().to_numpy(zero_copy_only=False)] = 1
    return column(SEEN[0]).to_numpy(zero_copy_only=False), x, {c: column(c).to_numpy(zero_copy_only=False) for c in t.column_names if c not in SEEN}


def _in_order(x: np.ndarray) -> np.ndarray:
    """An order of rows that their contents decide, found without a copy of the columns."""
    return np.argsort(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), kind="stable")


def training_sample(docs: DataFrame, text: str = "text", most: int = TRAIN_ROWS) -> DataFrame:
    """About ``most`` distinct texts: those whose hashes are the smallest."""
    h = F.xxhash64(F.lit(9), F.col(text))
    n = docs.select(F.approx_count_distinct(h)).first()[0]
    share = int(min(1.0, most / max(n, 1)) * (1 << 30))
    return docs.select(F.col(text).alias("text"), h.alias("h")).filter(F.pmod("h", F.lit(1 << 30)) < share).groupBy("h").agg(F.first("text").alias("text")).select("text")


def train(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the kept columns, votes, features and terms of every document, whose votes the label model was
    fitted on."""
    spark = docs.sparkSession
    sample, _ = stored(labelled_sample(docs, labels), "labelled")
    learned = lexicon(sample)
    doubted = {w for w, whole in learned if whole is None}
    entries = tuple(dict.fromkeys([*learned, *((w, True) for w in INSULTS if w not in doubted)]))
    all_labels = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    prior = 0.1 if all_labels is None else float(all_labels)

    def fitted(seen: DataFrame) -> LabelModel:
        patterns = seen.groupBy(SEEN[0]).agg(F.count("*").alias("n")).orderBy(SEEN[0]).toPandas()
        return LabelModel.fit(bits(patterns[SEEN[0]].to_numpy(np.int64)), patterns["n"].to_numpy(), prior)

    # The classifier's words come from the sample under a label model of its votes, so that one pass over all documents
    # finds votes and words; the posteriors that train it are of the model over all documents.
    some, some_path = stored(_observe(training_sample(docs, text), ["text"], entries), "training")
    terms = own_terms(some, fitted(some))
    seen, _ = stored(_observe(docs, list(keep), entries, terms, text), "votes")
    model = fitted(seen)
    votes, x, _ = _gathered(_observe(some.select("text"), [], entries, terms), len(terms))
    y = model.posterior(bits(votes))
    order = _in_order(x)  # sums in one order, whatever the tasks
    x, y = x[order], y[order]
    w = logistic(x, y, np.ones(len(y))) if len(y) else np.zeros(FEATURES + len(terms) + 1)
    remove(spark, some_path)
    out = Model(entries, model, terms, w)
    _, x, known = _gathered(_observe(sample, ["toxic"], entries, terms), len(terms))
    toxic = known["toxic"] == 1
    if toxic.any() and not toxic.all():
        scores = out.score(x)
        weight = np.where(toxic, prior / toxic.sum(), (1 - prior) / (~toxic).sum())
        w[-1] -= best_shift(scores, toxic, weight)
    return out, seen


def score(seen: DataFrame, model: Model) -> DataFrame:
    """The kept columns, score and predicted, from votes and features, in plain columns."""
    w = [float(x) for x in model.weights]
    z = F.lit(w[-1])
    for i, x in enumerate(w[:FEATURES]):
        z = z + F.element_at(SEEN[1], i + 1).cast("double") * F.lit(x)
    of = F.array(*map(F.lit, [*w[FEATURES:-1], 0.0]))
    z = z + F.aggregate(SEEN[2], F.lit(0.0), lambda s, t: s + F.element_at(of, t + 1))
    s = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    kept = [c for c in seen.columns if c not in SEEN]
    name, label = free(["score", "predicted"], kept)
    return seen.select(*[F.col(f"`{c}`") for c in kept], s.alias(name)).withColumn(label, (F.col(name) >= 0.5).cast("int"))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, seen = train(docs, table(spark, sf_dir, "labels"))
    return score(seen, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns. Texts are read once by Python: rows are
    written aside with what was found in them, and filtered from there."""
    model, seen = train(docs, labels, tuple(docs.columns))
    scored = score(seen, model)
    return scored.filter(F.col(scored.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

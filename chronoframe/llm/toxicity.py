"""Toxicity by class-conditional Kneser-Ney models.

One model is fitted to toxic and one to ordinary labelled documents. Each spells
the words of a text: a character x is predicted from the history h, up to ORDER - 1
characters before it in its word,

    p(x | h) = (c(h x) - D(c(h x)) + (M(h) + PULL) * shared(x | h)) / (c(h) + PULL)

with the class's counts c (documents that hold a word), discounts D estimated from
the counts of counts, and the mass M(h) that they leave. Both classes back off to
one shared model: Kneser-Ney of the orders ORDER down to 2 over the vocabulary of
the whole corpus, where each distinct word counts once, so that a frequent word
weighs no more than its type. PULL such counts are mixed into every class history.
So words, rare or unseen, of which neither class knows more than chance have the
same likelihood under both, and new words are judged by stems that they share.

A word's two log-likelihoods differ by chance, too: only a ratio of more than
e**GATE to one counts as evidence. The document's statistic is the difference of
its length-normalised log-likelihoods, the sum of such ratios for each word; a
logistic curve, fitted to labelled documents that the counts did not see and drawn
to a prior curve where they are few, turns it into a probability.

Grams are packed into 64-bit integers and the fitted model is four sorted arrays,
bounded by the labelled sample.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, materialized, release, table, text_or_empty

WORD = re.compile(r"\w+")
ORDER, PULL, GATE = 6, 20.0, 3.0
#: Logistic curve before any label is seen, slope for a unit of evidence a word and offset, and how many documents it weighs.
PRIOR_CURVE, PRIOR_WEIGHT = (60.0, -3.0), 2.0
#: Distinct words, or grams, that a task holds before it hands its counts on.
HELD = 200_000
#: Words whose ratios a task keeps.
KNOWN = 100_000
#: Longer words are spelled in parts of this length.
PART = 48
#: Bits of a character; the marks of a word's start and end are 1 and 2.
BITS, START, END = 10, 1, 2
I = np.int64


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(word: str) -> list[str]:
    return [word] if len(word) <= PART else [word[i : i + PART] for i in range(0, len(word), PART)]


def _codes(text: str) -> np.ndarray:
    """A code below 2**BITS for each character: digits are one, and characters beyond the Latin ones fold to 256 others."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(I)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    return np.where(c < 0x250, c, 0x250 + c % 256)


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words' parts between their marks, each code's place in its part, and its word's number."""
    parts, owner = [], []
    for i, w in enumerate(words):
        for p in parts_of(w):
            parts.append(p)
            owner.append(i)
    lengths = np.array([len(p) + 2 for p in parts], I)
    starts = np.cumsum(lengths) - lengths
    codes = np.empty(int(lengths.sum()), I)
    inner = np.ones(len(codes), bool)
    codes[starts], codes[starts + lengths - 1] = START, END
    inner[starts] = inner[starts + lengths - 1] = False
    codes[inner] = _codes("".join(parts))
    return codes, np.arange(len(codes), dtype=I) - np.repeat(starts, lengths), np.repeat(np.array(owner, I), lengths)


def grams(codes: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of up to `order` characters that end at each character but a part's first, and where they end."""
    out = np.zeros(len(codes), I)
    for back in range(order - 1, -1, -1):
        before = np.concatenate([np.zeros(back, I), codes[: len(codes) - back]]) if back else codes
        out = np.where(place >= back, out << BITS | before, out)
    at = np.flatnonzero(place > 0)
    return out[at], at


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, weights=n, minlength=len(distinct)).astype(I)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), I), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_counts(docs: DataFrame) -> DataFrame:
    """Frequency of every word of the corpus: word, n. A row for each distinct word, however many."""
    counts: Counter = Counter()

    def flushed():
        out = list(counts.items())
        counts.clear()
        return out

    def rows(batch):
        for text in batch["text"]:
            counts.update(words_of(text))
            if len(counts) >= HELD:
                yield from flushed()

    return arrow_map(docs.select("text"), rows, "word string, n long", finish=flushed).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(df: DataFrame, found, keys: tuple[str, ...]) -> DataFrame:
    """Sums of what `found` gives for each batch, (packed key, n) as arrays for each value of the leading keys.

    found: batch -> iterable of (leading values, keys, n). A task sums before it hands on.
    """
    held: dict[tuple, list] = {}

    def flushed():
        for lead, parts in held.items():
            k, n = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for a, b in zip(k.tolist(), n.tolist(), strict=True):
                yield (*lead, a, b)
        held.clear()

    def rows(batch):
        for lead, k, n in found(batch):
            parts = held.setdefault(lead, [])
            parts.append(_sums(k, n))
            if sum(len(p[0]) for p in parts) > 8 * HELD:
                parts[:] = [_sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                if len(parts[0][0]) > 4 * HELD:
                    yield from flushed()

    schema = ", ".join([*(f"{k} int" for k in keys), "gram long", "n long"])
    return arrow_map(df, rows, schema, batch_rows=8192, finish=flushed).groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def class_counts(train: DataFrame) -> DataFrame:
    """Documents of each class and fold that hold a word, summed over the word's longest grams: toxic, fold, gram, n."""

    def found(batch):
        words: dict[tuple, Counter] = {}
        for toxic, fold, text in zip(batch["toxic"], batch["fold"], batch["text"], strict=True):
            words.setdefault((toxic, fold), Counter()).update(set(words_of(text)))
        for lead, counts in words.items():
            if counts:
                codes, place, owner = spell(list(counts))
                g, at = grams(codes, place, ORDER)
                yield lead, g, np.array(list(counts.values()), I)[owner[at]]

    return _counted(train.select("toxic", "fold", "text"), found, ("toxic", "fold"))


def histories(top: np.ndarray) -> np.ndarray:
    """Packed histories of the grams and of all their endings, sorted."""
    out, h = [], top >> BITS
    for n in range(ORDER - 1, 0, -1):
        out.append(h[h > 0] & ((1 << BITS * n) - 1))
    return np.unique(np.concatenate(out))


def shared_counts(words: DataFrame, wanted) -> DataFrame:
    """Distinct words of the corpus that hold a gram, for all grams after one of the `wanted` histories (a broadcast sorted array): gram, n."""

    def found(batch):
        if not batch["word"]:
            return
        codes, place, _ = spell(batch["word"])
        for order in range(2, ORDER + 1):
            g, at = grams(codes, place, order)
            if order > 2:  # shorter ones at a word's start have been counted
                g = g[place[at] >= order - 1]
            g = g[_find(wanted.value, g >> BITS)[1]]
            yield (), g, np.ones(len(g), I)

    return _counted(words.select("word"), found, ())


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, and 3 or more, estimated from the counts of counts (Chen and Goodman)."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[:6]
    if not n[1] or not n[2]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    each = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(each, 1))])


class _Level:
    """Counts of one set of grams: sorted grams, counts less discounts, and their histories' totals and masses left."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        off = discounts(n)[np.minimum(n, 3)]
        self.keys, self.less = keys, n - off
        self.before, where = np.unique(keys >> BITS, return_inverse=True)
        self.total = np.bincount(where, weights=n, minlength=len(self.before))
        self.mass = np.bincount(where, weights=off, minlength=len(self.before))

    def of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted count of each gram, total and mass of its history; zeros where unseen."""
        at, there = _find(self.keys, g)
        less = np.where(there, self.less[at], 0.0) if len(self.keys) else np.zeros(len(g))
        return (less, *self.history(g >> BITS))

    def history(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = _find(self.before, h)
        if not len(self.before):
            return np.zeros(len(h)), np.zeros(len(h))
        return np.where(there, self.total[at], 0.0), np.where(there, self.mass[at], 0.0)


def _length(g: np.ndarray) -> np.ndarray:
    """Characters of packed grams."""
    return sum((g >> BITS * k > 0).astype(I) for k in range(ORDER))


def shared_likelihood(g: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of the last character of each gram after the others under the shared model."""
    keys, n = _sums(keys, n)
    lengths, mine = _length(keys), _length(g)
    p = np.full(len(g), 1.0 / max(1, len(np.unique(keys & ((1 << BITS) - 1)))))
    for order in range(2, ORDER + 1):
        level = _Level(keys[lengths == order], n[lengths == order])
        less, total, mass = level.of(g & ((1 << BITS * order) - 1))
        p = np.where((mine >= order) & (total > 0), (less + mass * p) / np.maximum(total, 1), p)
    return p


class Model:
    """Log-likelihood ratios of words."""

    def __init__(self, classes: list[tuple[np.ndarray, np.ndarray]], shared: tuple[np.ndarray, np.ndarray]):
        """classes: (grams, counts) of the ordinary and of the toxic documents; shared: as shared_counts gives them."""
        levels = [_Level(*_sums(*c)) for c in classes]
        self.keys = np.unique(np.concatenate([x.keys for x in levels]))
        q = shared_likelihood(self.keys, *shared)
        log = []
        for x in levels:
            less, total, mass = x.of(self.keys)
            log.append(np.log((less + (mass + PULL) * q) / (total + PULL)))
        self.ratio = (log[1] - log[0]).astype(np.float32)
        self.before = np.unique(self.keys >> BITS)
        log = []
        for x in levels:
            total, mass = x.history(self.before)
            log.append(np.log((mass + PULL) / (total + PULL)))
        self.back = (log[1] - log[0]).astype(np.float32)

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, toxic against ordinary."""
        codes, place, owner = spell(words)
        g, at = grams(codes, place, ORDER)
        where, there = _find(self.keys, g)
        h, back = _find(self.before, g >> BITS)
        r = np.where(there, self.ratio[where], np.where(back, self.back[h], 0.0)) if len(self.keys) else np.zeros(len(g))
        return np.bincount(owner[at], weights=r, minlength=len(words))


class Scorer:
    """Statistics of texts under a model; keeps the ratios of words it met lately, until `clear`."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def clear(self):
        self.known.clear()

    def evidence(self, texts: list[str]) -> list[float]:
        """Sum of the words' ratios beyond the gate for each word of the text."""
        found = [words_of(t) for t in texts]
        if len(self.known) > KNOWN:
            self.clear()
        known = self.known
        new = list({w for ws in found for w in ws if w not in known})
        for at in range(0, len(new), 65536):
            part = new[at : at + 65536]
            known.update(zip(part, self.model.word_ratios(part).tolist(), strict=True))
        out = []
        for ws in found:
            r = [x for x in map(known.__getitem__, ws) if abs(x) > GATE]
            out.append(sum(r) / len(ws) if r else 0.0)
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of the logistic curve that is likeliest, by damped Newton steps; the prior counts as PRIOR_WEIGHT documents."""
    prior = np.array(PRIOR_CURVE)
    scale = np.array([prior[0], 1.0])  # slopes are measured in that of the prior
    a = np.column_stack([x * prior[0], np.ones(len(x))])
    w = prior / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + PRIOR_WEIGHT * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, a.T @ (weight * (y - p)) - PRIOR_WEIGHT * (w - prior / scale)), -1, 1)
    return float(max(w[0], 0.0) * scale[0]), float(w[1])


def _share(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("__id")), F.lit(1 << 20)) / (1 << 20)


def _columns(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000):
    """Model and curve, or None without labels of both classes.

    docs: __id, text; labels: __id, toxic. At most about `per_class` labelled
    documents of each class are used, chosen by a hash of their ids. Counts of
    three in four of them give a first model, on which the others fit the curve;
    the model that is used counts all. What reaches the driver is bounded by the
    labelled sample; the shared counts behind it hold the whole corpus.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("__id").isNotNull()).groupBy("__id").agg(F.max("toxic").cast("int").alias("toxic"))
    numbers = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if set(numbers) != {0, 1}:
        return None
    share = {c: min(1.0, per_class / n) for c, n in numbers.items()}
    limit = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    sample = known.filter(_share(11) < limit).withColumn("fold", (_share(12) < 0.25).cast("int"))
    train = materialized(docs.join(F.broadcast(sample), "__id").select("toxic", "fold", "text"))  # a bounded sample
    toxic, fold, gram, n = _columns(class_counts(train))
    if not len(gram):
        return None
    wanted = spark.sparkContext.broadcast(histories(gram))
    shared = tuple(_columns(shared_counts(word_counts(docs), wanted)))
    of = lambda c, use: (gram[use & (toxic == c)], n[use & (toxic == c)])
    first = spark.sparkContext.broadcast(Model([of(c, fold == 0) for c in (0, 1)], shared))

    def judged(batch):
        x = Scorer(first.value).evidence(batch["text"])
        return zip(batch["toxic"], x, strict=True)

    held_y, held_x = _columns(arrow_map(train.filter("fold = 1").select("toxic", "text"), judged, "toxic int, x double"))
    curve = fit_curve(held_x, held_y.astype(float), np.array([1 / share[int(c)] for c in held_y]))
    whole = Model([of(c, fold >= 0) for c in (0, 1)], shared)
    return whole, curve


def _training(labels: DataFrame, id_col: str, folds: int, held_out: int) -> DataFrame:
    known = labels.select(F.col(id_col).alias("__id"), "toxic")
    return known.filter(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(folds)) != held_out)


class _Scores:
    """Function from texts to their probabilities of being toxic, out of the broadcast model and curve."""

    def __init__(self, fitted):
        self.fitted, self.scorer = fitted, None

    def __getstate__(self):
        return self.fitted

    def __setstate__(self, fitted):
        self.__init__(fitted)

    def __call__(self, texts: list[str]) -> list[float]:
        if self.fitted.value is None:
            return [0.0] * len(texts)
        model, (slope, offset) = self.fitted.value
        self.scorer = self.scorer or Scorer(model)
        z = np.clip(slope * np.array(self.scorer.evidence(texts)) + offset, -30, 30)
        return (1 / (1 + np.exp(-z))).tolist()

    def clear(self):
        """What a worker kept must not stay when its partition is through."""
        self.scorer = None
        return ()


def _fitted(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, per_class: int, id_col: str, text_col: str) -> _Scores:
    rows_in = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    return _Scores(docs.sparkSession.sparkContext.broadcast(fit(rows_in, _training(labels, id_col, folds, held_out), per_class)))


def score_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, folds: int = 4, held_out: int = 2, per_class: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text, one row for each input row.

    Labels are learned only from rows whose crc32(id as text) mod `folds` is not
    `held_out`. Returns `id_col`, held_out (null ids: false), score, predicted.
    Null and empty texts get the score of a document without evidence. Without
    labels of both classes every score is 0; with few, scores follow the prior
    curve. Null ids and repeated rows stay; of repeated labels the toxic one
    counts; an empty table gives an empty result; other columns are ignored.
    """
    scores = _fitted(docs, labels, folds, held_out, per_class, id_col, text_col)

    def rows(batch):
        for key, out, s in zip(batch["__id"], batch["held_out"], scores(batch["text"]), strict=True):
            yield key, out, s, int(s >= cutoff)

    out = F.coalesce(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    rows_in = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    scored = arrow_map(rows_in.select("__id", out.alias("held_out"), "text"), rows, f"id {kind}, held_out boolean, score double, predicted int", finish=scores.clear)
    return scored.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, folds: int = 4, held_out: int = 2, per_class: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that `score_toxicity` does not predict toxic, with all their columns, without a shuffle.

    Rows are judged as there: null and empty texts stay unless the prior alone
    reaches the cutoff, repeated rows share their fate, extra columns pass through.
    """
    scores = _fitted(docs, labels, folds, held_out, per_class, id_col, text_col)
    place = docs.columns.index(text_col)

    def kept(batches):
        for batch in batches:
            step = max(1, min(512, batch.num_rows * (16 << 20) // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                s = scores([t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array([x < cutoff for x in s], pa.bool_()))
        scores.clear()
        release()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes no dots in names
    return plain.mapInArrow(kept, plain.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

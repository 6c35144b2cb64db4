"""Quality rules whose cutoffs are risk-controlled.

Features of every text are taken in one pass with built-in functions. Labelled
documents are the holdout: for each stratum (language), each measure and each
cutoff of a fixed grid, the rejected good documents k of n are counted. A cutoff
may be used only if the exact binomial test says that its false-rejection rate
is below alpha / (number of measures), at level delta / (strata x measures)
(Bonferroni over strata and measures; within a measure the cutoffs are tested in
fixed order from the laxest, which needs no further correction, since k only
grows). So with confidence 1 - delta, at most alpha of the good documents of any
stratum are rejected by the method. Among the cutoffs so allowed, the one with
the largest (bad rejected - cost x good rejected) is used, if that is positive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import materialized, table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

#: Cutoffs of each measure, from the laxest to the strictest: a value above the cutoff is rejected.
GRID = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "mark_ratio": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "mean_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0],
}


def _with_repeated_words(df: DataFrame, keep: list, hashes: str) -> DataFrame:
    """n_repeat_words: words covered by the three-word windows whose hash stands at two or more places.

    Each step is a column of its own: an expression inside a lambda would be
    evaluated anew for every element.
    """
    h = F.col(hashes)
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when(F.size(F.array_distinct(h)) < F.size(h), placed).alias("__placed"))
    at = F.col("__placed")
    df = df.select(*keep, at, (F.size(at) - 1).alias("__end"))
    again = lambda x, i: (i > 0) & (F.get(at, i - 1)["h"] == x["h"]) | (i < F.col("__end")) & (F.get(at, i + 1)["h"] == x["h"])
    df = df.select(*keep, F.sort_array(F.transform(F.filter(at, again), lambda x: x["i"])).alias("__places"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("__places", start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")))["n"]
    return df.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts and the measures to `df`, whose text is `text_col`; drops the text.

    A window of three words is known by its 64-bit hash within its document.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    text = F.col("__text")
    df = df.select(*keep, text_or_empty(text_col).alias("__text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = df.select(
        *keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"), lines.alias("__lines"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("__upper"), F.regexp_count(text, F.lit("[!?]")).alias("__marks"),
    )
    words = F.col("__words")
    passed = ["n_symbols", "word_chars", "__upper", "__marks"]
    df = df.select(
        *keep, *passed, F.size(words).cast("long").alias("n_words"), F.size("__lines").alias("__n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("__windows"),
    )
    df = _with_repeated_words(df, [*keep, *passed, "n_words", "__n_lines", "n_dup_lines"], "__windows")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_ratio"), share("n_dup_lines", "__n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("__upper", "word_chars").alias("upper_ratio"), share("__marks", "n_words").alias("mark_ratio"), share("word_chars", "n_words").alias("mean_word"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exact; 1 where k >= n * rate, which no test at a level under a half can pass."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + odds)).alias("s"))
    start = F.struct(first.cast("double").alias("t"), F.exp(first).cast("double").alias("s"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.aggregate(terms, start, step)["s"])


def risk_controlled(features: DataFrame, labels: DataFrame, key: str, stratum: str, grid=GRID, alpha: float = 0.03, delta: float = 0.05, cost: float = 10.0) -> DataFrame:
    """Cutoffs by stratum: stratum, and one column for each measure, null where none may be used.

    labels: (key, quality); quality 1 is good, 0 bad, anything else unknown. Of
    repeated labels the good one counts.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(key).agg(F.max("quality").alias("quality"))
    level = lambda m, cuts: F.lit(0) if not cuts else sum(((F.col(m) > c).cast("int") for c in cuts), F.lit(0))
    judged = features.join(known, key).select(stratum, "quality", *(level(m, cuts).alias(m) for m, cuts in grid.items()))
    long = judged.unpivot([stratum, "quality"], list(grid), "measure", "level")
    # level: how many of the cutoffs, laxest first, the value exceeds
    cells = long.groupBy(stratum, "measure", "level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    sums = cells.groupBy(stratum, "measure").agg(F.sum("good").alias("n"), F.collect_list(F.struct("level", "good", "bad")).alias("cells"))  # a cell for each level at most
    sums = sums.withColumn("steps", F.element_at(F.create_map(*(x for m, cuts in grid.items() for x in (F.lit(m), F.lit(len(cuts))))), F.col("measure")))
    # a value exceeds the cutoff of an ordinal if it exceeds that many of the strictest
    over = F.col("steps") + 1 - F.col("ordinal")
    beyond = lambda what: F.aggregate(F.filter("cells", lambda c: c["level"] >= over), F.lit(0).cast("long"), lambda a, c: a + c[what])
    tried = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("ordinal")).select(stratum, "measure", "n", "ordinal", beyond("good").alias("k"), beyond("bad").alias("caught"))
    strata = features.select(stratum).distinct().count()
    tried = tried.withColumn("p", binomial_tail(F.col("n"), F.col("k"), alpha / len(grid)))
    worth = F.col("caught") - cost * F.col("k")
    allowed = tried.filter((F.col("p") * (strata * len(grid)) <= delta) & (worth > 0))
    best = allowed.groupBy(stratum, "measure").agg(F.max_by("ordinal", F.struct(worth, -F.col("ordinal"))).alias("ordinal"))
    cutoffs = F.create_map(*(x for m, cuts in grid.items() for x in (F.lit(m), F.array(*map(F.lit, cuts)))))
    return best.withColumn("cutoff", F.element_at(F.element_at(cutoffs, F.col("measure")), F.col("ordinal"))).groupBy(stratum).pivot("measure", list(grid)).agg(F.first("cutoff"))


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _rejected(cutoffs: DataFrame) -> tuple[DataFrame, Column]:
    """The cutoffs under names that clash with no others, and the condition that a measure exceeds its own."""
    named = cutoffs.select(F.col("__stratum").alias("__s"), *(F.col(m).alias(f"__cut_{m}") for m in GRID))
    over = F.lit(False)
    for m in GRID:
        over = over | F.coalesce(F.col(m) > F.col(f"__cut_{m}"), F.lit(False))
    return named, over


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **control) -> DataFrame:
    """Features and verdict of every document, one row for each input row.

    Returns `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and the measures. Null and empty texts have no words and
    fail the base. A null stratum is a stratum of its own; null ids have no label;
    repeated rows stay; without labels only the base decides; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), _stratum(f"`{stratum_col}`").alias("__stratum"), F.col(f"`{text_col}`").alias("__body"))
    features = materialized(text_features(rows, "__body"))
    cutoffs, over = _rejected(risk_controlled(features, labels.select(F.col(id_col).alias("__id"), "quality"), "__id", "__stratum", **control))
    out = features.join(cutoffs, features["__stratum"] == cutoffs["__s"], "left")
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), *GRID)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **control) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns, whatever their names.

    Features are taken once and written beside their rows, so whole rows are not
    shuffled. Null and empty texts fail the base and go; repeated rows share their
    fate; an empty table gives an empty result.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), _stratum(f"`{stratum_col}`").alias("__stratum"), F.col(f"`{text_col}`").alias("__body"))
    judged = materialized(text_features(whole, "__body"))
    cutoffs, over = _rejected(risk_controlled(judged.drop("__row"), labels.select(F.col(id_col).alias("__id"), "quality"), "__id", "__stratum", **control))
    out = judged.join(materialized(cutoffs), F.col("__stratum") == F.col("__s"), "left")
    return out.filter(~F.col("base_failed") & ~over).select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql(alpha: float = 0.03, delta: float = 0.05, cost: float = 10.0) -> str:
    """The same in DuckDB: windows by their words, the binomial tail by lgamma."""
    grid = ", ".join(f"('{m}', {i}, {c})" for m, cuts in GRID.items() for i, c in enumerate(cuts, 1))
    rate = alpha / len(GRID)
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as s, coalesce(text, '') as t from documents),
w as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from d
),
g as (select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
covered as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from twice) group by r),
f as (
  select w.r, doc_id, s, len(ws) as n_words, length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words, len(regexp_extract_all(t, '\p{{Lu}}')) as upper, len(regexp_extract_all(t, '[!?]')) as marks
  from w left join covered using (r)
),
m as (
  select r, doc_id, s, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0.0::double) as symbol_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0::double) as dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0.0::double) as repeat_ratio, coalesce(upper / nullif(word_chars, 0), 0.0::double) as upper_ratio,
    coalesce(marks / nullif(n_words, 0), 0.0::double) as mark_ratio, coalesce(word_chars / nullif(n_words, 0), 0.0::double) as mean_word
  from f
),
long as (unpivot (select r, doc_id, s, {", ".join(GRID)} from m) on {", ".join(GRID)} into name measure value v),
grid(measure, ordinal, cutoff) as (values {grid}),
known as (select doc_id, max(quality) as quality from labels where quality in (0, 1) group by doc_id),
tried as (
  select s, measure, ordinal, cutoff, count(*) filter (quality = 1) as n,
    count(*) filter (quality = 1 and v > cutoff) as k, count(*) filter (quality = 0 and v > cutoff) as caught
  from long join known using (doc_id) join grid using (measure) group by all
),
tail as (
  select s, measure, ordinal, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) as p
  from (select *, unnest(range(0, k + 1)) as i from tried where k < n * {rate}) group by all
),
best as (
  select s, measure, arg_max(cutoff, (caught - {cost} * k, -ordinal)) as cutoff
  from tried join tail using (s, measure, ordinal)
  where p * {len(GRID)} * (select count(distinct s) from m) <= {delta} and caught - {cost} * k > 0
  group by all
),
rejected as (select distinct r from long join best using (s, measure) where v > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from rejected) as kept, {", ".join(GRID)}
from m
"""


SQL = _sql()

"""Mixing sources to target weights by iterative proportional fitting.

Expected tokens of the cells (source, language, topic) are raked to the targets of
each of the three marginals in turn until they hold together. A cell can't give
more than it has: a value's factor is solved so that the capped cells, kept whole,
and the others together meet the target, and every further turn rakes under the
same caps. What a value can't give at all goes to the other values of its
dimension in proportion to their targets. A document is kept with its cell's
probability, decided by a hash of the document.

All values that the targets don't name fall into the cell `*`, so the number of
cells is bounded by the targets, and the fit is one expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import table, text_or_empty

OTHER = "*"
#: Factor of a value that is kept whole: its cells stay whole under the other dimensions' factors.
FAR = 1e6

#: Shares of tokens wanted of each value; those of other values count together under OTHER.
TARGETS = {
    "source": {f"src{i}": 0.0495 for i in range(20)} | {OTHER: 0.01},
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.14, OTHER: 0.01},
    "topic": {"tabular": 0.05, "short": 0.15, "medium": 0.4, "long": 0.4},
}
DIMENSIONS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    """Words between white space, one at least."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A text's kind: tabular if a tenth of its words are cell borders, else by its length."""
    return F.when(10 * F.regexp_count(text, F.lit(r"\|")) >= tokens, "tabular").when(tokens < 100, "short").when(tokens < 600, "medium").otherwise("long")


def _bucket(value: Column, named) -> Column:
    return F.when(value.isin(*[n for n in named if n != OTHER]), value).otherwise(F.lit(OTHER))


def with_cells(docs: DataFrame, targets=TARGETS) -> DataFrame:
    """Adds tokens, topic and the cell's three values c0, c1, c2 to rows of source, lang and text, with whatever else they hold."""
    df = docs.withColumn("tokens", tokens_of(F.col("text")))
    df = df.withColumn("topic", topic_of(F.col("text"), F.col("tokens")))
    return df.withColumns({f"c{i}": _bucket(F.col(d), targets[d]) for i, d in enumerate(DIMENSIONS)})


def _let(value: Column, use) -> Column:
    """`use` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _solved(goal: Column, cells: Column, turns: int = 10) -> Column:
    """The factor f with sum(min(f * w, t)) = goal, by Newton's steps from below; FAR where the cells whole just meet the goal, or can't."""

    def step(f: Column, _) -> Column:
        whole = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.when(f * c["w"] >= c["t"], c["t"]).otherwise(F.lit(0.0)))
        free = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.when(f * c["w"] >= c["t"], F.lit(0.0)).otherwise(c["w"]))
        return F.when(free > 0, F.greatest(f, (goal - whole) / free)).otherwise(f)

    whole = F.aggregate(cells, F.lit(0.0), lambda a, c: a + c["t"])
    return F.when(goal >= whole * (1 - 1e-12), F.lit(FAR)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(turns)), F.lit(0.0), step))


def fit_rates(celled: DataFrame, keep: float, targets=TARGETS, rounds: int = 30) -> DataFrame:
    """Probability of keeping a document of each cell: c0, c1, c2, t (its tokens), rate.

    celled: as with_cells gives it. Expected tokens are `keep` of all. Target
    shares are taken among the values that the documents have.
    """
    names = [f"c{i}" for i in range(3)]
    cells = celled.groupBy(*names).agg(F.sum("tokens").cast("double").alias("t"))
    one = cells.agg(F.array_sort(F.collect_list(F.struct(*[F.col(n).alias(f"d{i}") for i, n in enumerate(names)], "t", (F.lit(float(keep)) * F.col("t")).alias("w")))).alias("cells"), (keep * F.sum("t")).alias("goal"))

    def wanted(i: int) -> Column:
        """Tokens wanted of each value of a dimension, in proportion to the targets, but no more than there are."""
        named = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("w")) for k, v in sorted(targets[DIMENSIONS[i]].items())])
        there = F.transform(named, lambda g: F.struct(g["k"].alias("k"), g["w"].alias("w"), F.aggregate(F.filter("cells", lambda c: c[f"d{i}"] == g["k"]), F.lit(0.0), lambda a, c: a + c["t"]).alias("t")))
        share = lambda v: _let(_solved(F.col("goal"), v, 30), lambda f: F.transform(v, lambda g: F.struct(g["k"].alias("k"), F.least(g["t"], f * g["w"]).alias("v"))))
        return _let(F.filter(there, lambda g: (g["t"] > 0) & (g["w"] > 0)), share)

    def factors(a: Column, i: int) -> Column:
        """value -> factor under the cells' caps"""
        own = F.transform(a[f"v{i}"], lambda g: F.struct(g["k"].alias("k"), g["v"].alias("v"), F.filter(a["cells"], lambda c: c[f"d{i}"] == g["k"]).alias("own")))
        return F.map_from_entries(F.transform(own, lambda g: F.struct(g["k"].alias("k"), _solved(g["v"], g["own"]).alias("f"))))

    def applied(a: Column, i: int) -> Column:
        return F.transform(a["cells"], lambda c: F.struct(*[c[f"d{j}"].alias(f"d{j}") for j in range(3)], c["t"].alias("t"), F.least(c["t"] * FAR**2, c["w"] * F.coalesce(F.try_element_at(a["by"], c[f"d{i}"]), F.lit(0.0))).alias("w")))

    # each half step is one turn: the factors of a dimension are found once, then applied to every cell;
    # what every turn needs is part of the state, as an expression outside would be evaluated anew each time
    none = F.map_from_entries(F.array().cast("array<struct<k:string,f:double>>"))
    state = lambda cells, by, v: F.struct(cells.alias("cells"), by.alias("by"), *[v[i].alias(f"v{i}") for i in range(3)])

    def turn(a: Column, s: Column) -> Column:
        goals, step = [a[f"v{i}"] for i in range(3)], None
        for i in range(3):
            found, used = state(a["cells"], factors(a, i), goals), state(applied(a, i), none, goals)
            for k, what in ((2 * i, found), (2 * i + 1, used)):
                step = F.when(s % 6 == k, what) if step is None else step.when(s % 6 == k, what)
        return step

    start = state(F.col("cells"), none, [wanted(i) for i in range(3)])
    raked = one.select(F.aggregate(F.sequence(F.lit(0), F.lit(6 * rounds - 1)), start, turn)["cells"].alias("cells"))
    return raked.select(F.explode("cells").alias("c")).select(*[F.col(f"c.d{i}").alias(n) for i, n in enumerate(names)], F.col("c.t").alias("t"), F.least(F.lit(1.0), F.col("c.w") / F.col("c.t")).alias("rate"))


def _chance(seed: int, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") * F.lit(2.0**-53)


def _judged(docs: DataFrame, keep: float, targets, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows of id, source, lang, text and `more` with tokens, topic and rate. No name of the input can clash."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty(f"`{text_col}`").alias("text"), *more)
    celled = with_cells(rows, targets)
    rates = fit_rates(celled.drop("row"), keep, targets).drop("t")
    # no more rows than the product of the targets' values
    return celled.join(F.broadcast(rates), [f"c{i}" for i in range(3)])


def mix_sources(docs: DataFrame, keep: float = 0.5, targets=TARGETS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decision for every document, one row for each input row.

    Returns `id_col`, source, lang, topic, n_tokens, probability, kept. Null and
    empty texts count as one token; null sources and languages count as other
    values (`*`); a value whose target is missing or 0 under `*` as well gets
    probability 0. Repeated rows get the same decision; an empty table gives an
    empty result; other columns are ignored.
    """
    out = _judged(docs, keep, targets, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.col("rate").alias("probability"), (_chance(seed, F.col("id"), F.col("text")) < F.col("rate")).alias("kept"))


def mixing_report(docs: DataFrame, keep: float = 0.5, targets=TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the fit attains: dimension, value, target, present (share of all tokens), expected (share of the kept ones).

    A value falls short of its target only if its tokens don't suffice, alone or
    together with those of the other dimensions.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty(f"`{text_col}`").alias("text"))
    rates = fit_rates(with_cells(rows, targets), keep, targets)
    long = rates.select("t", (F.col("t") * F.col("rate")).alias("e"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"c{i}").alias("value")) for i, d in enumerate(DIMENSIONS)])).alias("x"))
    by = long.groupBy("x.dimension", "x.value").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
    total = rates.agg(F.sum("t").alias("tt"), F.sum(F.col("t") * F.col("rate")).alias("te"))  # one row
    goal = F.create_map(*[x for d in DIMENSIONS for k, v in targets[d].items() for x in (F.lit(f"{d}/{k}"), F.lit(float(v)))])
    return by.join(F.broadcast(total)).select("dimension", "value", F.try_element_at(goal, F.concat("dimension", F.lit("/"), "value")).alias("target"), (F.col("t") / F.col("tt")).alias("present"), (F.col("e") / F.col("te")).alias("expected"))


def sample_mixed(docs: DataFrame, keep: float = 0.5, targets=TARGETS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that mix_sources keeps, with all their columns, whatever their names, and without a shuffle of theirs."""
    out = _judged(docs, keep, targets, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return out.filter(_chance(seed, F.col("id"), F.col("text")) < F.col("rate")).select("row.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))

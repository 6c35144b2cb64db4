"""URL filter: longest-rule verdicts, and a path-template tree for all other urls.

The tree is kept as one row for each distinct generalised path of a host, so a
host with a third of all urls costs as many rows as it has path shapes. Level by
level, sibling branches under one parent are looked at together:

* a segment position with many, thin branches is variable: its branches become `*`;
* labelled branches whose block rate does not differ from their pooled rate by
  more than `z` standard errors are merged to `+`.

A resulting template is rejected when its smoothed share of block labels reaches
`purity`. What it is smoothed towards is the share of the same path shape over all
labelled hosts, itself smoothed towards the prior. So a host of few or no labels
is judged by what its paths mean elsewhere, once at least `min_hosts` hosts and
`min_labels` urls say so, and a host with labels of its own mostly by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import materialized, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, A-Z lower-cased, and path; both empty without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path with identifiers in its segments generalised: long hexadecimal to <h>, digits to <n>.

    Characters that mark wildcards stand percent-encoded, in letters only, so that no path looks like a template.
    """
    for mark, code in (("%", "%p"), ("*", "%s"), ("+", "%a"), ("<", "%l")):
        path = F.replace(path, F.lit(mark), F.lit(code))
    return F.regexp_replace(F.regexp_replace(path, "(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])[0-9a-f-]{16,}(?![A-Za-z0-9])", "<h>"), "[0-9]+", "<n>")


def template_tree(urls: DataFrame, levels: int = 4, fan_out: int = 20, thin: float = 5.0, z: float = 1.96, prior: float = 0.5, strength: float = 2.0, min_labels: int = 5, min_hosts: int = 3, purity: float = 0.8) -> DataFrame:
    """Templates of `urls` (host, shape, label: block, allow or null).

    Returns host, shape, template, labelled, share (smoothed share of block
    labels), rejected, one row for each host and shape. Segments beyond `levels`
    stay as their shape has them.
    """
    leaves = (
        urls.groupBy("host", "shape")
        .agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("bad"), F.count("label").alias("labelled"))
        .withColumn("segments", F.split(F.col("shape"), "/"))
        .withColumn("done", F.lit(""))
    )
    leaves = materialized(leaves)
    for level in range(2, levels + 2):  # the first segment is what stands before the first slash
        here = F.coalesce(F.try_element_at("segments", F.lit(level)), F.lit(None).cast("string"))
        leaves = leaves.withColumn("segment", here)
        branches = leaves.filter("segment is not null").groupBy("host", "done", "segment").agg(F.sum("n").alias("b_n"), F.sum("bad").alias("b_bad"), F.sum("labelled").alias("b_lab"))
        parents = branches.groupBy("host", "done").agg(F.count("*").alias("fan"), F.sum("b_n").alias("p_n"), F.sum("b_bad").alias("p_bad"), F.sum("b_lab").alias("p_lab"), F.count_if(F.col("b_lab") > 0).alias("p_labelled"))
        rate = F.col("p_bad") / F.col("p_lab")
        error = F.sqrt(F.col("b_lab") * rate * (1 - rate))
        similar = (F.col("b_lab") > 0) & (F.col("p_labelled") > 1) & (F.abs(F.col("b_bad") - F.col("b_lab") * rate) <= z * error)
        chosen = branches.join(parents, ["host", "done"]).select(
            "host", "done", "segment",
            F.when((F.col("fan") >= fan_out) & (F.col("p_n") < thin * F.col("fan")), F.lit("*")).when(F.col("p_lab").isNotNull() & (F.col("p_lab") > 0) & similar, F.lit("+")).otherwise(F.col("segment")).alias("chosen"),
        )
        leaves = leaves.join(chosen, ["host", "done", "segment"], "left")
        leaves = materialized(leaves.withColumn("done", F.when(F.col("segment").isNull(), F.col("done")).otherwise(F.concat("done", F.lit("/"), "chosen"))).drop("segment", "chosen"))
    rest = F.slice("segments", levels + 2, F.greatest(F.size("segments") - levels - 1, F.lit(0)))
    leaves = leaves.withColumn("template", F.when(F.size(rest) > 0, F.concat("done", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("done")))
    stats = leaves.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled"))
    pooled = leaves.groupBy("shape").agg(F.sum("bad").alias("s_bad"), F.sum("labelled").alias("s_labelled"), F.count_if(F.col("labelled") > 0).alias("s_hosts"))
    out = leaves.select("host", "shape", "template").join(stats, ["host", "template"]).join(pooled, "shape")
    elsewhere = (F.col("s_bad") + strength * prior) / (F.col("s_labelled") + strength)
    share = (F.col("t_bad") + strength * elsewhere) / (F.col("t_labelled") + strength)
    known = (F.col("t_labelled") >= min_labels) | (F.col("s_labelled") >= min_labels) & (F.col("s_hosts") >= min_hosts)
    return out.select("host", "shape", "template", F.col("t_labelled").alias("labelled"), share.alias("share"), (known & (share >= purity)).alias("rejected"))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **tree) -> DataFrame:
    """Verdict for every url, one row for each input row.

    labels: (url, label block or allow), of urls whose verdict is known; by
    default the urls that a rule decides are the labelled ones.
    Returns `id_col`, host, path, rule, verdict, template, share.
    Null urls and urls without :// have empty host and path and are judged by
    that empty template (allow unless labelled otherwise). Ties of a share with
    `purity` are rejected. Null ids and repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    judged = judged.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("found"), shape(F.col("path")).alias("shape"))
    if labels is None:
        known = judged.select("host", "shape", F.col("found.verdict").alias("label"))
    else:
        host, path = host_and_path(F.col("url"))
        given = labels.select(F.col("url").cast("string").alias("url"), "label").select(host.alias("host"), shape(path).alias("shape"), "label")
        known = judged.select("host", "shape", F.lit(None).cast("string").alias("label")).unionByName(given)
    tree_rows = template_tree(known, **tree)
    out = judged.join(tree_rows, ["host", "shape"], "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "share")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))

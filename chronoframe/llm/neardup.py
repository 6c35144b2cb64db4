"""Near-duplicates by DartMinHash.

A text's words form a weighted set of five-word shingles. Each shingle owns the
region [0, weight) x [0, infinity) of a plane on which hashed darts lie, K to a
unit of area; every dart has a coordinate among K and its height is its rank. The
earliest dart of each coordinate in a text's regions is its signature; two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.
The plane is read from the bottom, cell by cell, only until every coordinate has
a dart: about K log K darts, however many shingles there are.

Bands of the signature bring candidates together. A bucket is never expanded to
its pairs: each member is compared with the bucket's two hubs (its smallest and
largest text). Only where a bucket then still holds several components, members
of different components are compared, pack by pack, and what leaves are links that
join components, so no link is lost and no more rows appear than members. A pair
counts as linked if its exact similarity, over whole shingle sets, reaches the
threshold.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, materialized, table, text_or_empty

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 30
K = ROWS * BANDS
#: Signatures that agree in a smaller share are not compared with a hub at first: over four and a half standard errors below the threshold.
LIKELY = 0.66
#: Members, and bytes of their shingles, that are compared with as many others at a time, and shingles a block of the comparison.
PACK, PACK_BYTES, COLUMNS = 512, 4 << 20, 4096
WORD = re.compile(r"\w+")
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Darts:
    """The plane's cells from the bottom: lower edge, height, and chances of one, two, ... darts.

    Heights double, but a cell expects one dart at most.
    """

    MOST = 8

    def __init__(self, k: int = K):
        self.k = k
        edges = [0.0, 2.0**-14]
        while edges[-1] < 64:
            parts = max(1, int(2 ** np.ceil(np.log2(k * edges[-1]))))
            edges.extend((edges[-1] * (1 + np.arange(1, parts + 1) / parts)).tolist())
        self.low, self.height = np.array(edges[:-1]), np.diff(edges)
        rate = k * self.height
        exact = np.exp(-rate)
        tail, least = np.ones_like(rate), []
        for n in range(1, self.MOST + 1):
            tail = tail - exact
            least.append(np.clip(tail, 0, 1))
            exact = exact * rate / n
        self.least = np.array(least)  # [n - 1, cell]: chance of n darts at least
        self.seed = _mix(np.arange(1, len(self.low) + 1, dtype=U) * U(0x9E3779B97F4A7C15))

    def signature(self, elements: np.ndarray) -> np.ndarray:
        """The earliest dart of each coordinate, by its hash. elements: distinct hashes of unit regions."""
        out, filled = np.zeros(self.k, U), np.zeros(self.k, bool)
        at, reach = 0, (np.log(self.k) + 1.5) / len(elements)
        while not filled.all():
            end = max(at + 1, int(np.searchsorted(self.low, reach)))
            cells = slice(at, min(end, len(self.low)))
            hashed = _mix(elements[:, None] ^ self.seed[None, cells])
            chance = (hashed >> U(11)).astype(np.float64) * 2.0**-53
            e, c = np.nonzero(chance < self.least[0, cells][None, :])
            chance, base = chance[e, c], hashed[e, c]
            darts, where = [_mix(base + U(1))], [c]
            for n in range(1, self.MOST):
                more = np.flatnonzero(chance < self.least[n, cells][c])
                if not len(more):
                    break
                darts.append(_mix(base[more] + U(n + 1)))
                where.append(c[more])
            dart, cell = np.concatenate(darts), np.concatenate(where) + at
            coordinate = ((dart >> U(32)) % U(self.k)).astype(np.int64)
            rank = self.low[cell] + self.height[cell] * ((dart & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            order = np.lexsort((dart, rank))
            first, place = np.unique(coordinate[order], return_index=True)
            new = ~filled[first]
            out[first[new]] = dart[order[place[new]]]
            filled[first] = True
            at, reach = cells.stop, reach * 1.5
        return out


class Shingles:
    """Hashed shingles of texts; keeps the hashes of words it met lately."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.known) >= 200_000:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h

    def of(self, text: str, weighted: bool = False) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none.

        weighted: a shingle that stands n times has n unit regions, each with a hash of its own.
        """
        words = WORD.findall(text.lower())
        if not words:
            return np.zeros(0, U)
        known = self.known
        w = np.array([known.get(x) or self._word(x) for x in words], U)
        size = min(self.size, len(w))
        n = len(w) - size + 1
        h = np.full(n, size, U)
        for i in range(size):
            h = _mix(h * U(0x9E3779B97F4A7C15) + w[i : i + n])
        distinct, counts = np.unique(h, return_counts=True)
        if not weighted or counts.max() == 1:
            return distinct
        unit = np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.unique(_mix(np.repeat(distinct, counts) + unit.astype(U) * U(0xD1B54A32D192ED03)))


def _signed(docs: DataFrame, weighted: bool) -> DataFrame:
    """Per row: id, node (the text's MD5), bands (hash of each), sig (16 bits of each coordinate)."""
    darts, shingles = Darts(), Shingles()
    powers = _mix(np.arange(1, ROWS + 1, dtype=U))

    def rows(batch):
        for key, text in zip(batch["id"], batch["text"], strict=True):
            own = shingles.of(text, weighted)
            node = hashlib.md5(text.encode()).digest()
            if not len(own):
                yield key, node, [], b""
                continue
            s = darts.signature(own)
            bands = _mix((_mix(s).reshape(BANDS, ROWS) * powers).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U) * U(0xA24BAED4963EE407))
            yield key, node, bands.view(np.int64).tolist(), (s & U(0xFFFF)).astype(np.uint16).tobytes()

    def done():
        shingles.known.clear()
        return ()

    kind = dict(docs.dtypes)["id"]
    return arrow_map(docs, rows, f"id {kind}, node binary, bands array<long>, sig binary", finish=done)


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures make the threshold possible."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def rows(batch):
        for a, b, sa, sb in zip(batch["a"], batch["b"], batch["sa"], batch["sb"], strict=True):
            if (np.frombuffer(sa, np.uint16) == np.frombuffer(sb, np.uint16)).mean() >= LIKELY:
                yield a, b

    return arrow_map(both.select("a", "b", "sa", "sb"), rows, "a binary, b binary")


def _sets(nodes: DataFrame, texts: DataFrame, reps: DataFrame, weighted: bool) -> DataFrame:
    """Shingles of the nodes: node, s (sorted hashes), bytes."""
    wanted = reps.join(nodes, "node", "left_semi").select(F.col("node").alias("w"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"))
    held = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "text")
    # by id and text: of a group of copies only the representative's text is moved
    held = held.join(wanted, (held["key"] == wanted["k"]) & (held["node"] == wanted["w"]), "left_semi").select("node", "text")
    shingles = Shingles()

    def hashed(batch):
        for node, text in zip(batch["node"], batch["text"], strict=True):
            s = shingles.of(text, weighted).tobytes()
            yield node, s, len(s)

    def done():
        shingles.known.clear()
        return ()

    hashed_ = arrow_map(held, hashed, "node binary, s binary, bytes long", finish=done)
    return hashed_.groupBy("node").agg(F.any_value("s").alias("s"), F.any_value("bytes").alias("bytes"))  # rows that repeat whole


def _star_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a hub, b member) whose exact similarity reaches the threshold.

    A hub's members are dealt to packs by a salt, so many that all sets together
    would give PACK_BYTES to each; a pack meets its hub's set once.
    """
    total = sets.agg(F.sum("bytes")).first()[0] or 0
    salt = F.pmod(F.xxhash64("b"), F.lit(int(total // PACK_BYTES) + 1)).alias("salt")
    dealt = pairs.select("a", "b", salt)
    members = dealt.join(sets.select(F.col("node").alias("b"), "s"), "b").groupBy("a", "salt").agg(F.collect_list(F.struct("b", "s")).alias("members"))
    hubs = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("s").alias("hub")), "a")

    def rows(batch):
        for a, hub, members in zip(batch["a"], batch["hub"], batch["members"], strict=True):
            x = np.frombuffer(hub, U)
            for m in members:
                y = np.frombuffer(m["s"], U)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if common >= threshold * (len(x) + len(y) - common):
                    yield a, m["b"]

    return arrow_map(members.join(hubs, ["a", "salt"]).select("a", "hub", "members"), rows, "a binary, b binary", batch_rows=16)


def joining_links(a: list[dict], b: list[dict], threshold: float, same: bool):
    """Links between members (node, label, s) of two packs, or within one, that join components: fewer than labels.

    All similarities across labels are found exactly, as products of incidence
    matrices, a block of COLUMNS shingles at a time.
    """
    everyone = a if same else a + b
    names = {label: i for i, label in enumerate(dict.fromkeys(m["label"] for m in everyone))}
    if len(names) < 2:
        return
    label = np.array([names[m["label"]] for m in everyone])
    sets = [np.frombuffer(m["s"], U) for m in everyone]
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    column, row = place[column], np.repeat(np.arange(len(everyone)), size)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, first = len(a), 0 if same else len(a)
    common = np.zeros((n, len(everyone) - first), np.float32)
    edges = np.searchsorted(column, np.arange(0, len(often) + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        x = np.zeros((len(everyone), COLUMNS), np.float32)
        x[row[lo:hi], column[lo:hi] - k * COLUMNS] = 1
        common += x[:n] @ x[first:].T
    both = size[:n, None] + size[None, first:] - common.astype(np.float64)
    linked = (common >= threshold * both) & (label[:n, None] != label[None, first:])
    i, j = np.nonzero(np.triu(linked) if same else linked)
    j = j + first
    _, one = np.unique(label[i] * len(names) + label[j], return_index=True)
    root = list(range(len(names)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in one:
        x, y = top(label[i[k]]), top(label[j[k]])
        if x != y:
            root[x] = y
            yield everyone[i[k]]["node"], everyone[j[k]]["node"]


def _across(shared: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join different components of buckets which still hold several.

    Such open buckets that share members form a block. A block's members are
    packed, at most about PACK members and PACK_BYTES to a row, every pack is
    compared with itself and with the block's other packs, and only links that
    join components leave. Each pair of packs is a join key of its own.
    """
    inside = shared.join(labels, "node", "left").select("bucket", "low", "node", F.coalesce("label", "node").alias("label"))
    split = inside.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bucket")
    open_ = materialized(inside.join(split, "bucket", "left_semi"))
    if open_.isEmpty():
        return open_.select(F.col("low").alias("a"), F.col("node").alias("b"))
    blocks = components(open_.select(F.col("low").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()).withColumnRenamed("label", "block")
    # packs are planned on rows without sets, which then go where their pack is
    members = materialized(open_.select("node", "label").distinct().join(blocks, "node").join(sets.select("node", "bytes"), "node"))
    sizes = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / PACK, F.sum("bytes") / PACK_BYTES)).alias("chunks"))
    dealt = members.join(sizes, "block").select("node", "label", "block", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"))
    whole = dealt.join(sets.select("node", "s"), "node").repartition("block", "chunk")
    packs = materialized(whole.groupBy("block", "chunk").agg(F.any_value("chunks").alias("chunks"), F.collect_list(F.struct("node", "label", "s")).alias("a")))

    def within(batch):
        for a in batch["a"]:
            yield from joining_links(a, a, threshold, True)

    def between(batch):
        for a, b in zip(batch["a"], batch["b"], strict=True):
            yield from joining_links(a, b, threshold, False)

    several = packs.filter("chunks > 1")
    left = several.filter("chunk < chunks - 1").select("block", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("j"), "a")
    right = several.filter("chunk > 0").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk") - 1)).alias("i"), F.col("chunk").alias("j"), F.col("a").alias("b"))
    alone = arrow_map(packs.select("a"), within, "a binary, b binary", batch_rows=4)
    return alone.union(arrow_map(left.join(right, ["block", "i", "j"]).select("a", "b"), between, "a binary, b binary", batch_rows=1))


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of the links (a, b).

    Every round points each node to the smallest of its neighbours and itself, then
    once more, and contracts the links: their ends become where they point, loops
    and repeats go. So the links shrink from round to round until none is left.
    """

    def plain(df):
        return materialized(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())

    edges, labels = plain(links), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialized(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")))
        further = near.select(F.col("node").alias("via"), F.col("to").alias("end"))
        step = materialized(near.join(further, F.col("to") == F.col("via")).select("node", F.col("end").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.filter("node <> to").select(F.col("node").alias("via"), "to")
            labels = materialized(labels.join(moved, F.col("label") == F.col("via"), "left").select("node", F.coalesce("to", "label").alias("label")))
        ends = lambda c, n: step.select(F.col("node").alias(f"at_{c}"), F.col("to").alias(n))  # noqa: E731, B023
        edges = plain(edges.join(ends("a", "x"), F.col("a") == F.col("at_a")).join(ends("b", "y"), F.col("b") == F.col("at_b")).select(F.col("x").alias("a"), F.col("y").alias("b")))
        if edges.isEmpty():
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """Per row: id, node; per node: n, label (of its class), class_id, id (the node's smallest)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    signed = materialized(_signed(texts, weighted))
    reps = signed.groupBy("node").agg(F.min("id").alias("id"))
    sigs = signed.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))  # copies count once
    placed = sigs.select("node", F.explode("bands").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    shared = materialized(placed.join(hubs, "bucket"))
    members = shared.select("node").distinct()
    sigs = materialized(sigs.select("node", "sig").join(members, "node", "left_semi"))
    sets = materialized(_sets(members, texts, reps, weighted))
    star = shared.select(F.col("low").alias("a"), F.col("node").alias("b")).union(shared.select(F.col("high").alias("a"), F.col("node").alias("b"))).filter("a <> b").distinct()
    links = materialized(_star_links(materialized(_likely(star, sigs)), sets, threshold))
    labels = components(links)
    more = materialized(_across(shared, labels, sets, threshold))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = reps.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("id").alias("class_id"))
    return signed.select("id", "node"), named.join(smallest, "label").select(F.col("node").alias("n"), "label", "class_id", F.col("id").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """Class of every document, one row for each input row: `id_col`, class_id.

    Documents are linked if the weighted Jaccard similarity of their five-word
    shingles, each weighing how often it stands in the text, is `threshold` or
    more (weighted=False: each weighs one). Words are runs of letters, digits and
    underscores in lower case. Classes are the connected components, equal texts
    included; class_id is the smallest id of the class. Texts without words,
    null among them, are linked only to equal ones, null counting as empty. A
    null id is a class_id only if the class has no other. Repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    signed, by_node = _classes(docs, id_col, text_col, threshold, weighted)
    return signed.join(by_node, F.col("node") == F.col("n")).select(F.col("id").alias(id_col), "class_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """One document of each class, the one of the smallest id, with all its columns, whatever their names.

    Rows without an id stay only where no other row of their class has one. A row
    is known by its id and text, so different texts under one id, or without id,
    are documents of their own; of several texts of the class's smallest id the
    one of the smallest hash stays. Equal rows become one. An empty table gives
    an empty result.
    """
    signed, by_node = _classes(docs, id_col, text_col, threshold, weighted)
    first = by_node.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "n")).alias("x"))
    kept = materialized(first.select(F.col("x.n").alias("k_node"), F.col("x.least").alias("k_id")))
    node = F.unhex(F.md5(text_or_empty(f"`{text_col}`").cast("binary")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), node.alias("node"))
    held = (F.col("node") == F.col("k_node")) & F.col("id").eqNullSafe(F.col("k_id"))
    out = whole.join(kept, held, "left_semi")
    if not signed.join(kept, held, "left_semi").groupBy("node").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["node"])
    return out.select("row.*")


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

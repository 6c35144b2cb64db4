"""Token counts: pieces are counted once for each distinct pre-token.

The distinct pre-tokens of the corpus get their number of pieces in one table.
Its `hot` most frequent rows, a bounded number, travel to the documents; every
other pre-token is rare and is joined by shuffling, as (document, pre-token,
frequency). Ids are never made.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import Counter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.bpe import byte_alphabet
from chronoframe.llm.common import arrow_map, materialized, table, text_or_empty

#: Distinct pre-tokens that a task holds before it hands its counts on.
HELD = 200_000


#: Characters beyond these are left to the library: Unicode versions differ there.
UNUSUAL = regex.compile("[^\\x00-\\u052f\\u1e00-\\u20bf\\u2100-\\u214f\\u3000-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7a3\\uff00-\\uffef]")


class PreTokens:
    """Pre-tokens of a text as the vocabulary file's normalizer and pre-tokenizer give them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.byte = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        split = next(p for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s of the file's dialect is the Unicode property
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")).findall
        specials = sorted((x["content"] for x in held["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials)))

    def counts(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens with their frequencies, and the number of special strings."""
        parts = self.special.split(text)
        found: Counter = Counter()
        for part in parts:
            if UNUSUAL.search(part):
                shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                found.update(bytes(self.byte[c] for c in token).decode() for token, _ in shown)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower() of a word's last sigma depends on its place
            found.update(self.find(part.lower()))
        return found, len(parts) - 1


@functools.cache
def pre_tokens(path: str) -> PreTokens:
    """One for each vocabulary file and Python worker."""
    return PreTokens(path)


@functools.cache
def piece_counter(path: str):
    """Function from pre-tokens to their numbers of pieces."""
    from tokenizers import Tokenizer

    shown = {b: c for c, b in byte_alphabet().items()}
    model = Tokenizer.from_file(path).model
    return lambda token: len(model.tokenize("".join([shown[b] for b in token.encode()])))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, hot: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, one row for each input row.

    Returns `id_col`, n_bytes, n_tokens, over_limit. Null and empty texts have no
    bytes and no tokens. Null ids and repeated rows stay apart; an empty table
    gives an empty result; columns not named are ignored. `path` must be readable
    on every executor. `hot` bounds what is broadcast and changes no result.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    seen: Counter = Counter()

    def handed_on():
        out = list(seen.items())
        seen.clear()
        return out

    def tally(batch):
        pre = pre_tokens(path)
        for text in batch["text"]:
            seen.update(pre.counts(text)[0])
            if len(seen) >= HELD:
                yield from handed_on()

    def sized(batch):
        count = piece_counter(path)
        for token, n in zip(batch["token"], batch["n"], strict=True):
            yield token, n, count(token)

    distinct = arrow_map(texts.select("text"), tally, "token string, n long", finish=handed_on).groupBy("token").agg(F.sum("n").alias("n"))
    pieces = materialized(arrow_map(distinct, sized, "token string, n long, pieces int"))
    top = pieces.orderBy(F.desc("n"), "token").limit(hot).select("token", "pieces").toArrow().to_pydict()
    common = dict(zip(top["token"], top["pieces"], strict=True))

    def weigh(batch):
        pre = pre_tokens(path)
        for row, key, text in zip(batch["row"], batch["id"], batch["text"], strict=True):
            found, total = pre.counts(text)
            for token, n in found.items():
                if (k := common.get(token)) is None:
                    yield row, None, None, n, token
                else:
                    total += n * k
            # the document's own row: its token holds a NUL and digits, which no pre-token does
            yield row, key, len(text.encode()), total, f"\0{row % 65536}"

    kind = docs.schema[id_col].dataType.simpleString()
    parts = arrow_map(texts.withColumn("row", F.monotonically_increasing_id()), weigh, f"row long, id {kind}, n_bytes long, n long, token string")
    joined = parts.join(pieces.select("token", "pieces"), "token", "left")
    sums = joined.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return sums.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

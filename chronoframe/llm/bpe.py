"""Byte-pair encoding and decoding as streaming transducers.

Encoding. The last token of the encoding of a prefix is unique, and dropping it
gives the encoding of a shorter prefix. So the encoder keeps, for each recent
position, the last token of the prefix that ends there. A token t may follow a
token s exactly if no merge ever crosses the border between them, which their own
merge trees tell. Tokens are emitted once every position from which a later token may still start agrees
on them. The merge list bounds how far that takes: a merge can be undone only by
a merge of lower rank that takes its right part, that one only by one of yet
lower rank, and so on. `lookahead` is the longest such chain in bytes.

Decoding. Tokens become bytes, and a UTF-8 state machine turns bytes to text as
they come, keeping only an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import arrow_map, table, text_or_empty

#: Fixed value: the pre-tokenizer of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary, as character -> byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list over bytes: token bytes, ranks, and the lookahead that suffices."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int]):
        self.ids = tokens
        self.specials = specials
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: s.encode() for s, i in specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((tokens[a], tokens[b]), r)
        self.joined = {(tokens[a], tokens[b]): tokens[a + b] for a, b in merges}
        self.endings = {t[i:] for t in tokens for i in range(len(t))}
        self.beginnings = {t[:i] for t in tokens for i in range(1, len(t))}
        self.longest = max(map(len, tokens))
        self.lookahead = self._lookahead(merges) + self.longest
        self.tree: dict[int, tuple[int, int, int] | None] = {}
        self.follow: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte = byte_alphabet()
        raw = lambda t: bytes(byte[c] for c in t)
        specials = {x["content"]: x["id"] for x in held["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in held["model"]["merges"]]
        return cls({raw(t): i for t, i in held["model"]["vocab"].items() if t not in specials}, [(raw(a), raw(b)) for a, b in pairs], specials)

    @staticmethod
    def _lookahead(merges: list[tuple[bytes, bytes]]) -> int:
        """Bytes of the longest chain of merges of falling rank, each taking the right part of the one before."""
        from_left: dict[bytes, int] = {}
        most = 0
        for left, right in merges:
            reach = len(right) + from_left.get(right, 0)
            from_left[left] = max(from_left.get(left, 0), reach)
            most = max(most, reach)
        return most

    def split(self, token: int) -> tuple[int, int, int] | None:
        """Rank, left and right part of the merge that makes the token of its own bytes.

        (-1, token, token) for a byte; None if its bytes encode to anything else.
        """
        if token not in self.tree:
            parts = [self.ids[bytes([b])] for b in self.bytes_of[token]]
            made = (-1, token, token)
            while len(parts) > 1:
                rank, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 60:
                    break
                made = (rank, parts[at], parts[at + 1])
                parts[at : at + 2] = [self.joined[made[1:]]]
            self.tree[token] = made if parts == [token] else None
        return self.tree[token]

    def follows(self, before: int, token: int) -> bool:
        """No merge crosses the border of the two tokens.

        The border is followed back through time: of the two merges that made the
        parts at its sides, the later is undone first; a crossing merge must have
        come before it to count. Of equal ranks the left one came first.
        """
        left, right, until = before, token, 1 << 60
        while True:
            if self.rank.get((left, right), 1 << 60) < until:
                return False
            a, b = self.split(left), self.split(right)
            if a[0] > b[0]:
                until, left = a[0], a[2]
            elif b[0] >= 0:
                until, right = b[0] + 1, b[1]
            else:
                return True


class Transducer:
    """Encoder of one pre-token whose bytes come in pieces."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.data = b""  # bytes from the first token that isn't emitted yet
        self.last: list[int] = [-1]  # last token of the prefix that ends at each position; first, the token emitted last
        self.size: list[int] = [0]  # and its length
        self.held = 0  # most bytes ever kept

    def feed(self, piece: bytes) -> Iterator[int]:
        step = self.merges.lookahead
        for at in range(0, len(piece), step):
            self._read(piece[at : at + step])
            if len(self.data) > 2 * step:
                yield from self._emit()

    def _read(self, piece: bytes) -> None:
        m = self.merges
        ids, endings, follow, longest = m.ids, m.endings, m.follow, m.longest
        begin = len(self.data)
        self.data = data = self.data + piece
        self.held = max(self.held, len(data))
        last, size = self.last, self.size
        for end in range(begin + 1, len(data) + 1):
            found = []
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                part = data[start:end]
                if (token := ids.get(part)) is not None:
                    found.append((token, start))
                elif part not in endings:
                    break
            for token, start in reversed(found):
                before = last[start]
                known = follow.get((before, token))
                if known is None:
                    if len(follow) >= 1 << 19:
                        follow.clear()
                    known = follow[before, token] = m.split(token) is not None and (before < 0 or m.follows(before, token))
                if known:
                    last.append(token)
                    size.append(end - start)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int) -> list[int]:
        """Token ends from `end` back to the first."""
        ends = []
        while end:
            ends.append(end)
            end -= self.size[end]
        return ends

    def _emit(self) -> Iterator[int]:
        """Emit what all positions agree on from which a later token may start."""
        end = len(self.data)
        agreed = set(self._path(end))
        for start in range(max(1, end - self.merges.longest), end):
            if self.data[start:end] in self.merges.beginnings:
                agreed.intersection_update(self._path(start))
        if agreed:
            stop = max(agreed)
            yield from self._tokens(stop)
            self.data = self.data[stop:]
            del self.last[:stop], self.size[:stop]
            self.size[0] = 0

    def _tokens(self, stop: int) -> list[int]:
        return [self.last[end] for end in reversed(self._path(stop))]

    def finish(self) -> list[int]:
        out = self._tokens(len(self.data))
        self.data, self.last, self.size = b"", [-1], [0]
        return out


class _Known(dict):
    """Encoded pre-tokens seen lately, as packed little-endian 32-bit ids.

    Two generations of `most` at most: what is met again moves to the new one.
    """

    def __init__(self, merges: Merges, most: int, longest: int):
        self.merges, self.most, self.longest = merges, most, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            run = Transducer(self.merges)
            ids = array("I", run.feed(piece.encode()))
            ids.extend(run.finish())
            packed = ids.tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Text to ids. Special strings inside a text become their own ids."""

    def __init__(self, merges: Merges, known: int = 300_000):
        self.merges = merges
        self.known = _Known(merges, known, 64)
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True))) + ")") if merges.specials else None

    def pieces(self, text: str, block: int = 1 << 16) -> Iterator[bytes]:
        """Packed ids, some pre-tokens at a time; a text is never held as ids in whole."""
        for i, part in enumerate(self.special.split(text)) if self.special else ((0, text),):
            if i % 2:
                yield self.merges.specials[part].to_bytes(4, "little")
            elif len(part) <= block:
                yield b"".join(map(self.known.__getitem__, self.pre_token.findall(part)))
            else:
                for found in self.pre_token.finditer(part):
                    yield self.known[found[0]]


class Decoder:
    """Ids to text as they come; invalid bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Merges.load(path))
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again, one row for each input row.

    Returns `id_col`, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256, unless `with_ids` is false ids and decoded,
    and the columns `keep`. Null and empty texts have no tokens and an empty decoded text. Null
    ids and repeated rows stay; an empty table gives an empty result; columns not
    named are ignored. `path` must be readable on every executor.
    """

    def rows(batch):
        enc = encoder(path)
        for key, *kept_on, text in zip(batch["id"], *(batch[f"keep{i}"] for i in range(len(keep))), batch["text"], strict=True):
            coded, plain, dec, n, kept, shown = hashlib.sha256(), hashlib.sha256(), Decoder(enc.merges), 0, [], []
            for packed in enc.pieces(text):
                ids = array("I", packed)
                n += len(ids)
                coded.update(packed)
                plain.update((part := dec.feed(ids)).encode())
                if with_ids:
                    kept.extend(ids)
                    shown.append(part)
            plain.update((part := dec.finish()).encode())
            yield (key, n, coded.hexdigest(), plain.hexdigest(), *((kept, "".join(shown) + part) if with_ids else ()), *kept_on)

    kind = lambda c: docs.schema[c].dataType.simpleString()
    schema = f"id {kind(id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids + "".join(f", keep{i} {kind(c)}" for i, c in enumerate(keep))
    given = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), text_or_empty(text_col).alias("text"))
    out = arrow_map(given, rows, schema)
    return out.toDF(id_col, *out.columns[1 : len(out.columns) - len(keep)], *keep)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)

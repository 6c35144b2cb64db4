"""Hashes that place series: FNV-1a shards and the consistent-hash ring."""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a32(text: Column) -> Column:
    """FNV-1a, 32 bits, of an ASCII string, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, 1)).cast("long"))
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<long>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * F.lit(16777619) % F.lit(1 << 32))


def shard(name: Column, shards: int) -> Column:
    return (fnv1a32(name) % shards).cast("int")


def ring_hash(key: Column) -> Column:
    """The first four bytes of SHA-256, big-endian."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")


class Ring:
    """Nodes at `virtual` places each; a key belongs to the next distinct nodes on the ring."""

    def __init__(self, nodes, virtual: int = 256):
        virtual = virtual if virtual > 0 else 256
        self.nodes = list(dict.fromkeys(nodes))
        self.places = sorted((self.hash(f"{n}-{i}"), n) for n in self.nodes for i in range(virtual))

    @staticmethod
    def hash(key: str) -> int:
        return int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "big")

    def owners(self, key: str, n: int = 1) -> list[str]:
        if not self.places:
            return []
        at = bisect.bisect_left(self.places, (self.hash(key), ""))
        found: dict[str, None] = {}
        for i in range(len(self.places)):
            found[self.places[(at + i) % len(self.places)][1]] = None
            if len(found) >= min(n, len(self.nodes)):
                break
        return list(found)

    def owner_column(self, key: Column) -> Column:
        """The key's first owner as an expression: a search in an array as long as the ring, which nodes bound."""
        hashes = F.array(*[F.lit(h).cast("long") for h, _ in self.places])
        names = F.array(*[F.lit(n) for _, n in self.places])
        below = F.size(F.filter(hashes, lambda h: h < ring_hash(key)))
        return F.element_at(names, F.when(below < len(self.places), below + 1).otherwise(F.lit(1)).cast("int"))

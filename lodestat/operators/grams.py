"""Word n-grams of many texts as digests, in Arrow batches: digests, bitmaps of them, and how many of a set of
digests another set has."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bitmap has 2 ** BITS bits, 8 MB, whatever the number of digests. With very many of them it lets more pass, which
#: costs shuffle only. CHUNK: its bytes per line.
BITS, CHUNK = 26, 4096
#: Bits of a digest in a bitmap: a digest that isn't there passes only if all of them are set by others. The numbers
#: mix its first half for each of them.
PROBES = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Capital letters that Spark's `lower` knows and Python's may not yet, and the small ones;
#: how their bytes begin.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {n: n + 32 for n in range(0x10D50, 0x10D66)}
_NEWER = sorted({chr(n).encode()[:-1] for n in _LOWER})
#: Words remembered by a task.
_WORDS = 500_000
#: Sets of the one and of the other side that meet in a task, at most.
MEET = 65_536


class _Places(dict):
    """Places of the words seen, and their digests one after the other."""

    def __init__(self):
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.raw += hashlib.blake2b(word, digest_size=16).digest()
        return i


def split_words(text: str | None) -> list[bytes]:
    """The words of the normalised text (functions.text.normalize_text), as UTF-8."""
    if not text:
        return []
    if text.isascii():
        return text.lower().encode().split()
    raw = unicodedata.normalize("NFKC", text).replace("Σ", "σ").lower().encode("utf-8", "surrogatepass")
    if any(x in raw for x in _NEWER):
        raw = raw.decode("utf-8", "surrogatepass").translate(_LOWER).encode("utf-8", "surrogatepass")
    return raw.split()


class Grams(NamedTuple):
    """Distinct word n-grams of texts: the text each belongs to, the first number of its digest, and a function
    that gives the whole digests (two numbers) of some of them."""

    owner: np.ndarray
    first: np.ndarray
    whole: Callable[[np.ndarray], np.ndarray]


class Digests:
    """Digests of 16 bytes (two numbers) of the word n-grams of texts: sums of digests of the words, times an odd number
    for each place."""

    def __init__(self, n: int):
        self.n = n
        raw = b"".join(hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(n))
        self.factors = np.frombuffer(raw, np.uint64).reshape(n, 2) | np.uint64(1)
        self.places = _Places()

    def of(self, texts: list[str | None]) -> Grams:
        """The distinct n-grams of each text, in the order of the texts."""
        if len(self.places) > _WORDS:
            self.places = _Places()
        split = [split_words(t) for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        table = np.frombuffer(bytes(self.places.raw), np.uint64).reshape(-1, 2)
        grams = np.maximum(size - self.n + 1, 0)
        owner = np.repeat(np.arange(len(texts)), grams)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(np.cumsum(size) - size, grams)
        if not len(owner):
            return Grams(owner, np.empty(0, np.uint64), lambda i: np.empty((0, 2), np.uint64))
        one = table[:, 0][at]
        sums = one[: len(at) - self.n + 1] * self.factors[0, 0]
        for j in range(1, self.n):
            sums += one[j : len(at) - self.n + 1 + j] * self.factors[j, 0]
        first = sums[start]

        def whole(i: np.ndarray) -> np.ndarray:
            return np.column_stack([first[i], sum(table[at[start[i] + j], 1] * self.factors[j, 1] for j in range(self.n))])

        # one number for text and digest finds what may be equal, the whole digests say what is
        mixed = first + owner.astype(np.uint64) * _MIX[0]
        by = np.argsort(mixed)
        equal = np.flatnonzero(mixed[by[1:]] == mixed[by[:-1]])
        a, b = by[equal], by[equal + 1]
        if (owner[a] == owner[b]).all() and (whole(a) == whole(b)).all():
            keep = np.ones(len(owner), bool)
            keep[b] = False
            kept = np.flatnonzero(keep)
        else:
            h = whole(np.arange(len(owner)))
            by = np.lexsort((h[:, 1], h[:, 0], owner))
            new = np.ones(len(owner), bool)
            new[1:] = (owner[by[1:]] != owner[by[:-1]]) | (h[by[1:]] != h[by[:-1]]).any(axis=1)
            kept = np.sort(by[new])
        return Grams(owner[kept], first[kept], lambda i: whole(kept[i]))


def _bits(first: np.ndarray, probe: int) -> np.ndarray:
    return (first * _MIX[probe] >> np.uint64(64 - BITS)).astype(np.int64)


def passing(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which digests, by their first numbers, a bitmap lets pass: those that have all their bits there."""
    some = np.arange(len(first))
    for probe in range(PROBES):
        at = _bits(first[some], probe)
        some = some[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
    return some


def _bitmap(df: DataFrame, digests: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> bytes:
    """The bitmap of all digests of which a function gives the first numbers, for the batches of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = digests(), np.zeros(1 << (BITS - 3), np.uint8)
        for b in batches:
            first = of(b)
            for probe in range(PROBES):
                at = _bits(first, probe)
                np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        lines = out.reshape(-1, CHUNK)
        some = np.flatnonzero(lines.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([lines[i].tobytes() for i in part], pa.binary())], ["line", "bits"])

    got = df.mapInArrow(run, "line int, bits binary").groupBy("line").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = np.zeros((1 << (BITS - 3)) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for r in got.collect():  # 2 ** (BITS - 15) lines at most
        out[r["line"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def bitmap_of_texts(texts: DataFrame, n: int) -> bytes:
    """Of a table with the one column of texts: the bitmap of their n-grams."""

    def digests() -> Callable[[pa.RecordBatch], np.ndarray]:
        d = Digests(n)
        return lambda b: d.of(b.column(0).to_pylist()).first

    return _bitmap(texts, digests)


def bitmap_of_sets(sets: DataFrame) -> bytes:
    """Of a table with the one column of sets of digests: the bitmap of these."""
    return _bitmap(sets, lambda: lambda b: np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)[::2])


def digest_sets(df: DataFrame, key: str, text: str, n: int, wanted: bytes) -> DataFrame:
    """(key, n_grams, hits): the number of distinct n-grams of a text, and the digests of those that may be wanted, sorted
    and one after the other. Words are those of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, bits = Digests(n), np.frombuffer(wanted, np.uint8)
        for b in batches:
            grams = d.of(b.column(1).to_pylist())
            hit = passing(bits, grams.first)
            h, of = grams.whole(hit), grams.owner[hit]
            h = h[np.lexsort((h[:, 1], h[:, 0], of))]
            ends = np.zeros(len(b) + 1, np.int32)
            np.cumsum(16 * np.bincount(of, minlength=len(b)), out=ends[1:])
            hits = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(grams.owner, minlength=len(b)), pa.int64()), hits], [key, "n_grams", "hits"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_grams bigint, hits binary")


def members(hits: str) -> Column:
    """The digests of a set, as an array."""
    return F.transform(F.sequence(F.lit(0), (F.length(hits) / 16).cast("int") - 1), lambda i: F.substring(F.col(hits), i * 16 + 1, F.lit(16)))


def most_shared(sets: DataFrame, others: DataFrame) -> DataFrame:
    """(cls, best): of each of the distinct sets (cls, hits) the largest number of members that one of the distinct
    others (hits) has. Blocks of sets meet blocks of others, each of at most MEET; a task holds the members of one
    block of others and gives a line per set, so shared members never become rows."""
    n, m = sets.count(), others.count()
    cores = sets.sparkSession.sparkContext.defaultParallelism
    rows, cols = max(-(-n // MEET), min(2 * cores, -(-n // 256)), 1), max(-(-m // MEET), 1)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda k: F.pmod(F.xxhash64("hits"), F.lit(k)).cast("int")
    a = sets.select("cls", "hits", block(rows).alias("i"), every(cols).alias("j"))
    b = others.select("hits", every(rows).alias("i"), block(cols).alias("j"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        where: dict[bytes, list[int]] = {}
        for i, s in enumerate(y["hits"]):
            for k in range(0, len(s), 16):
                where.setdefault(s[k : k + 16], []).append(i)
        lists = {g: np.array(v, np.int32) for g, v in where.items()}
        best = []
        for s in x["hits"]:
            found = [lists[g] for k in range(0, len(s), 16) if (g := s[k : k + 16]) in lists]
            best.append(len(found) if len(found) < 2 else int(np.bincount(np.concatenate(found)).max()))
        return pd.DataFrame({"cls": list(x["cls"]), "best": best})

    per = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(meet, "cls binary, best bigint")
    return per.groupBy("cls").agg(F.max("best").alias("best"))

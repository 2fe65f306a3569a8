"""Token counts under a public vocabulary (problem 1; sizes for problems 8 and 9).

Two counts per text. `longest_match`: the text is cut by the tokenizer's pattern and each piece is
covered from left to right with the longest vocabulary entries; a trie with failure links, each with
the precomputed number of tokens emitted on the way, gives that count in one pass without going back.
`merges`: what the byte-pair merges of the same vocabulary give, the tokenizer's own count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default vocabulary, by file name; the folder is found by vocabulary_path.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern with which the rank files' tokenizers cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """A full path is used as it is; a bare file name is looked for beside the installed vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class LongestMatch:
    """Trie over bytes with failure links.

    A node is a prefix of some entry. `link[node]`, `emits[node]`: after covering the prefix greedily
    by `emits` entries, what is left uncovered is the prefix of node `link`. An entry's own node emits
    itself and links to the root. With every single byte in the vocabulary no text is without cover;
    otherwise a byte that cannot be covered counts as one token of its own.
    """

    def __init__(self, entries):
        step: dict[int, int] = {}
        entry_at, parent, last = [False], [0], [0]
        for e in sorted(entries):
            if not e:
                continue
            node = 0
            for c in e:
                nxt = step.get(node << 8 | c)
                if nxt is None:
                    nxt = step[node << 8 | c] = len(entry_at)
                    entry_at.append(False)
                    parent.append(node)
                    last.append(c)
                node = nxt
            entry_at[node] = True
        n = len(entry_at)
        link, emits = [0] * n, [0] * n
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(1, n), key=depth.__getitem__):  # shorter prefixes first
            if entry_at[v]:
                link[v], emits[v] = 0, 1
                continue
            u, c = parent[v], last[v]
            if u == 0:
                link[v], emits[v] = 0, 1  # a byte that is no entry
                continue
            got, z = emits[u], link[u]
            while z and (z << 8 | c) not in step:
                got += emits[z]
                z = link[z]
            nxt = step.get(z << 8 | c)
            if nxt is None:
                link[v], emits[v] = 0, got + 1
            else:
                link[v], emits[v] = nxt, got
        self.step, self.link, self.emits = step, link, emits

    def count(self, text: bytes) -> int:
        step, link, emits = self.step.get, self.link, self.emits
        node = total = 0
        for c in text:
            nxt = step(node << 8 | c)
            while nxt is None:
                if not node:
                    total += 1
                    break
                total += emits[node]
                node = link[node]
                nxt = step(node << 8 | c)
            else:
                node = nxt
        while node:
            total += emits[node]
            node = link[node]
        return total


class Counter:
    """Both counts of texts; a worker keeps one per vocabulary file."""

    _kept: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.match = LongestMatch(ranks)
        import tiktoken

        self.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def longest(self, text: str) -> int:
        known, total = self.known, 0
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                n = self.match.count(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = n
            total += n
        return total

    def merges(self, text: str) -> int:
        return len(self.enc.encode_ordinary(text))


def with_token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY, longest: str | None = "tokens", merges: str | None = None, drop_text: bool = True) -> DataFrame:
    """Adds the counts of a string column; no shuffle. A null text counts 0, as an empty one does.
    A column that already has the name of a count is replaced.

    The vocabulary file must be at the same path on every executor; it is never shipped.
    """
    path = vocabulary_path(vocabulary)
    names = [n for n in (longest, merges) if n]
    rest = [c for c in df.columns if (c != text or not drop_text) and c not in names]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter.of(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            cols = [b.column(i) for i in range(len(rest))]
            for name, count in ((longest, c.longest), (merges, c.merges)):
                if name:
                    cols.append(pa.array([count(t) if t else 0 for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, rest + names)

    return df.select(*rest, F.col(text).alias("__text")).mapInArrow(run, schema)


def budget(items: DataFrame, by: list[str]) -> DataFrame:
    """Totals per combination of `by`: items, items with text, characters, tokens. Partial sums are
    made before the one shuffle, so a slice with most of the rows is no bottleneck."""
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count(F.when(F.col("tokens") > 0, 1)).alias("n_with_text"),
        F.sum("chars").alias("chars"),
        F.sum("tokens").alias("tokens"),
        F.sum("merge_tokens").alias("merge_tokens"),
    )

"""Nested JSON texts into linked flat rows, by structural indexing.

A batch of texts is one byte buffer. Bitmaps of quotes (without escaped ones), brackets and
delimiters are made for the whole buffer at once, string spans follow from the running quote parity,
nesting depth from the running sum of brackets, and members, array places and parents from sorting
tokens by depth. Only spans on the wanted paths are cut out and decoded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COMMA, _COLON, _STR, _ATOM = range(1, 9)
_KIND = np.zeros(256, np.uint8)
for _c, _k in zip(b"{}[],:", (_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COMMA, _COLON)):
    _KIND[_c] = _k
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_ESC = np.zeros(256, bool)
_ESC[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_NUMBER = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\Z")
_WORDS = {b"true": "boolean", b"false": "boolean", b"null": "null"}


def _atom_kind(raw: bytes) -> str | None:
    return _WORDS.get(raw) or ("number" if _NUMBER.match(raw) else None)


class Index:
    """Tokens of a buffer of texts that are separated by line feeds."""

    def __init__(self, texts: Sequence[bytes]):
        self.n = len(texts)
        self.data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        self.bad = size == 1
        at = np.arange(len(buf), dtype=np.int32)
        slash = buf == 92
        if slash.any():
            last = np.maximum.accumulate(np.where(slash, -1, at))  # nearest byte before that is no backslash
            run = np.empty(len(buf), np.int32)
            run[0], run[1:] = 0, at[1:] - 1 - last[:-1]
            odd = (run & 1).astype(bool)
            lead = np.flatnonzero(slash & ~odd)
            nxt = buf[np.minimum(lead + 1, len(buf) - 1)]
            wrong = ~_ESC[nxt]
            u = lead[nxt == 117]
            ok = np.ones(len(u), bool)
            for k in range(2, 6):
                ok &= _HEX[buf[np.minimum(u + k, len(buf) - 1)]]
            self._spoil(np.concatenate((lead[wrong], u[~ok])), start)
            quote = (buf == 34) & ~odd
        else:
            quote = buf == 34
        count = np.cumsum(quote, dtype=np.int32)
        before = np.where(start > 0, count[start - 1], 0)
        doc_of = np.repeat(np.arange(self.n, dtype=np.int32), size)
        inside = ((count - before[doc_of]) & 1).astype(bool)  # from the opening quote up to before the closing one
        ends = np.concatenate((start[1:], [len(buf)])) - 1
        self.bad |= ((count[ends] - before) & 1).astype(bool)
        self._spoil(np.flatnonzero((buf < 32) & inside), start)  # also the line feed behind an open string
        kind = np.where(inside | quote, 0, _KIND[buf]).astype(np.uint8)
        plain = ~inside & ~quote & (kind == 0) & ~_BLANK[buf]
        first = plain.copy()
        first[1:] &= ~plain[:-1]
        kind[first] = _ATOM
        opening = quote & inside
        kind[opening] = _STR
        pos = np.flatnonzero(kind)
        pos = pos[~self.bad[doc_of[pos]]]
        self.pos, self.kind, self.doc = pos, kind[pos], doc_of[pos]
        self.end = pos + 1
        closing = np.flatnonzero(quote & ~inside)
        s = self.kind == _STR
        self.end[s] = closing[np.searchsorted(closing, pos[s])] + 1
        a = self.kind == _ATOM
        stop = np.flatnonzero(~plain)
        self.end[a] = stop[np.searchsorted(stop, pos[a])]
        self._nest()
        self._grammar()

    def _spoil(self, at: np.ndarray, start: np.ndarray) -> None:
        if len(at):
            self.bad[np.searchsorted(start, at, "right") - 1] = True

    def _keep(self, ok: np.ndarray) -> None:
        for name in ("pos", "end", "kind", "doc", "level"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[ok])

    def _nest(self) -> None:
        """Depth by running sums; texts with unbalanced brackets drop out."""
        opens = (self.kind == _OPEN_O) | (self.kind == _OPEN_A)
        closes = (self.kind == _CLOSE_O) | (self.kind == _CLOSE_A)
        depth = np.cumsum(opens.astype(np.int32) - closes)
        first = np.searchsorted(self.doc, np.arange(self.n))
        last = np.searchsorted(self.doc, np.arange(self.n), "right") - 1
        some = first <= last
        base = np.zeros(self.n, np.int64)
        base[some] = np.where(first[some] > 0, depth[np.maximum(first[some] - 1, 0)], 0)
        depth = depth - base[self.doc]
        self.bad |= ~some
        self.bad[some] |= depth[last[some]] != 0
        self.bad[self.doc[depth < 0]] = True
        self.level = depth - opens  # depth of the container it stands in; a bracket's own level for both brackets
        self._keep(~self.bad[self.doc])
        opens = (self.kind == _OPEN_O) | (self.kind == _OPEN_A)
        closes = (self.kind == _CLOSE_O) | (self.kind == _CLOSE_A)
        order = np.lexsort((self.pos, self.level))
        o, c = order[opens[order]], order[closes[order]]
        self.bad[self.doc[o[self.kind[c] != self.kind[o] + 1]]] = True  # at each level they alternate
        self.close_of = np.full(len(self.pos), -1, np.int64)
        self.close_of[o] = c

    def _grammar(self) -> None:
        k, n = self.kind, len(self.kind)
        opens = (k == _OPEN_O) | (k == _OPEN_A)
        at = np.arange(n)
        # parents: tokens of a level together with the opening brackets one level up, forward filled
        o = np.flatnonzero(opens)
        level = np.concatenate((self.level, self.level[o] + 1))
        where = np.concatenate((at, o))
        mark = np.concatenate((np.zeros(n, bool), np.ones(len(o), bool)))
        order = np.lexsort((where, level))
        ranks = np.arange(len(order))
        m = mark[order]
        here = np.maximum.accumulate(np.where(m, ranks, -1))
        held = order[~m]
        self.parent = np.full(n, -1, np.int64)
        owner = np.where(here >= 0, where[order[np.maximum(here, 0)]], -1)
        self.parent[held] = np.where(level[held] > 0, owner[~m], -1)
        comma = np.concatenate((k == _COMMA, np.zeros(len(o), bool)))[order]
        seen = np.cumsum(comma)
        self.place = np.zeros(n, np.int64)
        self.place[held] = (seen - np.where(here >= 0, seen[np.maximum(here, 0)], 0))[~m]
        prev = np.concatenate(([0], k[:-1]))
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1])) if n else np.zeros(0, bool)
        prev = np.where(first, 0, prev)
        last = np.concatenate((first[1:], [True])) if n else first
        holder = np.where(self.parent >= 0, k[self.parent], 0)
        in_object = holder == _OPEN_O
        self.is_key = (k == _STR) & in_object & ((prev == _OPEN_O) | (prev == _COMMA))
        starts = (opens | (k == _STR) | (k == _ATOM)) & ~self.is_key
        was_key = np.concatenate(([False], self.is_key[:-1])) & ~first
        ended = ((prev == _STR) & ~was_key) | (prev == _ATOM) | (prev == _CLOSE_O) | (prev == _CLOSE_A)
        closes = (k == _CLOSE_O) | (k == _CLOSE_A)
        good = (
            (first & starts)
            | ((prev == _OPEN_O) & (self.is_key | (k == _CLOSE_O)))
            | ((prev == _OPEN_A) & (starts | (k == _CLOSE_A)))
            | ((prev == _COMMA) & np.where(in_object, self.is_key, starts))
            | ((prev == _COLON) & starts)
            | (was_key & (k == _COLON))
            | (ended & (((k == _COMMA) & (self.level > 0)) | closes))
        )
        good &= ~(last & ~(closes | (k == _STR) | (k == _ATOM)))
        self.bad[self.doc[~good]] = True
        self.starts = starts
        atoms = np.flatnonzero(k == _ATOM)
        kinds: dict[bytes, bool] = {}
        for i in atoms.tolist():
            raw = self.data[self.pos[i] : self.end[i]]
            if raw not in kinds:
                kinds[raw] = _atom_kind(raw) is not None
            if not kinds[raw]:
                self.bad[self.doc[i]] = True

    def raw(self, i: int) -> bytes:
        j = self.close_of[i]
        return self.data[self.pos[i] : self.end[i if j < 0 else j]]

    def kind_name(self, i: int) -> str:
        k = self.kind[i]
        return {_OPEN_O: "object", _OPEN_A: "array", _STR: "string"}.get(k) or _atom_kind(self.raw(i)) or "?"


def _compile(paths: Sequence[str]) -> tuple[dict[tuple[int, str], int], dict[int, str]]:
    """A path such as cycles[].validation.candidate as states; a step is a member name or []."""
    step, out, new = {}, {}, 1
    for p in paths:
        state = 0
        for part in re.findall(r"\[\]|[^.\[\]]+", p):
            if (state, part) not in step:
                step[state, part] = new
                new += 1
            state = step[state, part]
        out[state] = p
    return step, out


def flatten(texts: Sequence[str | None], paths: Sequence[str], wrapper: str | None = None, containers: bool = False) -> Iterator[tuple]:
    """Rows (text number, path, node, parent_node, pos, kind, value) of the wanted paths.

    node numbers rise with the place in the text and are unique in it; parent_node is the nearest
    wanted node around it, -1 if none; pos is the place in the array, 0 outside arrays. A member
    that occurs twice counts once, with its last value. A text that is itself an encoded string is
    decoded until it isn't; with a wrapper, an object holding that member (object or string) is
    replaced by it. Texts that are no JSON give nothing; null and blank texts neither.
    """
    step, out = _compile(paths)
    work = [(i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if t]
    while work:
        part, size = [], 0
        while work and (not part or size + len(work[-1][1]) < 1_500_000):
            part.append(work.pop())
            size += len(part[-1][1])
        x = Index([t for _, t in part])
        roots = np.flatnonzero(x.starts & (x.level == 0) & ~x.bad[x.doc])
        state = {}
        members: dict[int, list[int]] = {}
        # children by parent, only for texts that are fine
        kids = np.flatnonzero(x.starts & (x.level > 0) & ~x.bad[x.doc])
        kids = kids[np.argsort(x.parent[kids], kind="stable")]
        parents = x.parent[kids]
        lo = lambda p: np.searchsorted(parents, p)

        def children(p: int):
            a, b = lo(p), lo(p + 1)
            if x.kind[p] == _OPEN_A:
                return [("[]", int(i)) for i in kids[a:b]]
            named = {}
            for i in kids[a:b].tolist():
                key = x.data[x.pos[i - 2] + 1 : x.end[i - 2] - 1]
                named[json.loads(b'"' + key + b'"') if b"\\" in key else key.decode("utf-8", "replace")] = i
            return list(named.items())

        for r in roots.tolist():
            doc = part[x.doc[r]][0]
            if x.kind[r] == _STR:
                _again(work, doc, x.raw(r))
                continue
            if wrapper and x.kind[r] == _OPEN_O:
                inner = dict(children(r)).get(wrapper)
                while inner is not None and x.kind[inner] == _OPEN_O:
                    r = inner
                    inner = dict(children(r)).get(wrapper)
                if inner is not None and x.kind[inner] == _STR:
                    _again(work, doc, x.raw(inner))
                    continue
            base = r
            stack = [(r, 0, -1)]
            while stack:
                node, st, above = stack.pop()
                if x.kind[node] not in (_OPEN_O, _OPEN_A):
                    continue
                for key, child in children(node):
                    to = step.get((st, key))
                    if to is None:
                        continue
                    mine = above
                    if to in out:
                        kind = x.kind_name(child)
                        mine = child - base
                        value = None
                        if kind == "string":
                            value = json.loads(x.raw(child))
                        elif containers or kind not in ("object", "array"):
                            value = x.raw(child).decode("utf-8", "replace")
                        yield doc, out[to], mine, above, int(x.place[child]) if key == "[]" else 0, kind, value
                    stack.append((child, to, mine))
        del state, members


def _again(work: list, doc: int, raw: bytes) -> None:
    inner = json.loads(raw).encode("utf-8", "surrogatepass")
    if inner.strip():
        work.append((doc, inner))


def nested_rows(df: DataFrame, text: str, keep: Sequence[str], paths: Sequence[str], wrapper: str | None = None, containers: bool = False) -> DataFrame:
    """The kept columns of each text row with (path, node, parent_node, pos, kind, value), see flatten.

    One pass without shuffle; memory is bounded by the longest text, as batches are cut to 1.5 MB.
    """
    extra = pa.schema([("path", pa.string()), ("node", pa.int64()), ("parent_node", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
    schema = T.StructType([df.schema[c] for c in keep] + from_arrow_schema(extra).fields)
    keep, paths = list(keep), list(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(flatten(b.column(len(keep)).to_pylist(), paths, wrapper, containers))
            at = pa.array([r[0] for r in rows], pa.int64())
            made = [b.column(i).take(at) for i in range(len(keep))]
            made += [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(extra, 1)]
            yield pa.RecordBatch.from_arrays(made, keep + extra.names)

    return df.select(*keep, text).mapInArrow(run, schema)

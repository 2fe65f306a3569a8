"""Texts garbled by a wrong character encoding (problem 10).

A text is cut into sentences. For a sentence, every chain of re-encodings that could have garbled it is
undone (once or repeatedly, on the whole sentence or on the stretches the wrong encoding can hold) and
what comes out is compressed with a zstandard dictionary of the language. The chain with the shortest
description, its own cost included, wins; without a gain the sentence stays as it is.

Sentences made only of units (words with characters beyond ASCII, pairs of Han characters) that are usual in
the sound sentences of all documents need no compression: no chain would turn them into anything more usual.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import log
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.functions.keys import code_key
from lodestat.session import cut

#: Encodings a text may wrongly have been read in, each with those it may really be in.
CHAINS = {
    "cp1252": ["utf-8", "gbk", "big5", "cp1251", "mac_roman", "cp850", "cp437"],
    "latin-1": ["utf-8", "gbk", "big5"],
    "cp437": ["utf-8", "cp1252", "gbk", "big5"],
    "cp850": ["utf-8", "cp1252"],
    "mac_roman": ["utf-8", "cp1252"],
    "cp1251": ["utf-8", "cp1252", "koi8-r"],
    "koi8-r": ["utf-8", "cp1252", "cp1251"],
    "iso8859-15": ["utf-8"],
    "cp1250": ["utf-8", "cp1252"],
    "gbk": ["utf-8", "big5", "cp1252"],
    "big5": ["utf-8", "gbk", "cp1252"],
}
_MULTI = {"gbk", "big5"}
_SENTENCE = re.compile(r"[^\n。！？.!?]*(?:[。！？\n]+|[.!?]+(?:\s+|\Z)|[.!?]+|\Z)")
_ODD = re.compile(r"[^\x00-\x7f]")
#: The sign of a lost character and control characters, which stand for bytes.
_LOST_SIGN = re.compile("[\ufffd\x80-\x84\x86-\x9f]")
LEVEL = 19
#: Bytes that a reading by runs between two-byte encodings must gain beyond the cost of its step.
RUN_COST = 6.0
DICTIONARY_BYTES = 112_000
#: Documents and characters of a block that is trained at once, languages with a model of their own (texts of others
#: are read with all models), bytes of the pieces in which dictionaries are merged.
BLOCK_DOCUMENTS, BLOCK_CHARS, MOST_LANGUAGES, PIECE = 2000, 40_000_000, 16, 1024


def _upper(enc: str) -> dict[str, bytes]:
    """Characters of the upper half of a one-byte encoding; Windows code pages keep the bytes they
    leave undefined as control characters of the same number."""
    out = {}
    for n in range(128, 256):
        b = bytes([n])
        try:
            out[b.decode(enc)] = b
        except UnicodeDecodeError:
            out[chr(n)] = b
    return out


_UPPER = {enc: _upper(enc) for enc in CHAINS if enc not in _MULTI}
_SETS = {enc: re.escape("".join(up)) for enc, up in _UPPER.items()}
_HOLDS = {enc: re.compile(f"[{c}]") for enc, c in _SETS.items()}
_STRETCH = {enc: re.compile(f"[\x00-\x7f{c}]*[{c}][\x00-\x7f{c}]*") for enc, c in _SETS.items()}
_RUN = {enc: re.compile(f"[{c}]+") for enc, c in _SETS.items()}
_ODD_RUN = re.compile(r"[^\x00-\x7f]+")


def _held(enc: str) -> re.Pattern:
    """Runs of characters beyond ASCII that a two-byte encoding can hold: a lost character, or a sound one
    outside the encoding, ends a run."""
    return re.compile("[" + re.escape("".join(chr(n) for n in range(0x80, 0x10000) if not 0xD800 <= n < 0xE000 and chr(n).encode(enc, "ignore"))) + "]+")


_HELD_RUN = {enc: _held(enc) for enc in sorted(_MULTI)}


def _classes(enc: str) -> re.Pattern:
    """Complete UTF-8 sequences as the one-byte encoding shows them: a lead and its trailing characters."""
    at: dict[int, str] = {}
    for c, b in _UPPER[enc].items():
        at[b[0]] = at.get(b[0], "") + c
    of = lambda lo, hi: "[" + re.escape("".join(at.get(n, "") for n in range(lo, hi + 1))) + "]"
    t = of(0x80, 0xBF)
    seq = f"(?:{of(0xC2, 0xDF)}{t}|{of(0xE0, 0xEF)}{t}{t}|{of(0xF0, 0xF4)}{t}{t}{t})"
    # Latin readings may stand beside sound letters of the same kind; elsewhere a run must be read whole
    return re.compile(f"{seq}+" if enc in ("cp1252", "latin-1") else f"(?<![{_SETS[enc]}]){seq}+(?![{_SETS[enc]}])")


_SEQUENCES = {enc: _classes(enc) for enc, rights in CHAINS.items() if enc in _UPPER and "utf-8" in rights}


def _one_to_one(wrong: str, right: str) -> dict[int, str]:
    """Character to character between one-byte encodings; bytes the right one leaves undefined stay out."""
    out = {}
    for c, b in _UPPER[wrong].items():
        try:
            out[ord(c)] = b.decode(right)
        except UnicodeDecodeError:
            pass
    return out


_TABLES = {(w, r): _one_to_one(w, r) for w, rights in CHAINS.items() for r in rights if w in _UPPER and r in (*_UPPER, "cp866")}


def _encode(s: str, enc: str) -> bytes | None:
    try:
        return s.encode(enc)
    except UnicodeEncodeError:
        if enc in _MULTI:
            return None
    up = _UPPER[enc]
    return b"".join(up.get(c) or c.encode("ascii") for c in s)


def _decode(b: bytes, enc: str) -> str | None:
    try:
        return b.decode(enc)
    except UnicodeDecodeError:
        return None


def _undo(s: str, wrong: str, rights: Sequence[str]) -> Iterator[tuple[str, str, bool]]:
    """(right encoding, text, by runs): what the text may have been.

    From a one-byte encoding: to UTF-8 all complete sequences are read, to another one-byte encoding all
    characters are exchanged, to a two-byte one the stretches that the wrong encoding can hold are
    read. From a two-byte encoding: the whole; where that fails, for UTF-8 the runs beyond ASCII, for others the
    runs that the wrong encoding can hold and the right one reads. Only the last are marked as by runs, as nearly
    any short run can be read so: they have to gain more."""
    if wrong in _MULTI:
        b = _encode(s, wrong)
        for right in rights:
            t = _decode(b, right) if b is not None else None
            runs = t is None and right != "utf-8"
            if t is None:
                t = (_HELD_RUN[wrong] if runs else _ODD_RUN).sub(lambda m: (lambda x: m.group() if x is None else x)(_reread(m.group(), wrong, right)), s)
            if t != s:
                yield right, t, runs
        return
    if not _HOLDS[wrong].search(s):
        return
    for right in rights:
        if right == "utf-8":
            t = _SEQUENCES[wrong].sub(lambda m: _reread(m.group(), wrong, "utf-8") or m.group(), s)
        elif right in _MULTI:
            t = _STRETCH[wrong].sub(lambda m: _reread(m.group(), wrong, right) or m.group(), s)
        else:
            t = s.translate(_TABLES[wrong, right])
        if t != s:
            yield right, t, False


def _reread(x: str, wrong: str, right: str) -> str | None:
    b = _encode(x, wrong)
    return None if b is None else _decode(b, right)


class Lengths:
    """Description lengths in bytes by language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {}
        for lang, raw in dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress

    def of(self, s: str, lang: str | None) -> int:
        b = s.encode("utf-8", "surrogatepass")
        use = [self.by[lang]] if lang in self.by else list(self.by.values()) or [self.plain]
        return min(len(f(b)) for f in use)


def _strange(t: str) -> int:
    """Control, private and lost characters cost extra: no encoding of prose has them."""
    return 4 * len(_STRANGE.findall(t))


_STRANGE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad\ue000-\uf8ff\ufffd]")


def repair_sentence(s: str, lang: str | None, lengths: Lengths, chain_cost: float = 3.0, rounds: int = 3, beam: int = 3, run_cost: float = RUN_COST, usual: Callable[[str], bool] | None = None) -> tuple[str, list[str]]:
    """(text, chain): the best undoing of a sentence and its steps, the last applied first; no step if
    nothing is gained. A step must pay `chain_cost` bytes, one by runs `run_cost` more. The `beam` best texts of a round are undone
    further, as only the second step may bring the gain, unless the best is made of `usual` units already."""
    first = lengths.of(s, lang) + _strange(s)
    best, best_len, best_chain = s, float(first), []
    # chains with a step by runs are a line of their own: they take no place in the other's beam
    seen: tuple[set[str], set[str]] = ({s}, {s})
    front: list[tuple[float, str, list[str], float]] = [(first, s, [], 0.0)]
    for depth in range(1, rounds + 1):
        made: tuple[list, list] = ([], [])
        for _, t0, chain, paid in front:
            if t0.isascii():
                continue
            for wrong, rights in CHAINS.items():
                for right, t, runs in _undo(t0, wrong, rights):
                    cost = paid + (run_cost if runs else 0.0)
                    line = int(cost > 0)
                    if t not in seen[0] and t not in seen[line]:
                        seen[line].add(t)
                        odd = _strange(t)
                        if odd < first:
                            made[line].append((lengths.of(t, lang) + odd + cost, t, [*chain, f"{wrong}>{right}"], cost))
        for line in made:
            line.sort(key=lambda m: m[0])
            for n, t, chain, _ in line[:1]:
                if n + chain_cost * depth <= best_len:
                    best, best_len, best_chain = t, n + chain_cost * depth, chain
        front = [m for line in made for m in line[:beam] if m[0] <= first]
        if not front or (best_chain and usual is not None and usual(best)):
            break
    return best, best_chain


def sentences(text: str) -> list[str]:
    return [m for m in _SENTENCE.findall(text) if m]


def units(x: str) -> list[str]:
    """What a text is made of beyond ASCII: words with such characters (digits as one), pairs of Han
    characters and of their punctuation, single ones where they stand alone."""
    out = _words(x)
    for r in _HAN_RUN.findall(x):
        out += map("".join, zip(r, r[1:])) if len(r) > 1 else [r]
    return out


class Model(NamedTuple):
    """Of a language: the compression dictionary and its usual units."""

    dictionary: bytes
    known: frozenset[str]


class Repair:
    """Repairs texts with the models of their languages; remembers what became of the last sentences."""

    def __init__(self, models: dict[str, Model], chain_cost: float = 3.0):
        self.lengths = Lengths({k: m.dictionary for k, m in models.items()})
        self.known = {k: m.known for k, m in models.items()}
        self.every = frozenset().union(*self.known.values())
        self.sentence = functools.lru_cache(20_000)(lambda s, lang: repair_sentence(s, lang, self.lengths, chain_cost, usual=lambda x: self.usual(x, lang)))

    def usual(self, x: str, lang: str | None) -> bool:
        return self.known.get(lang, self.every).issuperset(units(x))

    def text(self, text: str, lang: str | None) -> tuple[str, list[str], bool]:
        """(text, chains used, lost): `lost` if characters remain that no undoing brings back."""
        if text.isascii() or self.usual(text, lang):
            return text, [], False
        out, chains = [], []
        for s in sentences(text):
            if s.isascii() or self.usual(s, lang):
                out.append(s)
                continue
            t, chain = self.sentence(s, lang)
            out.append(t)
            if chain:
                chains.append("+".join(chain))
        fixed = "".join(out)
        lost = _LOST_SIGN.search(fixed) is not None
        return fixed, chains, lost


def train_dictionaries(docs: DataFrame, text: str, lang: str, per_block: int = BLOCK_DOCUMENTS, block_chars: int = BLOCK_CHARS, most_languages: int = MOST_LANGUAGES, fan: int = 16) -> dict[str, Model]:
    """A model per language, for the `most_languages` languages with most documents, from all their different texts.

    The texts of a language go by hash to blocks of about `per_block` documents and at most about `block_chars` characters.
    A block's sound sentences give its dictionary and the numbers of its units. Dictionaries are merged by
    `fan` until one is left, numbers are added up: a unit is usual that is seen as often for its number of documents as
    three times in `per_block`. The driver gets the models only."""
    d = docs.select(code_key(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64("text"))
    counted = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("texts"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counted:
        return {}
    # equal texts are in one block and count once there; chars holds copies too, so blocks are rather smaller
    blocks = {r["lang"]: max(-(-r["texts"] // per_block), -(-(r["chars"] * r["texts"] // r["n"]) // block_chars)) for r in counted}
    of = docs.sparkSession.createDataFrame(list(blocks.items()), "lang string, blocks bigint")
    d = d.join(F.broadcast(of), "lang").withColumn("block", F.pmod("h", "blocks")).select("lang", "block", "text")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["lang"].iloc[0], pdf["block"].iloc[0]
        kept = sound([x for t in sorted(set(pdf["text"])) for x in sentences(t)])
        rows = [(*at, None, u, n) for u, n in unit_counts(kept).items()]
        made = _compressed(kept)
        return pd.DataFrame(rows + [(*at, made, None, 0)] * (made is not None), columns=["lang", "block", "dictionary", "unit", "n"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(x) for x in pdf.sort_values("block")["dictionary"]]
        made = parts[0] if len(parts) == 1 else _trained([p[i : i + PIECE] for p in parts for i in range(0, len(p), PIECE)])
        return pd.DataFrame([(pdf["lang"].iloc[0], pdf["block"].iloc[0] // fan, made)], columns=["lang", "block", "dictionary"])

    learnt = cut(d.groupBy("lang", "block").applyInPandas(learn, "lang string, block bigint, dictionary binary, unit string, n bigint"))
    made = learnt.where("dictionary IS NOT NULL").select("lang", "block", "dictionary")
    left = max(blocks.values())
    while left > 1:
        made = made.groupBy("lang", F.floor(F.col("block") / fan).alias("to")).applyInPandas(merged, "lang string, block bigint, dictionary binary")
        left = -(-left // fan)
    least = docs.sparkSession.createDataFrame([(r["lang"], 3 * max(1.0, r["texts"] / per_block)) for r in counted], "lang string, least double")
    usual = learnt.where("unit IS NOT NULL").groupBy("lang", "unit").agg(F.sum("n").alias("n")).join(F.broadcast(least), "lang").where("n >= least")
    known: dict[str, set[str]] = {}
    for r in usual.select("lang", "unit").collect():
        known.setdefault(r["lang"], set()).add(r["unit"])
    return {r["lang"]: Model(bytes(r["dictionary"]), frozenset(known.get(r["lang"], ()))) for r in made.collect()}


def unit_counts(kept: Sequence[str]) -> Counter:
    """How often sound sentences have each unit, without signs that prose doesn't have and without signs beside accented
    letters only."""
    c: Counter = Counter()
    for x in kept:
        c.update(units(x))
    odd = lambda u: _STRANGE.search(u) or (_SIGN.search(u) and _ACCENTED.search(u) and not _LETTERS.search(u))
    return Counter({u: n for u, n in c.items() if not odd(u)})


def usual_units(kept: Sequence[str], least: int = 3) -> frozenset[str]:
    """The units that sound sentences of one block have at least `least` times."""
    return frozenset(u for u, n in unit_counts(kept).items() if n >= least)


def dictionary(samples: Sequence[str], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary of the sound sentences among the samples; None if there is too little text."""
    return _compressed(sound(samples), size)


def _compressed(sentences: Sequence[str], size: int = DICTIONARY_BYTES) -> bytes | None:
    return _trained([x.encode("utf-8", "surrogatepass") for x in sentences], size)


def _trained(kept: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    try:
        return zstandard.train_dictionary(size, kept).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(dict.fromkeys(kept))[-size:]
        return raw if len(raw) >= 8 else None


def sound(samples: Sequence[str], share: float = 0.3, rarer: float = 2.0) -> list[str]:
    """Sentences that most likely are undamaged. A word with characters beyond ASCII must be a usual
    spelling: at least `share` of all words that agree with it in their ASCII letters. Of sentences
    with Han characters, among samples mainly in these, those stay whose characters are on average (of logarithms) at most
    e ** `rarer` times rarer than those of the median sentence."""
    fine = [x for x in samples if not _STRANGE.search(x)]
    spelled: dict[str, Counter] = {}
    letters: Counter = Counter()
    for x in fine:
        letters.update(set(x))
        for w in _words(x):
            spelled.setdefault(_ODD_RUN.sub("?", w), Counter())[w] += 1
    # signs and foreign words that stand alone don't compete with each other
    bar = {k: (share if re.search("[A-Za-z]", k) else 0.01) * c.total() for k, c in spelled.items()}
    good = {w for k, c in spelled.items() for w, n in c.items() if n >= max(3, bar[k]) and not any(_MIXED.search(r) for r in _ODD_RUN.findall(w))}
    kept = [x for x in fine if not _BOXED.search(x) and all(w in good for w in _words(x))]
    if not _mainly_han(kept):  # among sentences in another script Han characters mostly are misread bytes
        return [x for x in kept if not _HAN.search(x)]
    han = [x for x in kept if _HAN.search(x)]
    mean = {x: sum(log(letters[c]) for c in x if not c.isascii()) / sum(not c.isascii() for c in x) for x in set(han)}
    usual = sorted(mean[x] for x in han)[len(han) // 2] - rarer
    return [x for x in kept if x not in mean or mean[x] >= usual]


def _mainly_han(sentences: Sequence[str]) -> bool:
    han = sum(len(_HAN.findall(x)) for x in sentences)
    return han > sum(len(w) for x in sentences for w in _LETTERS.findall(x))


def _words(x: str) -> list[str]:
    """Words with characters beyond ASCII, digits as one. Han characters among more ASCII letters belong to
    the word, as misread bytes put them there; elsewhere they are no part of words."""
    out = []
    for t in _TOKENS.findall(x):
        mixed = _LETTERS.search(t) and _HAN.search(t)
        out += [t] if mixed and sum(map(len, _LETTERS.findall(t))) > len(_HAN.findall(t)) else _WORDS.findall(t)
    return [_DIGITS.sub("0", w) for w in out]


_TOKENS = re.compile(r"\S*[^\x00-\x7f]\S*")
_LETTERS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
_SIGN, _ACCENTED = re.compile("[\u00a1-\u00bf\u2000-\u2bff]"), re.compile("[\u00c0-\u024f]")
#: Latin letters beside each other or beside signs, as only misread bytes have them.
_MIXED = re.compile("[\u00a1-\u00aa\u00ac-\u00ba\u00bc-\u024f\u02c6\u02dc\u2020-\u2122\u2202-\u2265]{2}")
#: Lines of a box beside letters.
_BOXED = re.compile("[A-Za-z][\u2500-\u257f]|[\u2500-\u257f][A-Za-z]")
_HAN = re.compile("[\u3000-\u9fff\uff00-\uffef]")
#: Runs of what _WORDS leaves out: Han characters, their punctuation, lines of boxes.
_HAN_RUN = re.compile("[\u2500-\u257f\u3000-\u9fff\uf900-\uffef]+")
#: Words of letters and signs beyond ASCII among ASCII letters, without Han and their punctuation.
_WORDS = re.compile(r"[^\s\u2500-\u257f\u3000-\u9fff\uf900-\uffef]*[^\x00-\x7f\u2500-\u257f\u3000-\u9fff\uf900-\uffef][^\s\u2500-\u257f\u3000-\u9fff\uf900-\uffef]*")


def repaired(docs: DataFrame, models: dict[str, Model], key: str, text: str, lang: str, chain_cost: float = 3.0) -> DataFrame:
    """(key, restored, chains, lost) of the damaged documents only. One pass, no shuffle; the
    models (bounded, see train_dictionaries) travel with the tasks. Null, empty and pure ASCII texts
    are never damaged."""
    code = code_key(F.col(lang))
    schema = T.StructType([docs.schema[key], T.StructField("restored", T.StringType()), T.StructField("chains", T.ArrayType(T.StringType())), T.StructField("lost", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(models, chain_cost)
        for b in batches:
            at, fixed, chains, lost = [], [], [], []
            for i, (t, g) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if not t:
                    continue
                f, c, miss = repair.text(t, g)
                if c or miss:
                    at.append(i), fixed.append(f), chains.append(c), lost.append(miss)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(fixed, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(lost, pa.bool_())], [key, "restored", "chains", "lost"])

    return docs.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(key, text, code).mapInArrow(run, schema)

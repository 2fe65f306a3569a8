"""One form for texts that look the same (problem 3).

A transducer over grapheme clusters: its mapping (widths, fonts, blanks, hyphens, joined letters,
same-shaped letters of other scripts, marks without width) is made once from rules over the Unicode
data and the fixed letter pairs below, checked for conflicts, and applied in one pass, the longest
cluster first. Case, digits, superscripts and the presence of an accent stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.operators.skew import LEAST, both_salted_join, hot_keys, salted_join, salted_on
from lodestat.session import cut

#: Cyrillic letters with the shape of a Latin letter, and those Latin letters.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХасеіјоруѕхһԁԛԝӏ", "ABESIJKMHOPCTYXaceijopysxhdqwl")
#: Greek letters with the shape of a Latin letter, and those Latin letters.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ", "ABEZHIKMNOPTYXvocj")
#: Hyphens and minus signs of the same look as the plain hyphen.
HYPHENS = "‐‑‒−﹣－"
#: Characters without width or look, besides the format characters (category Cf).
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Overlaid strokes, composed with their letters.
STROKED = {"o̸": "ø", "O̸": "Ø", "o̷": "ø", "O̷": "Ø", "l̵": "ł", "L̵": "Ł", "d̵": "đ", "D̵": "Đ"}
#: Kinds of compatibility decomposition that change width or font only.
_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<vertical>"}
_COMPAT_NAMES = ("LIGATURE", "DIGRAPH", "KANGXI RADICAL", "CJK RADICAL", "ROMAN NUMERAL", "LATIN SMALL LETTER LONG S")


class Transducer:
    def __init__(self) -> None:
        letters = dict(zip(*CYRILLIC)) | dict(zip(*GREEK)) | dict.fromkeys(HYPHENS, "-")
        self.letters = letters
        single: dict[str, str] = {}
        for code in range(0x80, 0x32000):
            if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xF900 or 0x4E00 <= code < 0xA000:
                continue
            c = chr(code)
            kind = unicodedata.category(c)
            if kind == "Cn":
                continue
            if kind == "Cf" or c in UNSEEN:
                single[c] = ""
            elif kind == "Zs":
                single[c] = " "
            else:
                to = self._plain(c)
                if to != c:
                    single[c] = to
        self.single = single
        self.unseen = "".join(c for c, to in single.items() if not to)
        self.check()
        keys = regex.escape("".join(c for c, to in single.items() if to), special_only=True)
        marks = rf"\p{{M}}{regex.escape(self.unseen, special_only=True)}"
        self._find = regex.compile(rf"[^{marks}][{marks}]+|[{keys}]|[{marks}]+")
        self._known: dict[str, str] = {}
        self._table = {ord(c): to for c, to in single.items()}
        self._marks = frozenset(c for c in map(chr, range(0x300, 0x32000)) if unicodedata.category(c)[0] == "M")
        self._any = self._marks | single.keys()

    def _plain(self, c: str) -> str:
        """What one character stands for, with its accents."""
        parts = unicodedata.decomposition(c).split()
        if parts and parts[0].startswith("<"):
            name = unicodedata.name(c, "")
            if parts[0] in _SAME_LOOK or parts[0] == "<compat>" and any(n in name for n in _COMPAT_NAMES):
                c = "".join(self._plain(chr(int(p, 16))) for p in parts[1:])
        out = "".join(self.letters.get(x, x) for x in unicodedata.normalize("NFD", c))
        return unicodedata.normalize("NFC", out)

    def check(self) -> None:
        """No conflicts: plain characters and superscripts are no keys, what comes out is final, and
        accents are neither lost nor made."""
        count = lambda s: sum(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFD", s))
        for c, to in self.single.items():
            if c.isascii() or unicodedata.decomposition(c).startswith(("<super>", "<sub>", "<fraction>")):
                raise ValueError(f"{c!r} must keep its look")
            if to and any(self.single.get(x, x) != x for x in to):
                raise ValueError(f"{c!r} -> {to!r} is not final")
            if to and to != " " and count(c) != count(to) and not unicodedata.decomposition(c).startswith("<"):
                raise ValueError(f"{c!r} -> {to!r} changes accents")

    def _cluster(self, m: regex.Match) -> str:
        s = m.group()
        out = self._known.get(s)
        if out is None:
            t = "".join(self.single.get(x, x) for x in s)
            t = "".join(self.letters.get(x, x) for x in unicodedata.normalize("NFD", t))
            t = STROKED.get(t, t)
            out = unicodedata.normalize("NFC", t)
            if len(s) <= 8 and len(self._known) < 100_000:
                self._known[s] = out
        return out

    def __call__(self, text: str) -> str:
        """Texts without combining marks have clusters of one character only (besides unseen ones), for
        which the table of single characters is the whole transducer."""
        if text.isascii() or self._any.isdisjoint(text):
            return text
        if self._marks.isdisjoint(text):
            return text.translate(self._table)
        return self._find.sub(self._cluster, text)


_ONE: list[Transducer] = []


def transducer() -> Transducer:
    if not _ONE:
        _ONE.append(Transducer())
    return _ONE[0]


def common_form(df: DataFrame, text: str, into: str = "common_form") -> DataFrame:
    """Adds the common form of a string column, in place of a column of that name; null stays null;
    whole texts, no shuffle."""
    df = df.drop(into)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for b in batches:
            made = [None if x is None else t(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, into])

    return df.mapInArrow(run, schema)


def look_classes(df: DataFrame, text: str, key: str, *keep: str) -> DataFrame:
    """(keep, key, look, exact): digests of the common form and of the text itself. Null texts look like
    nothing and are left out; empty texts are texts."""
    d = common_form(df.where(F.col(text).isNotNull()).select(*keep, key, F.col(text).alias("__text")), "__text", "__form")
    return d.select(*keep, key, F.unhex(F.sha2("__form", 256)).alias("look"), F.unhex(F.sha2("__text", 256)).alias("exact"))


def same_look_groups(classes: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, key, class_key, n_texts): one row per record whose look also occurs in another spelling;
    class_key is the smallest key of its look. Copies are not expanded into pairs. `within`: columns that
    must be equal as well."""
    look = [*within, "look"]
    per = classes.groupBy(*look, "exact").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("m"))
    g = per.groupBy(*look).agg(F.min("k").alias("class_key"), F.count(F.lit(1)).alias("n_texts"), F.sum("m").alias("n")).where("n_texts > 1")
    return salted_join(classes, g.drop("n"), look, F.col(key), counts=g.select(*look, "n")).select(*within, key, "class_key", "n_texts")


def same_look_pairs(classes: DataFrame, key: str, within: Sequence[str] = (), least: int = LEAST) -> DataFrame:
    """(within, key_a, key_b), key_a < key_b: equal look, different text. Texts are first brought to classes
    of equal characters; classes of one look are paired, and the pairs are then spread over their members,
    so no row meets a copy of itself. Looks with many spellings and texts with many copies are spread
    over slots in each step; `least` is the number of rows from which on."""
    look = [*within, "look"]
    per = cut(classes.groupBy(*look, "exact").agg(F.count(F.lit(1)).alias("n")))
    looks = per.groupBy(*look).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot_looks = hot_keys(looks, look, least=least)
    several = salted_on(per, looks.select(*look), look, F.col("exact"), hot_looks, "left_semi")
    a = several.select(*look, F.col("exact").alias("ea"), F.col("n").alias("na"))
    b = several.select(*look, F.col("exact").alias("eb"))
    pairs = salted_on(a, b, look, F.col("ea"), hot_looks).where("ea < eb")
    loads = hot_keys(pairs.groupBy(*look, "eb").agg(F.sum("na").alias("n")), [*look, "eb"], least=least)
    texts = hot_keys(per, [*look, "exact"], least=least)
    as_ = lambda name: None if texts is None else texts.withColumnRenamed("exact", name)
    m = classes.select(*look, F.col("exact").alias("ea"), F.col(key).alias("ka"))
    first = salted_on(m, pairs.drop("na"), [*look, "ea"], F.col("ka"), as_("ea"))
    m = classes.select(*look, F.col("exact").alias("eb"), F.col(key).alias("kb"))
    met = both_salted_join(first.select(*look, "eb", "ka"), m, [*look, "eb"], F.col("ka"), F.col("kb"), loads, as_("eb"))
    return met.select(*within, F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))

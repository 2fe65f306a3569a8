"""Broken prompt and response pairs (problem 5).

An answer is held against the nearest user message before it, by a suffix automaton of the prompt
(how much of the answer is copied), automata over word classes for refusals (refusals.py), a stack of
delimiters and stopword votes for the language. Where only the last words can tell whether an answer
breaks off, statistics over all answers decide: how often those words end a sentence or list item elsewhere.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.lookalike import transducer
from lodestat.llm.refusals import is_refusal as _declined

#: Words that stand for "no answer" when nothing else is there.
NOTHING = ["n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "無", "无", "空", "略"]
#: Labels that may precede an answer.
LABELS = ["answer", "response", "reply", "final answer", "答", "回答", "答案", "解答", "antwort", "réponse"]
#: Labels that may precede a repeated question.
QUESTION_LABELS = ["question", "prompt", "問題", "问题", "題目", "题目", "提問", "提问", "frage"]
#: Frequent short words by language.
STOPWORDS = {
    "en": "the of and to in is for that with on as are was be by it this from at or an not which we have has but were than its can should how what does do a if you i".split(),
    "fr": "le la les des du de et est une un dans pour que qui sur au aux avec par ne pas ce cette plus se sont été d l à en nous mais ou où il elle".split(),
    "de": "der die das und ist ein eine nicht mit für von zu den dem des im auf sich als auch wird werden wurde daher es wir bei nach oder aber dass".split(),
    "es": "el los las y es una un en para que por con no se del al como más pero sus está son".split(),
    "it": "il lo gli e è una un per che con non si del della di nel sono come più ma".split(),
}
#: Names of languages as a question may ask for them.
ASKED = {
    "en": ["english", "英文", "英語", "英语", "anglais", "englisch"],
    "fr": ["french", "法文", "法語", "法语", "français", "französisch"],
    "de": ["german", "德文", "德語", "德语", "allemand", "deutsch"],
    "zh_hant": ["traditional chinese", "繁體", "繁体", "正體", "正体"],
    "zh_hans": ["simplified chinese", "簡體", "简体"],
    "zh": ["chinese", "中文", "漢語", "汉语", "華語", "华语"],
    "ja": ["japanese", "日文", "日語", "日语"],
    "es": ["spanish", "西班牙"],
}
_VOTES: dict[str, tuple[str, ...]] = {w: tuple(k for k, v in STOPWORDS.items() if w in v) for v in STOPWORDS.values() for w in v}
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z_][\w-]*>")
_ID = re.compile(r"\b[A-Z]{1,4}-[A-Z0-9]+\b|\b\w+_\w+\b")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
#: Delimiters that open and those that close them.
PAIRED = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "《": "》", "“": "”", "【": "】"}
_DELIMITER = re.compile("[" + re.escape('"' + "".join(PAIRED) + "".join(PAIRED.values())) + "]")
_QUOTED = re.compile(r"\{.*?\}|`[^`]*`", re.S)
_LABEL = re.compile(rf"(?i)(?:{'|'.join(map(re.escape, LABELS))})\s*[:：]?\s*(.*)", re.S)
_ASKED_AGAIN = re.compile(rf"(?i)^\W*(?:{'|'.join(QUESTION_LABELS)})\s*[:：]")
_NO_LETTER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: How many sights of the last word weigh as much as its rate against that of the last two words.
PRIOR = 4.0
_END = ".!?。！？"
_CLOSERS = "\"'”’」』)）]】*_`»"
_MENU = re.compile(r"\n\s*\n?[^\n]{0,24}[:：]\s*\n\s*[A-Za-zＡ-Ｚ][^\n]{0,3}?[.)．、:]")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)、])\s+")
_SENT = re.compile(r"(?<=[.!?])(?:\s+|$)|(?<=[。！？])|\n+")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_]+|\d+(?:[.,]\d+)*")


class SuffixAutomaton:
    """All substrings of a text; `spans` walks another text through it."""

    def __init__(self, s: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for c in s:
            cur = len(self.next)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    new = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = new
                        p = self.link[p]
                    self.link[q] = self.link[cur] = new
            last = cur

    def spans(self, t: str, least: int) -> Iterator[tuple[int, int]]:
        """Stretches of t of at least `least` characters that the text also has; ends rise."""
        state = length = 0
        for i, c in enumerate(t):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length >= least:
                yield i + 1 - length, i + 1


def copied(text: str, t: str, least: int, block: int = 100_000) -> int:
    """How many characters of t lie in stretches of at least `least` that the text also has. The text is
    indexed in blocks that overlap by `least`, so any such stretch shows and memory stays bounded."""
    covered = bytearray(len(t))
    for at in range(0, max(len(text), 1), block):
        reach = 0
        for i, j in SuffixAutomaton(text[at : at + block + least]).spans(t, least):
            i = max(i, reach)
            covered[i:j] = b"\x01" * (j - i)
            reach = j
    return sum(covered)


def may_copy(text: str, t: str, least: int = 6, lost: float = 0.03) -> bool:
    """False only if more than a share `lost` of t can't lie in stretches of `least` characters that the text
    also has, so no automaton is needed. Of 2 * least characters that are covered as a whole, one of
    the first least + 1 begins such a stretch; each block without one has a character uncovered."""
    left = lost * len(t)
    for at in range(0, len(t) - 2 * least + 1, 2 * least):
        if not any(t[i : i + least] in text for i in range(at, at + least + 1)):
            left -= 1
            if left < 0:
                return False
    return True


@functools.lru_cache(200_000)
def _variant(c: str) -> int:
    """1: only in the traditional national set, -1: only in the simplified one, 0: in both or neither."""
    sides = []
    for enc in ("big5", "gb2312"):
        try:
            c.encode(enc)
            sides.append(True)
        except UnicodeEncodeError:
            sides.append(False)
    return 0 if sides[0] == sides[1] else 1 if sides[0] else -1


def language(text: str) -> str | None:
    """Language of the prose in a text by votes, null without enough of it."""
    t = _FENCE.sub(" ", text) if "```" in text else text
    t = _TAG.sub(" ", t) if "<" in t else t
    t = _ID.sub(" ", t)
    t = _QUOTED.sub(" ", t) if "{" in t or "`" in t else t
    han = _HAN.findall(t)
    seen = Counter(p for w in _WORD.findall(t) for p in w.lower().replace("’", "'").split("'"))
    votes = dict.fromkeys(STOPWORDS, 0)
    for w, n in seen.items():
        for k in _VOTES.get(w, ()):
            votes[k] += n
    best = max(votes, key=lambda k: (votes[k], k))
    latin = votes[best]
    if len(han) >= 6 and len(han) > 2 * latin:
        tilt = [_variant(c) for c in han]
        hant, hans = tilt.count(1), tilt.count(-1)
        if hant >= 2 and hant > 3 * hans:
            return "zh_hant"
        if hans >= 2 and hans > 3 * hant:
            return "zh_hans"
        return "zh"
    rest = sorted(votes.values())[-2]
    if latin >= 3 and latin > 1.5 * rest:
        return best
    return None


@functools.cache
def _ask_pattern(code: str) -> re.Pattern:
    names = "(?:" + "|".join(ASKED[code]) + ")"
    return re.compile(rf"(?i)\b(?:in|into|en|auf)\s+(?:\w+\s+)?{names}|(?:用|以|成|為|为)\s*{names}")


def asked_languages(prompt: str) -> set[str]:
    return {c for c in ASKED if _ask_pattern(c).search(prompt)}


def core_question(prompt: str) -> str:
    """The question without its menu."""
    m = _MENU.search(prompt)
    return prompt[: m.start()] if m else prompt


def _letters(s: str) -> str:
    return _NO_LETTER.sub("", s.casefold())


@functools.lru_cache(8)
def _bare(answer: str) -> str:
    """What is left of an answer without thoughts, tags, quoted blocks and fences' marks."""
    a = transducer()(answer)
    a = _THINK.sub(" ", a)
    return a.strip()


@functools.lru_cache(8)
def is_empty(answer: str) -> bool:
    a = re.sub(r"```[\w+-]*\s*```", " ", _bare(answer))
    a = _TAG.sub(" ", a).strip().strip("*_#>`~ \t\n").strip()
    a = re.sub(r"[*_`]", "", a).strip()
    m = _LABEL.fullmatch(a)
    if m and (a.rstrip().endswith((":", "：")) or re.match(r"(?i)[^:：]*[:：]", a)):
        a = m.group(1).strip()
    inner = a.strip("()（）[]【】.。-—–_ ").casefold()
    return not any(c.isalnum() for c in a) or inner in NOTHING


def is_copy(prompt: str, answer: str) -> bool:
    """`prompt` is in the common form of look-alikes, as the answer is brought to it."""
    a = _TAG.sub(" ", _bare(answer))
    kept = [x for x in a.split("\n") if not x.lstrip().startswith(">")]
    rest = "\n".join(kept)
    if len(kept) < len(a.split("\n")):
        if any(c.isalnum() for c in rest):
            return False  # a quoted question with an answer below
        a = re.sub(r"(?m)^\s*>+", " ", a)
    a = _ASKED_AGAIN.sub("", a)
    core, got = _letters(core_question(prompt)), _letters(a)
    if len(core) < 8 or len(got) < 0.85 * len(core):
        return False
    whole = _letters(prompt)
    if not may_copy(whole, got):
        return False
    n = copied(whole, got, 6)
    return n >= 0.97 * len(got) and n >= 0.85 * len(core)


def is_refusal(answer: str) -> bool:
    a = _TAG.sub(" ", _FENCE.sub(" CODE_BLOCK_HERE ", _bare(answer)))
    return _declined("\n".join(x for x in a.split("\n") if not x.lstrip().startswith(">")))


def _open_end(answer: str) -> bool:
    """Delimiters left open: fences, tags, brackets, quotes of structured text."""
    if answer.count("```") % 2:
        return True
    a = _FENCE.sub(" ", answer)
    tags: list[str] = []
    for m in re.finditer(r"<(/?)([A-Za-z_][\w-]*)>", a):
        if not m.group(1):
            tags.append(m.group(2))
        elif m.group(2) in tags:
            while tags.pop() != m.group(2):
                pass
    if tags or re.search(r"</?[A-Za-z_]*\Z", a):
        return True
    stack: list[str] = []
    quoted = False
    for m in _DELIMITER.finditer(a):
        c = m.group()
        if c == '"' and (stack and stack[-1] in "}]") and a[m.start() - 1] != "\\":
            quoted = not quoted
        elif quoted:
            continue
        elif c in PAIRED:
            stack.append(PAIRED[c])
        elif stack and stack[-1] == c:
            stack.pop()
    return bool(stack) or quoted


def _tokens(s: str) -> list[str]:
    return ["#" if x[0].isdigit() else x.lower() for x in _TOKEN.findall(s)]


def _segments(answer: str) -> list[str]:
    a = _TAG.sub("\n", _FENCE.sub("\n", _bare(answer)))
    return [x for x in (_ITEM.sub("", s).strip() for s in _SENT.split(a)) if x]


def _key(tokens: list[str], n: int) -> str:
    return " ".join(tokens[-n:])


def tail(answer: str) -> tuple[bool, list[str]]:
    """(breaks off, tokens): surely broken off; or the last words, if only they can tell; else neither."""
    if _open_end(answer):
        return True, []
    a = _bare(answer).rstrip()
    if a.endswith("```") or not a:
        return False, []
    a = re.sub(r"(?:</[A-Za-z_][\w-]*>\s*)+\Z", "", a).rstrip()
    if a.endswith(("…", "...", ",", "，", "、", "；", ";", "：", ":", "(", "（", "[", "{", "=", "→")):
        return True, []
    if re.search(r"</[A-Za-z_][\w-]*>\Z|[}\]]\Z", a):
        return False, []
    core = a.rstrip(_CLOSERS)
    if not core or core[-1] in _END or a[-1] in "}]>|" or re.fullmatch(r"[!-~]+", a):
        return False, []
    lines = [x for x in _TAG.sub("\n", _FENCE.sub("\n", a)).split("\n") if x.strip()]
    if not lines:
        return False, []
    last = lines[-1]
    segment = [s for s in _SENT.split(last) if s.strip()][-1:] or [last]
    tokens = _tokens(segment[0])
    if len(tokens) < 4:
        if len(segment[0]) < len(last.strip()) or (len(lines) == 1 and len(_segments(a)) > 1):
            return True, []  # a few words begun behind a full stop
        if not (_ITEM.match(last) and len(lines) > 1):
            return False, []  # a label, a value, a name
    items = [x for x in lines if _ITEM.match(x)]
    if not _ITEM.match(last) and len(_SENT.split(last.strip())) > 1 and last.strip()[:-1].count(".") + last.count("。"):
        inner = [s for s in _SENT.split(last) if s.strip()]
        if len(inner) > 1:
            return True, []  # earlier sentences of the line are closed, the last isn't
    if _ITEM.match(last) and len(items) > 1:
        before = items[:-1]
        stopped = sum(x.rstrip().rstrip(_CLOSERS)[-1:] in _END for x in before)
        if stopped == len(before):
            return True, []
    elif len(lines) > 1 and not _ITEM.match(last):
        if re.fullmatch(r"[^.。]{0,16}[:：=→]?\s*[-+]?[\d.,%]+", last.strip()):
            return False, []
    return False, tokens


def judge(prompt: str | None, answer: str | None) -> tuple[str | None, list[str]]:
    """(defect, tokens to look up). At most one defect; without prompt text the prompt-bound ones don't apply."""
    if answer is None or is_empty(answer):
        return "empty_answer", []
    prompt = transducer()(prompt) if prompt else prompt
    if prompt and is_copy(prompt, answer):
        return "copied_question", []
    if is_refusal(answer):
        return "refusal", []
    broken, tokens = tail(answer)
    if broken:
        return "truncated_answer", []
    if prompt:
        own = "\n".join(x for x in _bare(answer).split("\n") if not x.lstrip().startswith(">"))
        q, a = language(core_question(prompt)), language(own)
        if q and a and q != a and not ({q, a} & {"zh"} and q[:2] == a[:2]):
            asked = asked_languages(prompt)
            if a not in asked and not (a.startswith("zh") and "zh" in asked and not asked & {"zh_hant", "zh_hans"}):
                return "wrong_language", []
    return None, tokens


def _answers(messages: list | None) -> Iterator[tuple[int, str | None, str | None]]:
    prompt, seen = None, False
    for i, m in enumerate(messages or []):
        role = ((m or {}).get("role") or "").strip().lower()
        if role == "user":
            prompt, seen = m.get("content"), True
        elif role == "assistant" and seen:
            yield i, prompt, m.get("content")


def judged_pairs(records: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """(key, message_pos, defect, tail2, tail1): every assistant message that has a user message
    before it; tails are set where the corpus must decide. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, defect, t2, t1 = [], [], [], [], []
            for i, ms in enumerate(b.column(1).to_pylist()):
                for p, prompt, answer in _answers(ms):
                    d, tokens = judge(prompt, answer)
                    at.append(i), pos.append(p), defect.append(d)
                    t2.append(_key(tokens, 2) if tokens and not d else None)
                    t1.append(_key(tokens, 1) if tokens and not d else None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *[pa.array(x, pa.string()) for x in (defect, t2, t1)]], [key, "message_pos", "defect", "tail2", "tail1"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, messages).mapInArrow(run, f"{key} {kind}, message_pos int, defect string, tail2 string, tail1 string")


def _slots(grams: list[str], bits: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for g in grams), np.int64, len(grams))


def wanted_bits(wanted: DataFrame, gram: str, bits: int = 24) -> np.ndarray:
    """A bitmap of the hashes of all wanted grams, 2 MB for 24 bits whatever their number. With very many
    of them it is full and lets all pass, which only costs shuffle."""
    at = (F.crc32(F.col(gram)) % (1 << bits)).cast("bigint") + 1  # bitmap positions count from 1
    per = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << bits, bool)
    for r in per.collect():  # at most 2 ** bits / 32768 lines of 4 kB
        got = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        out[np.flatnonzero(got) + (r["bucket"] - 1) * 32768] = True
    return out


def ending_counts(records: DataFrame, messages: str = "messages", wanted: np.ndarray | None = None) -> DataFrame:
    """(gram, n, n_final): how often one or two words occur in answers and how often they end a
    sentence or list item that another follows. Summed per batch before the shuffle; of the grams only
    those go there that may be wanted (all without `wanted`)."""
    bits = None if wanted is None else int(len(wanted)).bit_length() - 1
    packed = None if wanted is None else np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if packed is None else np.unpackbits(packed).astype(bool)
        for b in batches:
            n, final = Counter(), Counter()
            for ms in b.column(0).to_pylist():
                for _, _, answer in _answers(ms):
                    parts = [_tokens(s) for s in _segments(answer)] if answer else []
                    for j, t in enumerate(parts):
                        n.update(t)
                        n.update(f"{x} {y}" for x, y in zip(t, t[1:]))
                        if j + 1 < len(parts) and t:
                            final[t[-1]] += 1
                            if len(t) > 1:
                                final[f"{t[-2]} {t[-1]}"] += 1
            grams = list(n)
            if keep is not None:
                grams = [grams[i] for i in np.flatnonzero(keep[_slots(grams, bits)])]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([n[g] for g in grams], pa.int64()), pa.array([final[g] for g in grams], pa.int64())], ["gram", "n", "n_final"])

    made = records.select(messages).mapInArrow(run, "gram string, n bigint, n_final bigint")
    return made.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))


def defective_pairs(records: DataFrame, judged: DataFrame, key: str, prior: float = PRIOR, share: float = 0.035) -> DataFrame:
    """(key, message_pos, defect). An open tail breaks off if its last two words end sentences more rarely than
    `share`. The rate of the two words is drawn towards that of the last word alone, as if that had been
    seen `prior` times, so rare pairs lean on the word and often seen ones on themselves, without a step.
    `judged` is read twice: give it cut."""
    open_ = judged.where("defect IS NULL AND tail1 IS NOT NULL")
    wanted = open_.select(F.explode(F.array("tail1", "tail2")).alias("gram")).distinct()
    counts = ending_counts(records, wanted=wanted_bits(wanted, "gram"))
    two = counts.select(F.col("gram").alias("tail2"), F.col("n").alias("n2"), F.col("n_final").alias("f2"))
    one = counts.select(F.col("gram").alias("tail1"), F.col("n").alias("n1"), F.col("n_final").alias("f1"))
    d = open_.join(two, "tail2", "left").join(one, "tail1", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    alone = zero("f1") / F.greatest(zero("n1"), F.lit(1))
    rate = (zero("f2") + prior * alone) / (zero("n2") + prior)
    late = d.where(rate < share).select(key, "message_pos", F.lit("truncated_answer").alias("defect"))
    return judged.where("defect IS NOT NULL").select(key, "message_pos", "defect").unionByName(late)

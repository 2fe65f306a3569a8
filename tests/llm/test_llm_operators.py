import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm import containers, lookalike, mix, mojibake, overlap, pairs, sample, segments, splits, tokens


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 tokens


def _greedy(entries, text):
    n = i = 0
    while i < len(text):
        k = max((k for k in range(1, len(text) - i + 1) if text[i : i + k] in entries), default=1)
        i, n = i + k, n + 1
    return n


def test_longest_match_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        entries = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 15))}
        entries |= {b"a", b"b"} if rng.random() < 0.5 else set()
        m = tokens.LongestMatch(entries)
        for _ in range(40):
            t = bytes(rng.choices(b"abcd", k=rng.randrange(0, 25)))
            assert m.count(t) == _greedy(entries, t), (entries, t)


def test_token_counts(spark):
    text = "The mean is 3.5, isn't it?  先验的中心为 0.77\n\tÜbersehen"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "a" * 200_000, "w")], "id int, text string, tokens string")
    got = {r["id"]: r for r in tokens.with_token_counts(df, "text", merges="merge_tokens").collect()}
    entries = set(tokens.read_ranks(tokens.vocabulary_path()))
    import regex

    want = sum(_greedy(entries, p.encode()) for p in regex.findall(tokens.PATTERN, text))
    assert got[1]["tokens"] == want and got[1]["merge_tokens"] >= want * 0.8
    assert (got[2]["tokens"], got[3]["tokens"]) == (0, 0) and got[4]["tokens"] > 0
    assert tokens.with_token_counts(df.where("false"), "text").count() == 0
    b = tokens.budget(tokens.with_token_counts(df.withColumn("chars", F.length("text")), "text", merges="merge_tokens"), ["id"])
    assert b.count() == 4


# 2 splits

_SCEN = "scenario_row bigint, blueprint_id string, author_id string, split string, search struct<parent_blueprint_id:string,generation:int,novelty:double>, group_row int"


def _scenarios(spark, seed, n=250):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = rng.choice([None] * 8 + [f"B{rng.randrange(120)}", "gone"])
        rows.append((i + 1, rng.choice([f"B{rng.randrange(120)}", f" b{rng.randrange(120)}  ", None]), rng.choice([None, " N/A ", "Unknown", "", f"w{rng.randrange(90)}"]), rng.choice(["train", " TRAIN", "valid", "dev", None]), (parent, 1, 0.5) if parent else None, 7))
    return rows, spark.createDataFrame(rows, _SCEN)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_union_find(spark, seed):
    rows, df = _scenarios(spark, seed)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    key = lambda v: (v or "").strip().lower() or None
    by = defaultdict(list)
    for r in rows:
        if key(r[1]):
            by["b", key(r[1])].append(r[0])
        if key(r[2]) not in (None, "unknown", "n/a", "none", "anonymous"):
            by["a", r[2]].append(r[0])
    for r in rows:
        p = key(r[4][0]) if r[4] else None
        if p and ("b", p) in by:
            by["b", p].append(r[0])
    for g in by.values():
        for x in g[1:]:
            a, b = find(g[0]), find(x)
            root[max(a, b)] = min(a, b)
    want = {r[0]: find(r[0]) for r in rows}
    g = splits.related_groups(df.drop("group_row"))
    assert {r["scenario_row"]: r["group_row"] for r in g.collect()} == want
    seen = defaultdict(set)
    for r in rows:
        if key(r[3]):
            seen[want[r[0]]].add(key(r[3]))
    assert sorted(r["scenario_row"] for r in splits.broken_groups(g).collect()) == sorted(x for x, t in want.items() if len(seen[t]) > 1)


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(i + 1, f"b{i}" if i > 300 else f"hot{i % 7}", None, "train", None, 0) for i in range(1500)]
    g = splits.related_groups(spark.createDataFrame(rows, _SCEN).drop("group_row"))
    out = splits.assign_splits(g, [("train", 0.8), ("valid", 0.1), ("test", 0.1)]).collect()
    assert len(out) == len(rows)
    per = defaultdict(set)
    for r in out:
        per[r["group_row"]].add(r["new_split"])
    assert all(len(v) == 1 for v in per.values())
    n = Counter(r["new_split"] for r in out)
    assert abs(n["train"] - 1200) <= 1 and abs(n["valid"] - 150) <= 1
    assert splits.assign_splits(g.where("false"), [("train", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(g, [])


def test_flow_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        supply, cost = rng.integers(1, 6, 3).astype(float), rng.integers(0, 5, (3, 2)).astype(float)
        quota = np.array([supply.sum() // 2, supply.sum() - supply.sum() // 2])
        x = splits.min_cost_flow(supply, cost, quota, 100.0)
        assert np.allclose(x.sum(1), supply) and np.allclose(x.sum(0), quota)
        best = min(
            sum(cost[b, 0] * k[b] + cost[b, 1] * (supply[b] - k[b]) for b in range(3))
            for k in np.ndindex(*(int(s) + 1 for s in supply))
            if sum(k) == quota[0]
        )
        assert (x * cost).sum() == pytest.approx(best)


# 3 look-alikes


def test_common_form():
    t = lookalike.transducer()
    same = ["Señada ５%", "Señada 5%", "Ѕеñаda 5%", "Señ​ada 5％", "Se­ñada 5%", "﻿Seйada"[:1] + "Señada 5%"]
    assert len({t(x) for x in same}) == 1
    assert t("ﬁle‑a ⼀") == "file-a 一" and t("o̸") == "ø"
    for a, b in (("R²", "R2"), ("Resume", "Résumé"), ("A", "a"), ("x1", "xl"), ("a b", "ab"), ("½", "1/2")):
        assert t(a) != t(b)
    for x in [*same, "R² ≤ 3", "中文，測試？", "", "\U0001d400bc"]:
        assert t(t(x)) == t(x)
    assert t("\U0001d400bc") == "Abc"
    rng = random.Random(3)
    pool = [*t.single, *"aeiouAZ19 -", "\u0301", "\u0308", "中", "é", "и"]
    for _ in range(3000):
        x = "".join(rng.choices(pool, k=rng.randrange(1, 7)))
        assert t(x) == t._find.sub(t._cluster, x), x


def test_same_look_pairs(spark):
    rows = [(1, "ab c"), (2, "ab c"), (3, "ab c"), (4, "AB c"), (5, None), (6, ""), (7, "​"), (8, "аb c")]
    c = lookalike.look_classes(spark.createDataFrame(rows, "k int, text string"), "text", "k")
    assert rows_of(lookalike.same_look_pairs(c, "k")) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    assert {r["k"]: r["class_key"] for r in lookalike.same_look_groups(c, "k").collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 6: 6, 7: 6}
    assert lookalike.same_look_pairs(c.where("false"), "k").count() == 0


def test_same_look_pairs_of_many_copies(spark):
    """Two texts with many copies, one with many spellings: all slots in use, each pair once."""
    pad = ["", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff"]
    rows = [(i, "a b") for i in range(300)] + [(1000 + i, "a\u00a0b") for i in range(3)]
    rows += [(2000 + i, "".join(pad[i // 6**j % 6] + c for j, c in enumerate("xyz"))) for i in range(80)]
    c = lookalike.look_classes(spark.createDataFrame(rows, "k int, text string"), "text", "k")
    want = [(i, 1000 + j) for i in range(300) for j in range(3)] + [(2000 + i, 2000 + j) for i in range(80) for j in range(i + 1, 80)]
    assert rows_of(lookalike.same_look_pairs(c, "k", least=10)) == sorted(want, key=repr)
    assert rows_of(lookalike.same_look_pairs(c, "k")) == sorted(want, key=repr)


# 5 pairs

_Q = "For study SQ-1 we have two arms and a continuous outcome. How should we compare the arms?\n\nOptions:\nA. ols\nB. welch_t"
_ZH = "請檢查專案 SQ-2：缺陷數有缺失，而且與飼料有關，哪種分析站得住腳？"


@pytest.mark.parametrize(
    "prompt, answer, defect",
    [
        (_Q, None, "empty_answer"),
        (_Q, " ​　", "empty_answer"),
        (_Q, "**Answer:** n/a", "empty_answer"),
        (_Q, "<answer></answer>", "empty_answer"),
        (_Q, "B", None),
        (_Q, "0.35", None),
        (_Q, "blocked_time_series_cv", None),
        (_Q, _Q, "copied_question"),
        (_Q, "Question: " + _Q.split("\n")[0].upper(), "copied_question"),
        (_Q, "> " + _Q.split("\n")[0], "copied_question"),
        (_Q, "> " + _Q.split("\n")[0] + "\n\nUse Welch.", None),
        (_Q, "I'm sorry, but I can't help with that. Please consult a professional.", "refusal"),
        (_Q, "I cannot recommend plain least squares here; use Welch's interval because the variances of the arms differ.", None),
        (_Q, "Sorry, I am not able to answer that. Use Welch's interval.", None),
        (_ZH, "很遺憾，這件事我不方便表示看法。歡迎改問別的題目。", "refusal"),
        (_Q, "Use Welch's interval, because the variances of the two arms differ. Report the", "truncated_answer"),
        (_Q, "```python\nfit = run(", "truncated_answer"),
        (_Q, '<plan>{"tool":"r","checks":["', "truncated_answer"),
        (_Q, "Which unit was assigned at random?", None),
        (_ZH, "The remaining bias of the estimate is the one that comes from units without a chance.", "wrong_language"),
        (_ZH + "請用英文回答。", "The remaining bias of the estimate is the one that comes from units without a chance.", None),
        (_ZH, "剩下的偏误来自从未有机会接受饲料的单位，应该报告估计值与区间。", "wrong_language"),
        (_ZH, "剩下的偏誤來自從未有機會接受飼料的單位，應該報告估計值與區間。", None),
        (_Q, "Les données manquantes dépendent du traitement, donc l’analyse est biaisée.", "wrong_language"),
    ],
)
def test_judge(prompt, answer, defect):
    assert pairs.judge(prompt, answer)[0] == defect


#: Written after the classes were fixed (but for one word, leid), with none of the tables' wordings.
_DECLINING = {
    "en": ["As a language model I have no opinion to share on this.", "I'm afraid this is something I do not talk about.", "My policies prevent me from answering that.", "We are not allowed to comment on this request.", "I must abstain from giving advice on this topic.", "That is beyond what I can discuss. Try asking a specialist.", "I'm not comfortable answering this. Is there another question?", "It isn't possible for me to respond to this request.", "I don't give opinions on such matters.", "No comment.", "Sorry! I will not engage with this question."],
    "fr": ["Désolé, je ne peux pas vous répondre.", "Je refuse de commenter ce sujet.", "Je préfère ne pas donner mon avis sur cette question.", "Il ne m'est pas possible de vous aider.", "Malheureusement, je ne suis pas autorisé à discuter de cela. Merci de consulter un spécialiste."],
    "de": ["Dazu kann ich leider keine Auskunft geben.", "Diese Frage möchte ich nicht beantworten.", "Ich darf mich zu diesem Thema nicht äußern.", "Leider bin ich nicht in der Lage, Ihnen zu helfen.", "Es tut mir leid, das darf ich nicht kommentieren. Bitte fragen Sie einen Experten."],
    "es": ["Lo siento, no puedo ayudarle con eso.", "Prefiero no comentar este tema.", "No estoy autorizado a responder a esa pregunta.", "Debo declinar esta solicitud."],
    "zh": ["抱歉，我無法回應這個話題，不便討論。", "對不起，我不能就此發表意見。", "这个问题我不方便回答。", "这超出了我的权限，恕无法提供建议。", "本人拒絕回答此問題。", "我们不予评论。"],
}
_ANSWERING = ["Patients were not allowed to switch arms.", "Subjects are not permitted to cross over between arms.", "I can't answer this without knowing the number of sites.", "We cannot answer the causal question from these data.", "I would not report the p-value; report the interval.", "Do not comment on significance.", "The model does not allow random slopes.", "We do not reject the null hypothesis.", "Participants could not discuss their assignment with staff.", "Before I can help, please tell me how the arms were assigned.", "I can't recommend a t test, but a rank test holds up here.", "No.", "Ask a statistician.", "這份資料無法回答因果問題。", "需要先知道隨機化單位，才能建議方法。", "受試者不得討論分組。", "不建議使用普通迴歸，改用秩檢定。", "我無法建議使用普通最小平方法；逆傾向加權較好。", "Les patients n'ont pas été autorisés à changer de groupe.", "Die Probanden durften den Arm nicht wechseln.", "No se permite cambiar de grupo."]


def test_refusals_by_word_classes():
    found = {k: sum(pairs.judge(None, x)[0] == "refusal" for x in v) / len(v) for k, v in _DECLINING.items()}
    assert min(found.values()) >= 0.8 and sum(pairs.judge(None, x)[0] == "refusal" for v in _DECLINING.values() for x in v) >= 0.9 * sum(map(len, _DECLINING.values())), found
    assert [x for x in _ANSWERING if pairs.judge(None, x)[0] == "refusal"] == []


def test_pretest_of_copies_is_safe():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choices("abcd", k=60))
        t = "".join(text[i : i + rng.randrange(5, 9)] for i in rng.choices(range(50), k=rng.randrange(1, 12)))
        if pairs.copied(text, t, 6) >= 0.97 * len(t):
            assert pairs.may_copy(text, t)
    assert not pairs.may_copy("abc" * 20, "xyz" * 20)


def test_wanted_bits(spark):
    grams = ["a", "b c", "", "é", "x y"]
    bits = pairs.wanted_bits(spark.createDataFrame([(g,) for g in grams], "gram string"), "gram", 16)
    at = pairs._slots(grams, 16)
    assert bits[at].all() and bits.sum() == len(set(at.tolist()))
    assert not pairs.wanted_bits(spark.createDataFrame([], "gram string"), "gram", 16).any()


def test_suffix_automaton_against_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(0, 30))) for _ in range(2))
        least = rng.randrange(1, 5)
        covered = set()
        for i in range(len(b)):
            for j in range(i + least, len(b) + 1):
                if b[i:j] in a:
                    covered.update(range(i, j))
        assert pairs.copied(a, b, least) == pairs.copied(a, b, least, block=rng.randrange(1, 9)) == len(covered)


def test_defective_pairs(spark):
    items = ["- Report the estimate with its interval", "- Shrink by the factor and move the origin forward"]
    full = "\n".join(items * 6)
    data = [(1, [("user", _Q), ("assistant", full)]), (2, [("user", _Q), ("assistant", full + "\n- Report the estimate with")]), (3, None), (4, []), (5, [("assistant", None), ("user", None), ("assistant", None)]), (6, [None])]
    df = spark.createDataFrame(data, "record_id bigint, messages array<struct<role:string,content:string>>")
    got = rows_of(pairs.defective_pairs(df, pairs.judged_pairs(df, "record_id"), "record_id"))
    assert got == [(2, 1, "truncated_answer"), (5, 2, "empty_answer")]


# 6 overlaps


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    bounds = spark.createDataFrame([("fam_a", "p", 0.0, 2.0), ("fam_a", "q", 10.0, 30.0), ("fam_b", "p", 0.0, 1.0)], "family_id string, parameter_name string, lower_bound double, upper_bound double")
    base = [{"p": rng.uniform(0, 2), "q": rng.uniform(10, 30)} for _ in range(12)]
    rows = []
    for i in range(700):
        b = dict(rng.choice(base))
        if rng.random() < 0.6:
            b["p"] += rng.uniform(-0.012, 0.012)
            b["q"] += rng.uniform(-0.12, 0.12)
        if rng.random() < 0.1:
            b[rng.choice("pq")] = rng.choice([None, float("nan"), float("inf")])
        if rng.random() < 0.1:
            b.pop(rng.choice(sorted(b)))
        b["extra"] = rng.random()
        rows.append((i, rng.choice(["FAM-A", "fam_a ", "fam_b", None]), rng.choice(["train", "Valid", "dev ", "final", None, "other"]), rng.choice([b, b, b, None]), "s"))
    df = spark.createDataFrame(rows, "scenario_row bigint, family_id string, split string, parameters map<string,double>, source string")
    width = {"fam_a": {"p": 2.0, "q": 20.0}, "fam_b": {"p": 1.0}}
    good = []
    for i, f, s, p, _ in rows:
        f, s = (f or "").strip().lower().replace("-", "_"), (s or "").strip().lower()
        if f in width and s in ("train", "valid", "dev", "final") and p and all(p.get(k) is not None and np.isfinite(p[k]) for k in width[f]):
            good.append((i, f, s == "train", p))
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for a in good if a[2] for b in good if not b[2] and a[1] == b[1] and max(abs(a[3][k] - b[3][k]) / w for k, w in width[a[1]].items()) <= 0.005)
    assert len(want) > 50
    p, m = overlap.near_pairs(overlap.vectors(df, bounds))
    assert sorted(map(tuple, overlap.row_pairs(p, m).collect())) == want
    report = overlap.overlap_report(p, m).collect()
    hit = {x for w in want for x in w}
    assert sum(r["n_exact"] + r["n_near"] for r in report) == len(hit)
    p, m = overlap.near_pairs(overlap.vectors(df.where("false"), bounds))
    assert overlap.row_pairs(p, m).count() == 0


def test_pairs_of_many_copies(spark):
    pairs_ = spark.createDataFrame([(1, 2), (1, 50), (7, 2)], "class_a bigint, class_b bigint")
    rows = [(100 + i, True, 1) for i in range(40)] + [(200, True, 7), (90, False, 2)] + [(300 + i, False, 50) for i in range(9)]
    members = spark.createDataFrame([(r, "s", "x", t, c) for r, t, c in rows], "scenario_row bigint, source string, split string, is_train boolean, class bigint")
    want = sorted((min(a, b), max(a, b)) for a, t, c in rows if t for b, u, e in rows if not u and (c, e) in {(1, 2), (1, 50), (7, 2)})
    for least in (5, 20_000):
        assert sorted(map(tuple, overlap.row_pairs(pairs_, members, least).collect())) == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_signs_meet_whatever_is_near():
    rng = random.Random(15)
    for _ in range(1500):
        k = rng.randrange(0, 4)
        a = "".join(rng.choices("ab中", k=rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, k + 2)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "x"])
        b = "".join(b)
        if _edits(a, b) <= k:
            assert segments.evaluation_signs(a, k) & segments.training_signs(b, k), (a, b, k)


@pytest.mark.parametrize("least", [3, 20_000])
def test_near_strings_against_all_pairs(spark, least):
    rng = random.Random(16)
    base = ["".join(rng.choices("abcd", k=rng.randrange(0, 16))) for _ in range(12)]
    rows = []
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "e"])
        rows.append((i, "".join(t), rng.choice([True, False])))
    rows += [(900, None, True), (901, "abc", None)]
    p, m = segments.near_strings(spark.createDataFrame(rows, "k int, t string, train boolean"), "k", "t", F.col("train"), 2, least)
    first = {}
    for i, t, s in rows:
        if t is not None and s is not None:
            first.setdefault((t, s), i)
    want = sorted((x, y, _edits(t, u)) for (t, s), x in first.items() if s for (u, v), y in first.items() if not v and _edits(t, u) <= 2)
    assert sorted(map(tuple, p.collect())) == want
    assert sorted((r["k"], r["class"]) for r in m.collect()) == sorted((i, first[t, s]) for i, t, s in rows if t is not None and s is not None)
    assert segments.near_strings(spark.createDataFrame([], "k int, t string, train boolean"), "k", "t", F.col("train"))[0].count() == 0


# 7 sample


def test_sample_shares_floors_and_reports(spark):
    rows = [(i, f"t{i}" if i % 10 else "t1", "en" if i % 3 else "ZH-Hant", "fam_a" if i % 2 else None) for i in range(1, 600)] + [(999, None, "en", "fam_a")]
    df = spark.createDataFrame(rows, "canary_row bigint, task_id string, language string, family_id string")
    t = spark.createDataFrame([("en", "fam_a", 0.7, 5, 60), ("zh_Hant", "fam_a", 0.001, 4, 60), ("en", "missing", 0.299, 1, 60)], "language string, family_id string, target_share double, min_rows bigint, sample_size bigint")
    cats = ["language", "family_id"]
    s = sample.stratified_sample(df, t, "task_id", cats, "canary_row").collect()
    n = Counter((r["language"], r["family_id"]) for r in s)
    assert len({r["task_id"] for r in s}) == len(s)
    assert n["en", "fam_a"] in (42, 43) and n["zh_hant", "fam_a"] == 4
    items = sample.cell_items(df, "task_id", cats)
    assert rows_of(sample.short_cells(items, t, cats)) == [("en", "missing")]
    again = sample.stratified_sample(df.repartition(7), t, "task_id", cats, "canary_row").collect()
    assert sorted(r["task_id"] for r in again) == sorted(r["task_id"] for r in s)
    assert sample.stratified_sample(df.where("false"), t, "task_id", cats, "canary_row").count() == 0


# 8 containers


def test_fullest_against_brute_force():
    rng = random.Random(11)
    for _ in range(80):
        cap = rng.randrange(5, 40)
        items = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 9))]
        counts = Counter(items)
        combo = containers.fullest(dict(counts), sorted(counts, reverse=True), cap)
        seed = max(items)
        rest = list(items)
        rest.remove(seed)
        best = max(seed + s for m in range(1 << len(rest)) if (s := sum(x for i, x in enumerate(rest) if m >> i & 1)) + seed <= cap)
        assert sum(a * n for a, n in combo.items()) == best and all(counts[a] >= n for a, n in combo.items())


def test_containers(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 1, 7, 30, 64, 65, 200, rng.randrange(1, 64)])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    out = containers.fill_containers(df, "doc_id", "n", "k", 64).collect()
    fill, got = Counter(), Counter()
    for r in out:
        got[r["doc_id"]] += r["tokens"]
        if r["container_no"] is not None:
            fill[r["container_no"]] += r["tokens"]
        assert r["tokens"] == 0 or r["container_no"] is not None
    assert got == Counter(dict(rows)) and max(fill.values()) <= 64
    whole = Counter(r["doc_id"] for r in out)
    assert all(whole[i] == max(1, -(-n // 64)) for i, n in rows)
    assert len(fill) <= -(-sum(n for _, n in rows) // 64) + 2 and sorted(fill) == list(range(len(fill)))
    assert containers.fill_containers(df.where("false"), "doc_id", "n", "k", 64).count() == 0


# 9 mix


def test_mix(spark):
    rng = random.Random(13)
    rows = [(i, rng.choice(["A", " a ", "a"]) if i % 10 else "b", rng.randrange(1, 300)) for i in range(3000)] + [(9001, None, 5), (9002, "zzz", 5), (9003, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mix.mix_sources(df, t, "doc_id", "source", "n").cache()
    r = {x["source"]: x for x in mix.mix_report(m, t).collect()}
    assert r["a"]["share"] == pytest.approx(0.5 / 0.9, abs=0.01) and r["b"]["most_copies"] <= 3 and r["none"]["tokens_taken"] == 0
    assert m.where("copies < 0").count() == 0 and m.where("doc_id IN (9001, 9002)").count() == 0
    big = mix.mix_report(mix.mix_sources(df, t, "doc_id", "source", "n", total=1e9), t).collect()
    assert {x["source"]: x["most_copies"] for x in big} == {"a": 1, "b": 3, "none": 0}
    assert mix.mix_sources(df.where("false"), t, "doc_id", "source", "n").count() == 0


# 10 encodings


def _corpus():
    rng = random.Random(14)
    en = ["The team’s first draft ignored that visits were nested in {} sites.", "Calibration at Brühlau was off: predicted risk exceeded {} points.", "Costs rose by £{} per site, which the group called “tolerable”.", "Readers outside Élorne should not generalise from {} patients."]
    de = ["Übersehen wurde, dass {} Zähler gemeinsam geeicht wurden.", "Für größere Stichproben wäre die Näherung {} zulässig.", "Die Streuung wächst mit dem Schätzwert um {}."]
    zh = ["没有人确认恢复时间是在第 {} 次测量之前还是之后。", "两组变异数之比约为 {}，而样本数相差很大。", "结论仅适用于 {} 个场域，不应推广到其他场域。"]
    return [(lang, s.format(rng.randrange(10, 999))) for lang, pool in (("en", en), ("de", de), ("zh_hans", zh)) for s in pool for _ in range(60)]


def test_mojibake_round_trip(spark):
    clean = _corpus()
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(clean)], "doc_id bigint, text string, lang string")
    d = mojibake.train_dictionaries(docs, "text", "lang")
    assert set(d) == {"en", "de", "zh_hans"}
    assert mojibake.repaired(docs, d, "doc_id", "text", "lang").count() == 0
    assert len(mojibake.train_dictionaries(docs, "text", "lang", most_languages=2)) == 2
    bad = [(lang, t, t.encode("utf-8").decode(wrong), wrong) for (lang, t), wrong in zip(clean[::7], ["latin-1", "cp437", "mac_roman"] * 100)]
    bad += [(lang, t, t.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"), "twice") for lang, t in clean[::11]]
    bad += [(lang, t, t.encode("gbk").decode("latin-1"), "gbk") for lang, t in clean if lang == "zh_hans"][::5]
    bad = [b for b in bad if b[1] != b[2]]
    frame = spark.createDataFrame([(i, b[2], b[0]) for i, b in enumerate(bad)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["restored"] for r in mojibake.repaired(frame, d, "doc_id", "text", "lang").collect()}
    right = sum(got.get(i) == b[1] for i, b in enumerate(bad))
    assert len(got) >= 0.98 * len(bad) and right >= 0.95 * len(bad)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "plain", "en"), (4, "L�then ist", "de"), (5, "Brühlau " * 20_000, None)], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["lost"] for r in mojibake.repaired(odd, d, "doc_id", "text", "lang").collect()} == {4: True}
    assert mojibake.repaired(odd.where("false"), {}, "doc_id", "text", "lang").count() == 0



def test_mojibake_usual_units():
    """What is known is skipped, garbled words among sound ones are never known."""
    clean = ["Für spätere Stichproben wäre die Näherung {} zulässig."] * 30 + ["An earlier memo from the station «Верхний луг» reports {}."] * 30
    bad = [c.encode("utf-8").decode("gbk", "replace") for c in clean[:40:8]] + [c.encode("utf-8").decode("latin-1") for c in clean[:40:8]]
    kept = mojibake.sound([c.format(i) for i, c in enumerate(clean)] + bad)
    assert kept and all("Ã" not in x and "盲" not in x for x in kept)
    known = mojibake.usual_units(kept)
    assert {"Für", "spätere", "wäre", "«Верхний"} <= known and not known & {"w盲re", "fÃ¼r", "芦袙"}
    repair = mojibake.Repair({"de": mojibake.Model(mojibake.dictionary(kept), known)})
    assert repair.text("Für spätere Stichproben wäre 7.", "de") == ("Für spätere Stichproben wäre 7.", [], False)
    assert repair.text("F眉r sp盲tere Stichproben wäre die Näherung.", "de")[0] == "Für spätere Stichproben wäre die Näherung."
    assert repair.sentence.cache_info().currsize == 1


def test_mojibake_runs_between_two_byte_encodings():
    """Runs are read also where a lost character or a sound one outside the encoding stands in the sentence."""
    clean = ["因为资料有界且同分很多，删除高杠杆点之后，斜率由 {} 变为 {}。", "二次检验对估计效果的影响为 {}，残差图显示离散程度增加 {}。"]
    made = mojibake.dictionary([s.format(i, i * 7 % 50) for s in clean for i in range(300)])
    lengths = mojibake.Lengths({"zh_hans": made})
    run = "因为资料有界且同分很多"
    bad = run.encode("gbk").decode("big5")
    for other in ("�", "한"):
        text, chain = mojibake.repair_sentence(f"{other} {bad} 0.", "zh_hans", lengths)
        assert (text, chain) == (f"{other} {run} 0.", ["big5>gbk"])
    # sound headings beside such a character stay, though their runs can be read in another way
    for sound in ("� 斜率", "한 估计效果", "� 标准误差", "한 第二位审稿人"):
        assert mojibake.repair_sentence(sound, "zh_hans", lengths) == (sound, [])


def test_mojibake_models_come_from_all_texts(spark):
    """Words of texts with a large hash only, or of very long ones only, are usual too; dictionaries of blocks are merged."""
    from lodestat.operators.ordering import hash_order

    hashed = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string").withColumn("h", hash_order(0, F.col("text"))).orderBy("h").collect()
    base = hashed(f"Die Prüfung {i} war für alle gut." for i in range(2400))
    far = [r["text"] for r in hashed(f"Die Prüfung {i} war gut. Der Südpol ist kälter." for i in range(1500)) if r["h"] > base[1999]["h"]][:100]
    long_ = [f"Das Maß {i} ist gültig. " + "Es war so. " * 3000 for i in range(9)]
    docs = spark.createDataFrame([(t, "de") for t in [r["text"] for r in base] + far + long_ + long_], "text string, lang string")
    for per_block, words in ((2000, {"Maß", "gültig."}), (300, set())):
        m = mojibake.train_dictionaries(docs, "text", "lang", per_block=per_block, fan=4)["de"]
        assert len(far) == 100 and {"Prüfung", "für", "Südpol", "kälter."} | words <= m.known
        assert mojibake.Repair({"de": m}).text("Der SÃ¼dpol ist kÃ¤lter.", "de")[0] == "Der Südpol ist kälter."
    assert mojibake.train_dictionaries(docs.where("false"), "text", "lang") == {}

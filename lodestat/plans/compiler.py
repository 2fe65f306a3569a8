"""From a question and a column profile to a ranked list of procedure requests.

Works on the profile only: kinds of columns, columns the question names, wording cues in English and
Chinese. The rules of rules.py score procedures by these facts. A plan is ready if its roles are filled
and its score reaches READY, otherwise it says what is missing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.profile import profile
from lodestat.plans.procedures import CATALOGUE, Request, missing_roles
from lodestat.plans.rules import cues, scored

#: Score from which a plan is ready, levels of a categorical column, rows up to which a table of
#: two by two counts as sparse, share of zeros that speaks for a floor.
READY, MOST_LEVELS, FEW_ROWS, FLOOR_SHARE = 0.86, 12, 120, 0.08


@dataclass(frozen=True)
class Column:
    name: str
    kind: str  # identifier, binary, categorical, continuous, count, text
    unique: int
    missing: int
    minimum: float | None = None
    zero_fraction: float | None = None
    levels: tuple[str, ...] = ()
    rows: int = 0
    names: tuple[str, ...] = ()


@dataclass
class Plan:
    request: Request
    score: float
    missing: list[str] = field(default_factory=list)

    @property
    def ready(self) -> bool:
        return not self.missing and self.score >= READY


def kind_of(name: str, dtype: str, rows: int, unique: int, minimum: float | None) -> str:
    numeric = dtype in ("int", "bigint", "smallint", "tinyint", "double", "float") or dtype.startswith("decimal")
    if re.search(r"(^|_)(id|key|uuid|row)$", name.lower()) or (rows > 20 and unique == rows and not numeric):
        return "identifier"
    if unique == 2:
        return "binary"
    if not numeric:
        return "categorical" if unique <= MOST_LEVELS or (rows and unique / rows < 0.05) else "text"
    if dtype not in ("double", "float") and unique <= MOST_LEVELS:
        return "categorical"
    return "continuous"


def columns(df: DataFrame) -> list[Column]:
    """The profile with kinds; one row per column comes to the driver."""
    rows = df.count()
    return [Column(r["name"], kind_of(r["name"], r["dtype"], rows, r["unique"], r["minimum"]), r["unique"], r["missing"], r["minimum"], r["zero_fraction"], tuple(r["levels"] or ()), rows) for r in profile(df).collect()]


@dataclass(frozen=True)
class Entry:
    """What a glossary says of a column: its meaning, the kind it names, other names in quotes or brackets."""

    text: str
    kind: str | None = None
    names: tuple[str, ...] = ()


#: Words by which a glossary names a kind.
_KINDS = {
    "identifier": "identifier, unique id, 識別碼, 标识",
    "binary": "binary, yes/no, 0/1, indicator, 二元, 是否",
    "categorical": "categorical, category, factor, levels, nominal, ordinal, 類別, 类别, 分類, 分类",
    "continuous": "continuous, measured in, concentration, score, duration, 連續, 连续, 數值, 数值",
}


def parse_glossary(text: str) -> dict[str, Entry]:
    """Lines "column: meaning" (also with a dash, a wide colon, a bullet or as rows of a table); other lines say nothing.
    The first entry of a column counts."""
    out: dict[str, Entry] = {}
    for line in text.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")] if line.strip().startswith("|") else None
        m = re.match(r"^\s*[-*•]?\s*[`\"]?([A-Za-z_][\w.]*)[`\"]?\s*(?:[:：=]|\s[-–—])\s*(.+)$", line)
        name, meaning = (cells[0].strip("`\""), " ".join(cells[1:])) if cells and len(cells) > 1 else (m.group(1), m.group(2)) if m else (None, None)
        if not name or not re.fullmatch(r"[A-Za-z_][\w.]*", name) or not meaning or name in out:
            continue
        low = meaning.lower()
        kind = next((k for k, words in _KINDS.items() if any(w.strip() in low for w in words.split(","))), None)
        names = tuple(n.strip() for n in re.findall(r"[\"“「(（]([^\"”」)）]{2,40})[\"”」)）]", meaning))
        out[name] = Entry(meaning.strip(), kind, names)
    return out


def described(cols: Sequence[Column], glossary: dict[str, Entry]) -> list[Column]:
    """Columns with the kind and the other names of the glossary; a kind that the values contradict (text as a number,
    more than two values as binary) stays what the profile says."""
    out = []
    for c in cols:
        e = glossary.get(c.name)
        kind = e.kind if e else None
        fits = kind is not None and not (kind == "continuous" and c.kind == "text") and not (kind == "binary" and c.unique != 2)
        out.append(replace(c, kind=kind if fits else c.kind, names=e.names if e else ()))
    return out


def mentioned(cols: Sequence[Column], question: str) -> list[Column]:
    """Columns the question names, by their own or another name, in the order of their first mention."""
    q = question.lower()
    hits = []
    for c in cols:
        for name in (c.name, *c.names):
            words = re.escape(name.lower()).replace("_", "[_ ]")
            edge = "A-Za-z0-9_" if name.isascii() else ""
            m = re.search(rf"(?<![{edge}]){words}(?![{edge}])" if edge else words, q)
            if m:
                hits.append((m.start(), -len(name), c))
                break
    return [c for _, _, c in sorted(hits, key=lambda h: h[:2])]


def study_context(question: str) -> dict[str, str | None]:
    """Design and unit the question states: randomised, observational, cohort, cross-over and so on; "per ...", "each ...",
    "以...為單位"."""
    designs = {
        "randomized": r"randomi[sz]ed|random assignment|隨機分派|随机分配",
        "observational": r"observational|not randomi[sz]ed|觀察性|观察性",
        "cohort": r"\bcohort|世代研究|队列",
        "case_control": r"case[- ]control|病例對照|病例对照",
        "crossover": r"cross-?over|交叉設計|交叉设计",
        "cross_sectional": r"cross[- ]sectional|survey|橫斷|横断",
        "time_series": r"time series|時間序列|时间序列",
    }
    low = question.lower()
    order = ("observational", *[d for d in designs if d != "observational"])
    design = next((d for d in order if re.search(designs[d], low)), None)
    m = re.search(r"\b(?:per|each|every)\s+([a-z]+)|unit of analysis is (?:the\s+)?([a-z]+)|以(\S{1,8}?)[為为]單?单?位", low)
    return {"design": design, "unit": next((g for g in m.groups() if g), None) if m else None}


def owners(names: DataFrame, column: str, file: str) -> DataFrame:
    """(column, file, n_files): the file of each column name, null where several files have it, as a role may not
    rest on such a name."""
    g = names.select(column, file).distinct().groupBy(column).agg(F.count(F.lit(1)).alias("n_files"), F.min(file).alias("one"))
    return g.select(column, F.when(F.col("n_files") == 1, F.col("one")).alias(file), "n_files")


def null_probability(question: str) -> float | None:
    m = re.search(r"(\d+(?:\.\d+)?)\s*[%％]|百分之\s*(\d+(?:\.\d+)?)", question)
    if m and m.group(2):
        return float(m.group(2)) / 100
    if m:
        return float(m.group(1)) / 100
    m = re.search(r"(?:probability|proportion|chance|rate|機率|概率|比例)\s*(?:of|is|equals?|=|為|为|是|等於|等于)?\s*(0?\.\d+)", question.lower())
    return float(m.group(1)) if m else None


def alternative(question: str) -> str:
    q = question.lower()
    if re.search(r"greater|more than|exceed|higher|above|大於|大于|高於|高于|超過|超过|多於|多于", q):
        return "greater"
    return "less" if re.search(r"less than|fewer|lower|below|小於|小于|低於|低于|少於|少于|不足", q) else "two-sided"


_CLAUSE = re.compile(r"[.;\n。；]|，(?=(?:排除|剔除|只|僅|仅|去))|,\s*(?=(?:exclud|includ|only|restrict|drop|remov|and then|treat|cod))", re.I)


def declared(cols: Sequence[Column], question: str) -> tuple[list[dict], list[dict]]:
    """(row filters, recodes) the question states, clause by clause: levels behind words of exclusion are
    excluded, behind words of restriction included, and a level set against the rest is recoded. A level
    belongs to the column named in the clause, else to the only column that has it."""
    filters, recodes = [], []
    for clause in _CLAUSE.split(question):
        named = {c.name for c in mentioned(cols, clause)}
        hits: dict[str, list[str]] = {}
        for c in cols:
            for lv in c.levels:
                if len(lv) > 1 and not re.fullmatch(r"-?[\d.]+", lv) and re.search(rf"(?<![A-Za-z0-9_]){re.escape(lv)}(?![A-Za-z0-9_])", clause):
                    hits.setdefault(lv, []).append(c.name)
        by: dict[str, list[str]] = {}
        for lv, names in hits.items():
            own = [n for n in names if n in named] or names
            if len(own) == 1:
                by.setdefault(own[0], []).append(lv)
        against = re.search(r"\b(?:vs\.?|versus|against)\s+(?:the\s+|all\s+)?(?:rest|others?|remaining)|(?:對|对|相對於|相对于|相比|與|与)(?:其餘|其余|其他)", clause, re.I)
        for column, values in by.items():
            if against:
                recodes.append({"column": column, "positive_values": sorted(values)})
            elif re.search(r"\b(?:exclud\w*|drop\w*|remov\w*|without|except|omit\w*)\b|排除|剔除|去除|不含|去掉", clause, re.I):
                filters.append({"column": column, "operation": "exclude", "values": sorted(values)})
            elif re.search(r"\b(?:only|restrict\w*|includ\w*|among|limit\w*)\b|只看|僅限|仅限|限於|限于|只包含|只納入|只纳入", clause, re.I):
                filters.append({"column": column, "operation": "include", "values": sorted(values)})
    return filters, recodes


def prepared(cols: Sequence[Column], filters: Sequence[dict], recodes: Sequence[dict]) -> list[Column]:
    """The columns as they are after the declared steps: levels left, recoded ones binary."""
    out = []
    for c in cols:
        levels = set(c.levels)
        for f in filters:
            if f["column"] == c.name:
                levels = levels - set(f["values"]) if f["operation"] == "exclude" else levels & set(f["values"])
        if any(r["column"] == c.name for r in recodes):
            out.append(replace(c, kind="binary", unique=2, levels=("0", "1")))
        elif len(levels) != len(c.levels):
            out.append(replace(c, unique=len(levels), levels=tuple(sorted(levels)), kind="binary" if len(levels) == 2 else c.kind))
        else:
            out.append(c)
    return out


def roles_of(cols: Sequence[Column], question: str) -> dict:
    """Outcome, group, predictors and the special roles from what the question names, in its order; a role
    that only one unnamed column can fill is filled with it where the cue asks for it."""
    named = mentioned(cols, question)
    c = cues(question)
    roles: dict[str, object] = {}
    left = [x for x in named if x.kind not in ("text",)]

    def take(role: str, ok) -> None:
        for x in left:
            if ok(x):
                roles[role] = x.name
                left.remove(x)
                return

    if "survival" in c:
        take("event", lambda x: x.kind == "binary" and re.search("event|status|death|died|fail|relapse", x.name.lower()))
        take("time", lambda x: x.kind == "continuous")
        if "event" not in roles:
            take("event", lambda x: x.kind == "binary")
        for role, pat, kind in (("event", "event|status|died", "binary"), ("time", "time|month|day|hours|year", "continuous")):
            if role not in roles:
                fit = [x for x in cols if x.kind == kind and re.search(pat, x.name.lower())]
                if len(fit) == 1:
                    roles[role] = fit[0].name
                    left = [x for x in left if x.name != fit[0].name]
    if "paired" in c:
        two = [x for x in left if x.kind == "continuous"][:2]
        if len(two) == 2:
            roles |= {"before": two[0].name, "after": two[1].name}
            left = [x for x in left if x not in two]
    if "cluster" in c:
        take("cluster", lambda x: x.kind in ("identifier", "categorical"))
    if "instrument" in c:
        m = re.search(r"instruments?(?:ed)?\s+(?:by|is|are|:)?\s*([\w ,]+)", question.lower())
        iv = [x for x in left if m and x.name.lower() in m.group(1)]
        if iv:
            roles["instruments"] = [x.name for x in iv]
            left = [x for x in left if x not in iv]
    if "forecast" in c:
        fit = [x for x in cols if re.search(r"(^|_)(ts|time|date)|date$", x.name.lower())]
        if len(fit) == 1:
            roles["time"] = fit[0].name
            left = [x for x in left if x.name != fit[0].name]
    left = [x for x in left if x.kind != "identifier"]
    if "time" not in roles or "forecast" in c:
        take("outcome", lambda x: x.kind in ("continuous", "binary")) if any(x.kind == "continuous" for x in left) or len(left) < 2 else take("outcome", lambda x: x.kind == "binary")
        if "outcome" not in roles and left:
            roles["outcome"] = left.pop(0).name
    take("group", lambda x: x.kind in ("binary", "categorical"))
    if "causal" in c and "group" in roles:
        roles["treatment"] = roles["group"]
    if left:
        roles["predictors"] = [x.name for x in left]
        first = left[0]
        if first.kind == "continuous":
            roles["exposure"] = first.name
    return roles


def facts_of(cols: Sequence[Column], roles: dict, question: str) -> set[str]:
    """What the rules ask about: roles filled, kinds of outcome and group, cues."""
    by = {x.name: x for x in cols}
    facts = {role for role, v in roles.items() if v} | {f"cue:{c}" for c in cues(question)}
    if null_probability(question) is not None:
        facts.add("null_probability")
    if len(roles.get("predictors") or []) > 1:
        facts.add("predictors:many")
    y, g = by.get(str(roles.get("outcome"))), by.get(str(roles.get("group")))
    for role, x in (("outcome", y), ("group", g)):
        if x is None:
            continue
        facts.add(f"{role}:{x.kind}")
        facts |= {f"{role}:levels"} if x.kind in ("binary", "categorical") else set()
        facts |= {f"{role}:number"} if x.kind in ("continuous", "categorical") else set()
        facts |= {f"{role}:two"} if x.unique == 2 else {f"{role}:many"} if x.unique > 2 else set()
    if y is not None and (y.minimum or 0) >= 0 and (y.zero_fraction or 0) >= FLOOR_SHARE:
        facts.add("outcome:floor")
    few = y is not None and 0 < y.rows <= FEW_ROWS
    if {"outcome:two", "group:two"} <= facts and (few or "cue:sparse" in facts):
        facts.add("sparse_table")
    return facts


def named_procedures(question: str) -> list[str]:
    q = question.lower()
    return [m for m in CATALOGUE if m != "inspect" and re.search(rf"(?<!\w){m.replace('_', '[_ -]')}(?!\w)", q)]


def scores(cols: Sequence[Column], roles: dict, question: str) -> dict[str, float]:
    return scored(facts_of(cols, roles, question), named_procedures(question))


def plans(cols: Sequence[Column], question: str, most: int = 5) -> list[Plan]:
    """Ranked by score, ties by name, at most five."""
    filters, recodes = declared(cols, question)
    cols = prepared(cols, filters, recodes)
    roles = roles_of(cols, question)
    opts: dict[str, object] = {}
    if null_probability(question) is not None:
        opts |= {"null_probability": null_probability(question), "alternative": alternative(question)}
    ranked = sorted(scores(cols, roles, question).items(), key=lambda s: (-s[1], s[0]))[:most]
    return [Plan(Request(m, roles, tuple(filters), tuple(recodes), opts), s, missing_roles(m, roles)) for m, s in ranked]


def choose(cols: Sequence[Column], question: str) -> Plan | None:
    """The first ready plan; None asks for clarification."""
    return next((p for p in plans(cols, question) if p.ready), None)


def plan_errors(cols: Sequence[Column], request: Request) -> list[str]:
    """What speaks against a request before it runs: unknown procedure, missing roles, unknown columns, one column in two
    roles that must differ, an outcome without variation."""
    if request.method_id not in CATALOGUE:
        return [f"unknown procedure: {request.method_id}"]
    by = {c.name: c for c in cols}
    out = [f"missing role: {r}" for r in missing_roles(request.method_id, request.roles)]
    single = {r: v for r, v in request.roles.items() if isinstance(v, str)}
    listed = [v for vs in request.roles.values() if isinstance(vs, (list, tuple)) for v in vs]
    out += [f"no such column: {v}" for v in dict.fromkeys([*single.values(), *listed]) if v not in by]
    apart = [single[r] for r in ("outcome", "group", "time", "event", "before", "after", "cluster") if r in single]
    out += [f"{v} has two roles" for v in dict.fromkeys(apart) if apart.count(v) > 1]
    y = by.get(single.get("outcome", ""))
    if y is not None and y.unique < 2:
        out.append(f"{y.name} does not vary")
    return out


def repaired_plan(cols: Sequence[Column], ranked: Sequence[Plan], failed: Sequence[str] = ()) -> Plan | None:
    """The next ready plan without errors, in the order of the candidates, besides those that failed."""
    return next((p for p in ranked if p.ready and p.request.method_id not in failed and not plan_errors(cols, p.request)), None)


def analyze(df: DataFrame, question: str, glossary: str = "") -> dict:
    """Profile, plan, run; a plan that fails gives way to the next ready one; without any, what has to be clarified."""
    from lodestat.plans.procedures import outcome_of

    cols = described(columns(df), parse_glossary(glossary))
    ranked, failed = plans(cols, question), []
    error = None
    while (p := repaired_plan(cols, ranked, [m for m, _ in failed])) is not None:
        out = outcome_of(df, p.request)
        if out["status"] == "ok":
            return out | {"roles": dict(p.request.roles), "score": p.score, "context": study_context(question), "failed": dict(failed)}
        error = out
        failed.append((p.request.method_id, out["error"]))
    if error is not None:
        return error
    return {"status": "needs_clarification", "candidates": [x.request.method_id for x in ranked], "missing": ranked[0].missing if ranked else ["outcome"], "context": study_context(question)}

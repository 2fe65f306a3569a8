"""Rules that score procedures: a table of facts and scores, and the small engine that reads it.

A question and a profile are first brought to a set of facts ("outcome:binary", "cue:rank",
"predictors:many"). A rule holds if all its facts are there and none of those it rules out. Every
procedure keeps its largest score; a rule marked `final` ends the reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

#: Words that speak for a topic, in English and Chinese.
CUES = {
    "survival": "surviv, time to event, time-to-, hazard, censor, kaplan, log-rank, logrank, 存活, 生存, 風險比, 风险比, 截尾, 刪失, 删失",
    "paired": "paired, before and after, pre-post, pre and post, within subject, within-subject, same patients, same units, 配對, 配对, 前後, 前后",
    "cluster": "cluster, repeated, nested, per site, sites, multilevel, random intercept, 群集, 重複測量, 重复测量, 巢狀, 嵌套, 多層, 多层",
    "rank": "median, by rank, ranks, nonparametric, non-parametric, ordinal, skewed, 中位數, 中位数, 等級, 等级, 無母數, 非参数, 偏態, 偏态",
    "mean": "mean, average, 平均, 均值",
    "instrument": "instrument, 工具變數, 工具变量",
    "joint": "jointly, all coefficients, coefficients are equal, equal coefficients, overall f, 聯合檢定, 联合检验, 係數相等, 系数相等",
    "count": "count of, counts, number of, how many, events per, 次數, 次数, 件數, 件数, 計數, 计数",
    "censored": "censored at, detection limit, bounded below, bounded above, floor effect, ceiling effect, tobit, 偵測極限, 检测限, 下限, 上限",
    "sparse": "small cells, sparse, rare, exact test, 稀疏, 罕見, 罕见, 精確檢定, 精确检验",
    "association": "associat, correlat, monoton, related to, 相關, 相关, 關聯, 关联, 單調, 单调",
    "adjust": "adjust, controlling for, control for, covariate, 調整, 调整, 控制, 共變, 协变",
    "confounded": "confound, 干擾因子, 混杂, 混淆",
    "causal": "treatment effect, causal, randomized, randomised, assignment, 因果, 隨機分派, 随机分配, 處理效果, 处理效应",
    "forecast": "forecast, time series, leak, 預測未來, 预测未来, 時間序列, 时间序列",
    "calibrate": "calibrat, overconfident, predicted risk, predicted probabil, 校準, 校准",
    "missing": "missing, imput, 缺失, 插補, 插补",
    "prior": "posterior, prior, bayes, 後驗, 后验, 先驗, 先验, 貝氏, 贝叶斯",
    "check": "check, 檢查, 检查",
    "overdispersed": "overdispers, over-dispers, negative binomial, 過度離散, 过度离散",
    "separation": "separation, firth, 完全分離, 完全分离",
    "outlier": "outlier, robust regression, huber, 離群, 离群, 異常值, 异常值",
}


def _pattern(words: str) -> re.Pattern:
    parts = [w.strip() for w in words.split(",")]
    return re.compile("|".join(re.escape(w) if not w.isascii() else rf"\b{re.escape(w)}" for w in parts), re.I)


_FIND = {topic: _pattern(words) for topic, words in CUES.items()}


def cues(question: str) -> set[str]:
    return {topic for topic, find in _FIND.items() if find.search(question)}


class Rule(NamedTuple):
    needs: frozenset[str]
    unless: frozenset[str]
    gives: dict[str, float]
    final: bool


#: Conditions and scores of the procedures. A line: facts needed | facts ruled out | scores.
TABLE = """
time event group | predictors:many cue:adjust | logrank .99 cox_ph .78 final
time event | | cox_ph .97 logrank .68 final
before after | cue:rank | paired_t .91 wilcoxon_signed_rank .82
before after cue:rank | | paired_t .91 wilcoxon_signed_rank .93
cue:count outcome:number | cue:overdispersed | poisson_glm .91 negative_binomial_glm .79
cue:count outcome:number cue:overdispersed | | poisson_glm .91 negative_binomial_glm .93
null_probability outcome:binary | | binomial_test .99
instruments outcome | | iv_2sls .97
cue:joint outcome | | regression_f_test .96
cluster outcome | | mixed_effects .90 gee .86
cue:forecast time outcome | | blocked_time_series_cv .94
cue:causal treatment outcome | | difference_in_means .93 randomization_inference .80 ancova .70 ipw .60
cue:causal treatment outcome cue:adjust predictors | | ancova .95
cue:causal treatment outcome cue:confounded | | ipw .90
cue:missing outcome | | multiple_imputation .90
cue:calibrate outcome:binary | | calibrated_logistic .92
cue:prior outcome | | conjugate_bayes .92 posterior_predictive .70
cue:prior cue:check outcome | | posterior_predictive .90
outcome:levels group:levels | sparse_table | chi_square .88 fisher_exact .79
outcome:levels group:levels sparse_table | | fisher_exact .91 chi_square .78
outcome:two group:two | | two_proportion .76
outcome:continuous group:many | | kruskal_wallis .96 hc3_ols .73
outcome:continuous group:two cue:rank | | mann_whitney .96 welch_t .70
outcome:continuous group:two cue:mean | cue:rank | welch_t .94 independent_t .78 mann_whitney .61
outcome:continuous group:two | cue:rank cue:mean | welch_t .84 mann_whitney .82
outcome:continuous exposure | group | hc3_ols .76 spearman_correlation .60
outcome:continuous exposure cue:association | group | spearman_correlation .92
outcome:binary predictors | | logistic_glm .88 probit_glm .76 firth_logistic .50
outcome:binary predictors cue:separation | | firth_logistic .93
outcome:continuous predictors | | hc3_ols .82 ols .71 huber_regression .50
outcome:continuous predictors cue:adjust | | hc3_ols .87
outcome:continuous predictors cue:outlier | | huber_regression .92
outcome:continuous predictors outcome:floor | | tobit_regression .93
outcome:continuous predictors cue:censored | | tobit_regression .98
"""
#: What remains where no rule holds but an outcome is there; the score of a procedure named.
REMAINS = {"conjugate_bayes": 0.45, "posterior_predictive": 0.42}
NAMED = 0.995


def _read(table: str) -> list[Rule]:
    out = []
    for line in filter(None, map(str.strip, table.splitlines())):
        needs, unless, gives = (part.split() for part in line.split("|"))
        final = gives[-1] == "final"
        gives = gives[:-1] if final else gives
        out.append(Rule(frozenset(needs), frozenset(unless), {m: float(v) for m, v in zip(gives[::2], gives[1::2])}, final))
    return out


RULES = _read(TABLE)


def scored(facts: set[str], named: Iterable[str] = ()) -> dict[str, float]:
    """Score per procedure; `named` are those the question calls by name."""
    out = dict.fromkeys(named, NAMED)
    for rule in RULES:
        if rule.needs <= facts and not rule.unless & facts:
            for method, score in rule.gives.items():
                out[method] = max(score, out.get(method, 0.0))
            if rule.final:
                return out
    return out or (dict(REMAINS) if "outcome" in facts else {})

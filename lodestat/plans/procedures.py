"""The catalogue of procedures: roles each needs, and how it is run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators import preprocess as P
from lodestat.operators.profile import profile
from lodestat.operators.stats import compare as C
from lodestat.operators.stats import longitudinal as L
from lodestat.operators.stats import models as M


@dataclass(frozen=True)
class Request:
    """What to compute: a procedure, columns by role, declared preprocessing and options."""

    method_id: str
    roles: Mapping[str, object] = field(default_factory=dict)
    row_filters: tuple[Mapping, ...] = ()
    binary_recodes: tuple[Mapping, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)


def _preds(r: Mapping) -> list[str]:
    """Predictors of a regression: exposure or group first, then the covariates."""
    first = [r[k] for k in ("exposure", "group", "treatment") if r.get(k)]
    return [*first, *(r.get("predictors") or []), *(r.get("covariates") or [])]


Run = Callable[[DataFrame, Mapping, Mapping], DataFrame]

#: method: (roles without which it cannot run, how it is run). Roles of regressions: any of the predictors.
CATALOGUE: dict[str, tuple[tuple[str, ...], Run]] = {
    "inspect": ((), lambda d, r, o: profile(d)),
    "independent_t": (("outcome", "group"), lambda d, r, o: C.two_group_t(d, r["outcome"], r["group"], True, o.get("alpha", 0.05))),
    "welch_t": (("outcome", "group"), lambda d, r, o: C.two_group_t(d, r["outcome"], r["group"], False, o.get("alpha", 0.05))),
    "difference_in_means": (("outcome", "treatment"), lambda d, r, o: C.two_group_t(d, r["outcome"], r["treatment"], False, o.get("alpha", 0.05))),
    "mann_whitney": (("outcome", "group"), lambda d, r, o: C.mann_whitney(d, r["outcome"], r["group"])),
    "kruskal_wallis": (("outcome", "group"), lambda d, r, o: C.kruskal_wallis(d, r["outcome"], r["group"])),
    "paired_t": (("before", "after"), lambda d, r, o: C.paired_t(d, r["before"], r["after"], o.get("alpha", 0.05))),
    "wilcoxon_signed_rank": (("before", "after"), lambda d, r, o: C.wilcoxon_signed_rank(d, r["before"], r["after"])),
    "chi_square": (("group", "outcome"), lambda d, r, o: C.chi_square(d, r["group"], r["outcome"])),
    "two_proportion": (("group", "outcome"), lambda d, r, o: C.chi_square(d, r["group"], r["outcome"], yates=True)),
    "fisher_exact": (("group", "outcome"), lambda d, r, o: C.fisher_exact(d, r["group"], r["outcome"])),
    "binomial_test": (("outcome",), lambda d, r, o: C.binomial_test(d, r["outcome"], o.get("null_probability", 0.5), o.get("alternative", "two-sided"), o.get("alpha", 0.05))),
    "spearman_correlation": (("outcome", "exposure"), lambda d, r, o: C.spearman(d, r["exposure"], r["outcome"])),
    "ols": (("outcome",), lambda d, r, o: M.ols(d, r["outcome"], _preds(r))),
    "hc3_ols": (("outcome",), lambda d, r, o: M.ols(d, r["outcome"], _preds(r), "hc3")),
    "ancova": (("outcome", "treatment"), lambda d, r, o: M.ols(d, r["outcome"], _preds(r), "hc3")),
    "huber_regression": (("outcome",), lambda d, r, o: M.huber(d, r["outcome"], _preds(r))),
    "regression_f_test": (("outcome",), lambda d, r, o: M.regression_f_test(d, r["outcome"], _preds(r))),
    "iv_2sls": (("outcome", "exposure", "instruments"), lambda d, r, o: M.iv_2sls(d, r["outcome"], r["exposure"], list(r["instruments"]), r.get("covariates") or [])),
    "logistic_glm": (("outcome",), lambda d, r, o: M.logistic_glm(d, r["outcome"], _preds(r))),
    "probit_glm": (("outcome",), lambda d, r, o: M.probit_glm(d, r["outcome"], _preds(r))),
    "firth_logistic": (("outcome",), lambda d, r, o: M.firth_logistic(d, r["outcome"], _preds(r))),
    "poisson_glm": (("outcome",), lambda d, r, o: M.poisson_glm(d, r["outcome"], _preds(r))),
    "negative_binomial_glm": (("outcome",), lambda d, r, o: M.negative_binomial_glm(d, r["outcome"], _preds(r))),
    "tobit_regression": (("outcome",), lambda d, r, o: M.tobit_regression(d, r["outcome"], _preds(r), o.get("left_censor"), o.get("right_censor"))),
    "gee": (("outcome", "cluster"), lambda d, r, o: L.gee(d, r["outcome"], _preds(r), r["cluster"])),
    "mixed_effects": (("outcome", "cluster"), lambda d, r, o: L.mixed_effects(d, r["outcome"], _preds(r), r["cluster"])),
    "cox_ph": (("time", "event"), lambda d, r, o: L.cox_ph(d, r["time"], r["event"], _preds(r))),
    "logrank": (("time", "event", "group"), lambda d, r, o: L.logrank(d, r["time"], r["event"], r["group"])),
    "multiple_imputation": (("outcome",), lambda d, r, o: L.multiple_imputation(d, [r["outcome"], *_preds(r)])),
    "ipw": (("outcome", "treatment"), lambda d, r, o: M.ipw(d, r["outcome"], r["treatment"], r.get("covariates") or [])),
    "randomization_inference": (("outcome", "treatment"), lambda d, r, o: L.randomization_inference(d, r["outcome"], r["treatment"], o.get("draws", 2000), o.get("seed", 0))),
    "conjugate_bayes": (("outcome",), lambda d, r, o: L.conjugate_bayes(d, r["outcome"])),
    "posterior_predictive": (("outcome",), lambda d, r, o: L.posterior_predictive(d, r["outcome"], o.get("draws", 2000), o.get("seed", 0))),
    "calibrated_logistic": (("outcome", "key"), lambda d, r, o: L.calibrated_logistic(d, r["outcome"], _preds(r), r["key"])),
    "blocked_time_series_cv": (("outcome", "time"), lambda d, r, o: L.blocked_time_series_cv(d, r["time"], r["outcome"], _preds(r), o.get("splits", 5))),
}

_REGRESSIONS = {"ols", "hc3_ols", "huber_regression", "regression_f_test", "logistic_glm", "probit_glm", "firth_logistic", "poisson_glm", "negative_binomial_glm", "tobit_regression", "cox_ph", "blocked_time_series_cv", "calibrated_logistic"}


def missing_roles(method_id: str, roles: Mapping) -> list[str]:
    need = [r for r in CATALOGUE[method_id][0] if not roles.get(r)]
    if method_id in _REGRESSIONS and not _preds(roles):
        need.append("predictors")
    return need


def columns_of(roles: Mapping) -> list[str]:
    out: list[str] = []
    for v in roles.values():
        out += list(v) if isinstance(v, (list, tuple)) else [v] if v else []
    return list(dict.fromkeys(out))


def run(df: DataFrame, request: Request) -> DataFrame:
    """Filters, recodes, then the procedure over the columns in its roles only."""
    if request.method_id not in CATALOGUE:
        raise P.AnalysisError(f"unknown procedure: {request.method_id}")
    need = missing_roles(request.method_id, request.roles)
    if need:
        raise P.AnalysisError(f"missing variable roles: {', '.join(need)}")
    used = columns_of(request.roles)
    P.require_columns(df, used)
    d = P.recode_binary(P.row_filters(df, request.row_filters), request.binary_recodes)
    if (request.row_filters or request.binary_recodes) and d.isEmpty():
        raise P.AnalysisError("declared preprocessing removed every row")
    return CATALOGUE[request.method_id][1](d.select(*used) if used else d, request.roles, request.options)  # filters may use other columns


def outcome_of(df: DataFrame, request: Request) -> dict:
    """{"status": "ok", "result": rows} or {"status": "error", "error": text}; results are small."""
    try:
        rows = [r.asDict(recursive=True) for r in run(df, request).collect()]
    except P.AnalysisError as e:
        return {"status": "error", "method_id": request.method_id, "error": str(e)}
    clean = lambda v: None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v
    return {"status": "ok", "method_id": request.method_id, "result": [{k: clean(v) for k, v in r.items()} for r in rows]}


def catalogue_frame(spark) -> DataFrame:
    return spark.createDataFrame([(m, list(r), m in _REGRESSIONS) for m, (r, _) in CATALOGUE.items()], "method_id string, roles array<string>, needs_predictors boolean").orderBy(F.col("method_id"))

"""Importance-weight, rejection and off-policy queries."""

import math

from pyspark.sql import functions as F

from ..derive import TOKENS_SQL, trajectories
from ..functions.arrays import asum, mask_count
from ..operators import correction as C
from .registry import query, rnd, sq

E8 = "1e-8::DOUBLE"
LR = f"""lr AS (SELECT *, old_lp - roll_lp AS lr, greatest(least(old_lp - roll_lp, 20), -20) AS lrc FROM t)"""


def ratios(spark, sf):
    return C.with_log_ratio(trajectories(spark, sf))


def rounded(df, keys=("step",)):
    return df.select(*keys, *[rnd(f"`{c}`").alias(c.replace("/", "_")) for c in df.columns if c not in keys])


def _weights(level, normalize):
    def run(spark, sf):
        out = C.importance_weights(ratios(spark, sf), level, 2.0, normalize)
        return out.select("sample_id", F.posexplode("rollout_is_weights").alias("pos", "w")).select(
            "sample_id", "pos", rnd("w").alias("weight")
        )

    return run


W_TOKEN = "exp(lrc)*m"
W_SEQ = "exp(greatest(least(sum(lr*m) OVER (PARTITION BY sample_id), 20), -20))*m"
query(
    "is_weights_token",
    f"WITH {TOKENS_SQL}, {LR} SELECT sample_id, pos, {sq(f'least({W_TOKEN}, 2)')} AS weight FROM lr",
)(_weights("token", False))
query(
    "is_weights_sequence",
    f"WITH {TOKENS_SQL}, {LR} SELECT sample_id, pos, {sq(f'least({W_SEQ}, 2)')} AS weight FROM lr",
)(_weights("sequence", False))
query(
    "is_weights_token_normalized",
    f"""WITH {TOKENS_SQL}, {LR}, w AS (SELECT *, least({W_TOKEN}, 2) AS w FROM lr)
    SELECT sample_id, pos, {sq(f"w / (sum(w*m) OVER s / (sum(m) OVER s + {E8}))")} AS weight
    FROM w WINDOW s AS (PARTITION BY step)""",
)(_weights("token", True))
query(
    "is_weights_sequence_normalized",
    f"""WITH {TOKENS_SQL}, {LR}, w AS (SELECT *, least({W_SEQ}, 2) AS w FROM lr),
    q AS (SELECT step, sample_id, sum(w*m)/(sum(m)+{E8}) AS sw, sum(m) AS n FROM w GROUP BY ALL),
    f AS (SELECT step, sum(CASE WHEN n > 0 THEN sw ELSE 0 END) / greatest(count(*) FILTER (n > 0), {E8}) AS f FROM q GROUP BY step)
    SELECT sample_id, pos, {sq("w / f")} AS weight FROM w JOIN f USING (step)""",
)(_weights("sequence", True))


def _is_metrics_sql(level):
    w = W_TOKEN if level == "token" else W_SEQ
    if level == "token":
        extreme = f"max(w) FILTER (m = 1) AS wmax, min(w) FILTER (m = 1) AS wmin, sum((w > 2)::INT*m) AS hi, sum((w < 0.5)::INT*m) AS lo"
        top, bottom = "max(wmax)", "min(wmin)"
        hi, lo = f"sum(hi)/(sum(n)+{E8})", f"sum(lo)/(sum(n)+{E8})"
    else:
        extreme = "sum(lr*m) AS slr"
        top, bottom = "exp(least(max(slr), 20))", "exp(min(slr))"
        hi, lo = f"avg((slr > {math.log(2.0)!r})::INT)", f"avg((slr < {math.log(0.5)!r})::INT)"
    c = "greatest(least(w, 2), 0.5)"
    mean_c = f"(sum(sc)/(sum(n)+{E8}))"
    return f"""WITH {TOKENS_SQL}, {LR}, w AS (SELECT *, {w} AS w FROM lr),
    q AS (SELECT step, sample_id, sum(m) AS n, sum(w*m) AS sw, sum({c}*m) AS sc, sum({c}*{c}*m) AS scc,
      sum(w*m)/(sum(m)+{E8}) AS sm, {extreme} FROM w GROUP BY ALL)
    SELECT step, {sq(f"sum(sw)/(sum(n)+{E8})")} AS rollout_is_mean,
      {sq(f"sqrt(greatest(sum(scc)/(sum(n)+{E8}) - {mean_c}*{mean_c}, 0))")} AS rollout_is_std,
      {sq(top)} AS rollout_is_max, {sq(bottom)} AS rollout_is_min,
      {sq(hi)} AS rollout_is_ratio_fraction_high, {sq(lo)} AS rollout_is_ratio_fraction_low,
      {sq(f"1 / (sum(scc)/(({mean_c}+{E8})*({mean_c}+{E8}))/(sum(n)+{E8}))")} AS rollout_is_eff_sample_size,
      {sq("avg(sm)")} AS rollout_is_seq_mean, {sq("stddev_samp(sm)")} AS rollout_is_seq_std,
      {sq("max(sm)")} AS rollout_is_seq_max, {sq("min(sm)")} AS rollout_is_seq_min,
      {sq("max(abs(sm-1))")} AS rollout_is_seq_max_deviation,
      {sq("avg((sm > 2)::INT)")} AS rollout_is_seq_fraction_high, {sq("avg((sm < 0.5)::INT)")} AS rollout_is_seq_fraction_low
    FROM q GROUP BY step"""


@query("is_metrics_token", _is_metrics_sql("token"))
def is_metrics_token(spark, sf):
    return rounded(C.importance_metrics(C.importance_weights(ratios(spark, sf), "token"), "token", 2.0))


@query("is_metrics_sequence", _is_metrics_sql("sequence"))
def is_metrics_sequence(spark, sf):
    return rounded(C.importance_metrics(C.importance_weights(ratios(spark, sf), "sequence"), "sequence", 2.0))


STAT = {"k1": "-lrc", "k2": "0.5*lrc*lrc", "k3": "(exp(lrc) - 1 - lrc)"}
# Off the grid of the derived log-probabilities: no sum lies on a threshold, whatever its order.
SPECS = {
    "token_k1": "0.7013_1.5017",
    "token_k2": "0.0507",
    "token_k3": "0.0507",
    "seq_sum_k1": "0.4013_2.5017",
    "seq_sum_k2": "0.3017",
    "seq_sum_k3": "0.3017",
    "seq_mean_k1": "0.8013_1.3017",
    "seq_mean_k2": "0.0807",
    "seq_mean_k3": "0.0807",
    "seq_max_k2": "0.2017",
    "seq_max_k3": "0.2017",
}


def _rs_parts(option):
    """SQL of the statistic per token, of its sequence value, and its bounds."""
    level, kind = option.rsplit("_", 1)
    tok = STAT[kind]
    spec = SPECS[option]
    low, up = (tuple(math.log(float(x)) for x in spec.split("_")) if "_" in spec else (None, float(spec)))
    over = "OVER (PARTITION BY sample_id)"
    mean = f"(sum(({tok})*m) {over} / (sum(m) {over} + {E8}))"
    seq = {
        "token": mean,
        "seq_sum": f"(sum(({tok})*m) {over})",
        "seq_mean": mean,
        "seq_max": f"coalesce(max(CASE WHEN m = 1 THEN {tok} END) {over}, 0)",
    }[level]
    return tok if level == "token" else seq, seq, low, up


def _keep(stat, low, up):
    return f"({stat} <= {up!r}" + (f" AND {stat} >= {low!r})" if low is not None else ")")


def _rs_sql(option):
    stat, seq, low, up = _rs_parts(option)
    p, floor = f"rollout_rs_{option}", 0.0 if low is None else low
    token = option.startswith("token")
    c = f"greatest(least(x, {up!r}), {floor!r})"
    hi_t, lo_t = f"sum(hi)/(sum(n)+{E8})", f"sum(lo)/(sum(n)+{E8})"
    hi_s, lo_s = f"avg((q > {up!r})::INT)", ("0" if low is None else f"avg((q < {low!r})::INT)")
    cols = {
        "mean": f"sum(s)/(sum(n)+{E8})",
        "max": "max(tmax)" if token else "max(q)",
        "min": "min(tmin)" if token else "min(q)",
        "fraction_high": hi_t if token else hi_s,
        "fraction_low": "0" if low is None else (lo_t if token else lo_s),
        "std": f"sqrt(greatest(sum(cc)/(sum(n)+{E8}) - (sum(c)/(sum(n)+{E8}))*(sum(c)/(sum(n)+{E8})), 0))",
        "seq_mean": "avg(q)",
        "seq_std": "stddev_samp(q)",
        "seq_max": "max(q)",
        "seq_min": "min(q)",
        "seq_max_deviation": "max(abs(q))",
        "seq_fraction_high": hi_s,
        **({} if low is None else {"seq_fraction_low": lo_s}),
        "masked_fraction": f"(sum(n)-sum(kept))/(sum(n)+{E8})",
        "seq_masked_fraction": "count(*) FILTER (n > 0 AND kept < n) / count(*) FILTER (n > 0)",
    }
    body = ",\n".join(f"{sq(v)} AS {p}_{k}" for k, v in cols.items())
    return f"""WITH {TOKENS_SQL}, {LR}, x AS (SELECT *, {stat} AS x, {seq} AS sv FROM lr),
    q AS (SELECT step, sample_id, sum(m) AS n, sum(x*m) AS s, sum({c}*m) AS c, sum({c}*{c}*m) AS cc,
      sum((x > {up!r})::INT*m) AS hi, sum((x < {floor!r})::INT*m) AS lo,
      max(x) FILTER (m = 1) AS tmax, min(x) FILTER (m = 1) AS tmin,
      CASE WHEN sum(m) > 0 THEN any_value(sv) END AS q, sum({_keep("x", low, up)}::INT*m) AS kept FROM x GROUP BY ALL)
    SELECT step, {body},
      {sq(f"(sum(n)-sum(kept))/(sum(n)+{E8})")} AS rollout_rs_masked_fraction,
      {sq("avg((kept < n)::INT)")} AS rollout_rs_seq_masked_fraction FROM q GROUP BY step"""


def _rs(option):
    def run(spark, sf):
        th = C.parse_options(option, SPECS[option])
        return rounded(C.rejection_metrics(C.rejection_mask(ratios(spark, sf), th), th))

    return run


for _option in C.OPTIONS:
    query(f"rejection_{_option}", _rs_sql(_option))(_rs(_option))

COMBINED = ["token_k1", "seq_mean_k3", "seq_max_k2"]


@query(
    "rejection_mask_combined",
    f"""WITH {TOKENS_SQL}, {LR}, x AS (SELECT *, {", ".join(f"{_rs_parts(o)[0]} AS x{i}" for i, o in enumerate(COMBINED))} FROM lr)
    SELECT sample_id, pos, CASE WHEN {" AND ".join(_keep(f"x{i}", *_rs_parts(o)[2:]) for i, o in enumerate(COMBINED))} THEN m ELSE 0 END AS mask FROM x""",
)
def rejection_mask_combined(spark, sf):
    th = C.parse_options(",".join(COMBINED), ",".join(SPECS[o] for o in COMBINED))
    out = C.rejection_mask(ratios(spark, sf), th)
    return out.select("sample_id", F.posexplode("modified_response_mask").alias("pos", "mask"))


OFFPOLICY_SQL = f"""q AS (SELECT step, sample_id, sum(m) AS n, sum(old_lp*m)/(sum(m)+{E8}) AS a, sum(roll_lp*m)/(sum(m)+{E8}) AS b,
      sum(-lr*m) AS kl, sum((exp(lr)-lr-1)*m) AS k3, sum(exp(2*lrc)*m) AS r2, sum(lr*m) AS slr FROM lr GROUP BY ALL)"""
OFFPOLICY_COLS = {
    "training_ppl": "avg(exp(-a))",
    "training_log_ppl": "avg(-a)",
    "kl": f"sum(kl)/(sum(n)+{E8})",
    "k3_kl": f"sum(k3)/(sum(n)+{E8})",
    "rollout_ppl": "avg(exp(-b))",
    "rollout_log_ppl": "avg(-b)",
    "log_ppl_diff": "avg(b-a)",
    "log_ppl_abs_diff": "avg(abs(b-a))",
    "log_ppl_diff_max": "max(b-a)",
    "log_ppl_diff_min": "min(b-a)",
    "ppl_ratio": "avg(exp(b-a))",
    "chi2_token": f"sum(r2)/(sum(n)+{E8}) - 1",
    "chi2_seq": "avg(exp(2*greatest(least(slr,20),-20))) - 1",
}


@query(
    "offpolicy_metrics",
    f"WITH {TOKENS_SQL}, {LR}, {OFFPOLICY_SQL} SELECT step, "
    + ", ".join(f"{sq(v)} AS {k}" for k, v in OFFPOLICY_COLS.items())
    + " FROM q GROUP BY step",
)
def offpolicy_metrics(spark, sf):
    return rounded(C.offpolicy_metrics(trajectories(spark, sf)))


@query(
    "rollout_correction_rows",
    f"""WITH {TOKENS_SQL}, {LR}, x AS (SELECT *, least(exp(lrc)*m, 2) AS w, ({_keep("-lrc", *_rs_parts("token_k1")[2:])})::INT*m AS m2 FROM lr)
    SELECT sample_id, {sq("sum(w)")} AS weight_sum, CAST(sum(m2) AS INTEGER) AS kept FROM x GROUP BY sample_id""",
)
def rollout_correction_rows(spark, sf):
    rows, _ = C.rollout_correction(
        trajectories(spark, sf), "token", 2.0, rejection="token_k1", rejection_threshold=SPECS["token_k1"]
    )
    return rows.select(
        "sample_id", rnd(asum("rollout_is_weights")).alias("weight_sum"), mask_count("response_mask").alias("kept")
    )


@query(
    "rollout_correction_metrics",
    f"WITH {TOKENS_SQL}, {LR}, {OFFPOLICY_SQL} SELECT step, "
    + ", ".join(f"{sq(v)} AS rollout_corr_{k}" for k, v in OFFPOLICY_COLS.items())
    + " FROM q GROUP BY step",
)
def rollout_correction_metrics(spark, sf):
    return rounded(C.rollout_correction(trajectories(spark, sf))[1])


@query(
    "rollout_correction_metrics_full",
    f"SELECT * FROM (WITH {TOKENS_SQL}, {LR}, {OFFPOLICY_SQL} SELECT step, "
    + ", ".join(f"{sq(v)} AS {k}" for k, v in OFFPOLICY_COLS.items())
    + f" FROM q GROUP BY step) JOIN ({_is_metrics_sql('token')}) USING (step) JOIN ({_rs_sql('token_k1')}) USING (step)",
)
def rollout_correction_metrics_full(spark, sf):
    """Off-policy, weight and rejection metrics of one call."""
    _, metrics = C.rollout_correction(
        trajectories(spark, sf), "token", 2.0, rejection="token_k1", rejection_threshold=SPECS["token_k1"]
    )
    out = rounded(metrics)
    return out.withColumnsRenamed({c: c.removeprefix("rollout_corr_") for c in out.columns})


@query(
    "bypass_old_log_probs",
    f"WITH {TOKENS_SQL} SELECT sample_id, {sq('sum(roll_lp)')} AS total FROM t GROUP BY sample_id",
)
def bypass_old_log_probs(spark, sf):
    return C.bypass_old_log_probs(trajectories(spark, sf)).select("sample_id", rnd(asum("old_log_probs")).alias("total"))


@query(
    "engine_agreement",
    f"""WITH {TOKENS_SQL} SELECT step, CAST(1 AS INTEGER) AS rollout_probs_diff_valid,
      {sq("max(abs(exp(roll_lp)-exp(old_lp)))")} AS rollout_probs_diff_max, {sq("avg(abs(exp(roll_lp)-exp(old_lp)))")} AS rollout_probs_diff_mean,
      {sq("stddev_samp(abs(exp(roll_lp)-exp(old_lp)))")} AS rollout_probs_diff_std,
      {sq("corr(exp(roll_lp), exp(old_lp))")} AS rollout_actor_probs_pearson_corr FROM t WHERE m = 1 GROUP BY step""",
)
def engine_agreement(spark, sf):
    out = C.agreement_metrics(trajectories(spark, sf))
    return rounded(out, ("step", "rollout_probs_diff_valid"))


@query(
    "token_list_difference",
    f"WITH {TOKENS_SQL} SELECT sample_id, CAST(sum((old_lp <> roll_lp)::INT*m) AS INTEGER) AS diff FROM t GROUP BY sample_id",
)
def token_list_difference(spark, sf):
    return trajectories(spark, sf).select(
        "sample_id", C.token_difference_count("old_log_probs", "rollout_log_probs", "response_mask").alias("diff")
    )

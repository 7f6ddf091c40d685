"""Loss-value queries over logged log-probabilities."""


from pyspark.sql import functions as F

from ..derive import SAMPLES_SQL, TOKENS_SQL, trajectories
from ..functions.arrays import asum, mask_count
from ..operators import advantages as A
from ..operators import correction as C
from ..operators import losses as L
from .q_correction import E8, SPECS, _keep, _rs_parts, rounded
from .registry import query, rnd, sq


def credited(spark, sf):
    """Trajectories with group-relative advantages."""
    return A.grpo(trajectories(spark, sf).withColumn("token_level_rewards", F.col("token_level_scores")))


TA = f"""WITH {TOKENS_SQL}, {SAMPLES_SQL},
    g AS (SELECT sample_id, (score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END)
            / (CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END + 1e-6) AS adv
          FROM smp WINDOW w AS (PARTITION BY step, uid)),
    ta AS (SELECT t.*, adv*m AS a, lp - old_lp AS lr, greatest(least(lp - old_lp, 20), -20) AS lrc,
             exp(greatest(least(lp - old_lp, 20), -20)) AS ratio FROM t JOIN g USING (sample_id))"""
CLIP = "greatest(least(ratio, 1.2::DOUBLE), 0.8::DOUBLE)"


def mm(x):
    return sq(f"sum(({x})*m)/(sum(m)+{E8})")


def per_step(loss_sql, **metrics):
    """Token-mean loss and masked-mean metrics in one grouped select over `src`."""
    cols = ", ".join(f"{mm(v)} AS {k}" for k, v in metrics.items())
    return f"SELECT step, {sq(f'sum(({loss_sql})*m)/sum(m)')} AS pg_loss{', ' + cols if cols else ''} FROM src GROUP BY step"


def seq_mean(loss_sql):
    return f"""sl AS (SELECT step, sample_id, sum(({loss_sql})*m)/(sum(m)+{E8}) AS l, sum(m) AS n FROM src GROUP BY ALL),
    ls AS (SELECT step, avg(l) FILTER (n > 0) AS pg_loss FROM sl GROUP BY step)"""


PPO = "CASE WHEN a < 0 THEN least(-a*3, greatest(-a*ratio, -a*c)) ELSE greatest(-a*ratio, -a*c) END"
SRC = f"src AS (SELECT *, {CLIP} AS c FROM ta)"
PPO_METRICS = dict(
    pg_clipfrac="(-a*c > -a*ratio)::INT",
    ppo_kl="-lrc",
    pg_clipfrac_lower="(greatest(-a*ratio, -a*c) > -a*3 AND a < 0)::INT",
)


@query("loss_ppo_clip", f"{TA}, {SRC} {per_step(PPO, **PPO_METRICS)}")
def loss_ppo_clip(spark, sf):
    return rounded(L.ppo_clip(credited(spark, sf)))


@query(
    "loss_ppo_clip_weighted",
    f"{TA}, {SRC} "
    + per_step(f"({PPO})*least(exp(greatest(least(old_lp-roll_lp,20),-20))*m, 2)", **PPO_METRICS),
)
def loss_ppo_clip_weighted(spark, sf):
    rows = C.importance_weights(C.with_log_ratio(credited(spark, sf)), "token", 2.0)
    return rounded(L.ppo_clip(rows, weights="rollout_is_weights"))


@query(
    "loss_sequence_clip",
    f"""{TA}, r AS (SELECT *, exp(least(sum(lr*m) OVER s / greatest(sum(m) OVER s, 1), 10)) AS sr FROM ta WINDOW s AS (PARTITION BY sample_id)),
    src AS (SELECT *, greatest(least(sr, 1.2::DOUBLE), 0.8::DOUBLE) AS c FROM r),
    {seq_mean("greatest(-a*sr, -a*c)")}
    SELECT step, {sq("any_value(pg_loss)")} AS pg_loss, {mm("(-a*c > -a*sr)::INT")} AS pg_clipfrac, {mm("-lr")} AS ppo_kl,
      0.0::DOUBLE AS pg_clipfrac_lower FROM src JOIN ls USING (step) GROUP BY step""",
)
def loss_sequence_clip(spark, sf):
    return rounded(L.sequence_clip(credited(spark, sf)))


@query(
    "loss_soft_gate",
    f"""{TA}, src AS (SELECT *, CASE WHEN a > 0 THEN 1.0::DOUBLE ELSE 1.05::DOUBLE END AS tau FROM ta),
    {seq_mean("-a*4/tau/(1+exp(-tau*(ratio-1)))")}
    SELECT step, {sq("any_value(pg_loss)")} AS pg_loss, 0.0::DOUBLE AS pg_clipfrac, {mm("-lrc")} AS ppo_kl,
      0.0::DOUBLE AS pg_clipfrac_lower FROM src JOIN ls USING (step) GROUP BY step""",
)
def loss_soft_gate(spark, sf):
    return rounded(L.soft_gate(credited(spark, sf)))


@query("loss_gpg", f"{TA}, src AS (FROM ta) {per_step('-lp*a')}")
def loss_gpg(spark, sf):
    return rounded(L.gpg_loss(credited(spark, sf)))


@query(
    "loss_clipped_is",
    f"{TA}, {SRC} {per_step('-c*a*lp', pg_clipfrac='(ratio <> c)::INT', ppo_kl='-lrc', pg_clipfrac_lower='0')}",
)
def loss_clipped_is(spark, sf):
    return rounded(L.clipped_is_loss(credited(spark, sf)))


@query(
    "loss_geometric_mean",
    f"""{TA}, src AS (SELECT *, greatest(least(lr, 0.2::DOUBLE), -0.2::DOUBLE) AS cl FROM ta),
    s AS (SELECT step, sample_id, sum(a*m)/(sum(m)+{E8}) AS av, sum(sign(a)*least(sign(a)*lr, sign(a)*cl)*m)/(sum(m)+{E8}) AS b FROM src GROUP BY ALL),
    ls AS (SELECT step, avg(-av*exp(b)) AS pg_loss FROM s GROUP BY step)
    SELECT step, {sq("any_value(pg_loss)")} AS pg_loss, {mm("(lr <> cl AND a > 0)::INT")} AS pg_clipfrac, {mm("-lr")} AS ppo_kl,
      {mm("(lr <> cl AND a < 0)::INT")} AS pg_clipfrac_lower FROM src JOIN ls USING (step) GROUP BY step""",
)
def loss_geometric_mean(spark, sf):
    return rounded(L.geometric_mean_loss(credited(spark, sf)))


@query(
    "loss_reinforce",
    f"""{TA}, s AS (SELECT step, sample_id, sum(-a*lp*least(exp(greatest(least(old_lp-roll_lp,20),-20))*m, 2)*m) AS l, sum(m) AS n,
      sum((roll_lp-lp)*m) AS k FROM ta GROUP BY ALL)
    SELECT step, {sq("sum(l) FILTER (n > 0) / count(*) FILTER (n > 0)")} AS pg_loss, {sq(f"sum(k)/(sum(n)+{E8})")} AS ppo_kl FROM s GROUP BY step""",
)
def loss_reinforce(spark, sf):
    rows = C.importance_weights(C.with_log_ratio(credited(spark, sf)), "token", 2.0)
    return rounded(L.reinforce_loss(rows, weights="rollout_is_weights"))


@query(
    "loss_bypass_ppo",
    f"""{TA}, k AS (SELECT * REPLACE (({_keep("-lrc", *_rs_parts("token_k1")[2:])})::INT*m AS m) FROM ta),
    src AS (SELECT *, {CLIP} AS c FROM k) {per_step(PPO, **PPO_METRICS)}""",
)
def loss_bypass_ppo(spark, sf):
    out = L.bypass_loss(credited(spark, sf), "ppo_clip", rejection="token_k1", rejection_threshold=SPECS["token_k1"])
    return rounded(out.select("step", "pg_loss", "pg_clipfrac", "ppo_kl", "pg_clipfrac_lower"))


@query(
    "loss_bypass_reinforce",
    f"""{TA}, src AS (SELECT *, least(ratio*m, 2) AS w FROM ta) {per_step("-a*lp*w", ppo_kl="-lr")}""",
)
def loss_bypass_reinforce(spark, sf):
    out = L.bypass_loss(credited(spark, sf), "reinforce", weight_level="token", weight_threshold=2.0)
    return rounded(out.select("step", "pg_loss", "ppo_kl"))


COV = f"""{TA}, mu AS (SELECT step, sum(a*m)/sum(m) AS ma, sum(lp*m)/sum(m) AS ml, sum(m) AS nt FROM ta GROUP BY step),
    v AS (SELECT ta.*, (a-ma)*(lp-ml) AS cov, nt FROM ta JOIN mu USING (step) WHERE m = 1)"""


@query(
    "loss_covariance_penalty",
    f"""{COV}, k AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY cov DESC, sample_id, pos) AS rk FROM v)
    SELECT step, {sq("avg(-a*exp(lr) + CASE WHEN rk <= greatest(1, floor(nt*0.05)) THEN abs(lr) ELSE 0 END)")} AS pg_loss,
      {sq(f"sum(abs(lr))/(count(*)+{E8})")} AS ppo_kl FROM k GROUP BY step""",
)
def loss_covariance_penalty(spark, sf):
    return rounded(L.covariance_penalty(credited(spark, sf), ratio=0.05))


@query("loss_covariance_clip")
def loss_covariance_clip(spark, sf):
    return rounded(L.covariance_clip(credited(spark, sf), ratio=0.02, low_cov=0.05, high_cov=2.0, seed=3))


@query(
    "loss_covariance_clip_wide",
    f"""{COV}, c AS (SELECT *, greatest(least(exp(lr), 1.2::DOUBLE), 0.8::DOUBLE) AS c FROM v),
    d AS (SELECT *, cov > 0.05 AND cov < 2 AND NOT (-a*c > -a*exp(lr)) AS drop FROM c)
    SELECT step, {sq("sum(CASE WHEN drop THEN 0 ELSE greatest(-a*exp(lr), -a*c) END)/count(*)")} AS pg_loss,
      {sq(f"count(*) FILTER (drop)/(count(*)+{E8})")} AS pg_clipfrac, {sq(f"sum(-lr)/(count(*)+{E8})")} AS ppo_kl FROM d GROUP BY step""",
)
def loss_covariance_clip_wide(spark, sf):
    """With room for every candidate the random choice drops out and SQL can state the result."""
    return rounded(L.covariance_clip(credited(spark, sf), ratio=1.0, low_cov=0.05, high_cov=2.0))


def _agg(mode):
    def run(spark, sf):
        return trajectories(spark, sf).groupBy("step").agg(rnd(L.aggregate_loss("values", mode)).alias("loss"))

    return run


AGG_SQL = {
    "token-mean": "sum(s)/sum(n)",
    "seq-mean-token-sum": "sum(s) FILTER (n > 0)/count(*) FILTER (n > 0)",
    "seq-mean-token-mean": f"sum(s/(n+{E8})) FILTER (n > 0)/count(*) FILTER (n > 0)",
    "seq-mean-token-sum-norm": "sum(s)/16",
}
for _mode, _expr in AGG_SQL.items():
    query(
        "loss_agg_" + _mode.replace("-", "_"),
        f"""WITH {TOKENS_SQL}, q AS (SELECT step, sample_id, sum(val*m) AS s, sum(m) AS n FROM t GROUP BY ALL)
        SELECT step, {sq(_expr)} AS loss FROM q GROUP BY step""",
    )(_agg(_mode))


@query(
    "loss_entropy",
    f"WITH {TOKENS_SQL} SELECT step, {sq('sum(ent*m)/sum(m)')} AS entropy FROM t GROUP BY step",
)
def loss_entropy(spark, sf):
    return rounded(L.entropy_loss(trajectories(spark, sf)))


@query(
    "loss_value",
    f"""WITH {TOKENS_SQL}, x AS (SELECT step, m, ent*2+0.3 AS vp, val, val*0.5 + score/10 AS ret FROM t),
    y AS (SELECT step, m, (vp-ret)*(vp-ret) AS l1, power(least(greatest(vp, val-0.1), val+0.1)-ret, 2) AS l2 FROM x)
    SELECT step, {sq("0.5*sum(greatest(l1,l2)*m)/sum(m)")} AS vf_loss, {mm("(l2 > l1)::INT")} AS vf_clipfrac FROM y GROUP BY step""",
)
def loss_value(spark, sf):
    rows = trajectories(spark, sf)
    rows = rows.withColumn("vpreds", F.transform("entropys", lambda e: e * 2 + F.lit(0.3)))
    rows = rows.withColumn("returns", F.transform("values", lambda v: v * F.lit(0.5) + F.col("score") / 10))
    return rounded(L.value_loss(rows, clip=0.1))


@query(
    "loss_sft",
    f"""WITH {TOKENS_SQL}, x AS (SELECT step, m, lp,
      coalesce(lead(m) OVER (PARTITION BY step ORDER BY sample_id, pos), first_value(m) OVER (PARTITION BY step ORDER BY sample_id, pos)) AS m2 FROM t)
    SELECT step, {sq("-sum(lp*m2)/sum(m)")} AS loss FROM x GROUP BY step""",
)
def loss_sft(spark, sf):
    return rounded(L.sft_loss(trajectories(spark, sf)))


def ratio_loss(df):
    """A sample user loss: minus the advantage times the ratio, averaged over the tokens of a step."""
    def one(t):
        return -t["advantages"] * F.exp(t["log_probs"] - t["old_log_probs"]) * t["response_mask"]

    tokens = F.transform(F.arrays_zip("advantages", "log_probs", "old_log_probs", "response_mask"), one)
    return df.groupBy("step").agg((F.sum(asum(tokens)) / F.sum(mask_count("response_mask"))).alias("pg_loss"))


@query("hook_custom_loss", f"{TA} SELECT step, {sq('sum(-a*exp(lr)*m)/sum(m)')} AS pg_loss FROM ta GROUP BY step")
def hook_custom_loss(spark, sf):
    L.register_loss("ratio", ratio_loss)
    return rounded(L.policy_loss(credited(spark, sf), "ratio"))

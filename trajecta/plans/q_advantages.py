"""Advantage, return and divergence-in-reward queries."""

from pyspark.sql import functions as F

from ..derive import SAMPLES_SQL, TOKENS_SQL, trajectories
from ..functions.arrays import asum, mask_count, masked_mean, masked_sum
from ..functions.kl import kl_token
from ..operators import advantages as A
from ..operators.correction import importance_weights, with_log_ratio
from .registry import query, rnd, sq


def rewarded(spark, sf):
    return trajectories(spark, sf).withColumn("token_level_rewards", F.col("token_level_scores"))


def _per_sample(df):
    """Group estimators give one value per sample: the sum over the array and over returns."""
    return df.select("sample_id", rnd(asum("advantages")).alias("adv_sum"), rnd(asum("returns")).alias("ret_sum"))


def _per_token(df):
    out = df.select("sample_id", F.posexplode(F.arrays_zip("advantages", "returns")).alias("pos", "t"))
    return out.select("sample_id", "pos", rnd("t.advantages").alias("advantage"), rnd("t.returns").alias("ret"))


def _scalar_sql(scalar: str, extra: str = "") -> str:
    adv = sq("(" + scalar + ") * n_valid")
    return f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}{extra},
    g AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd
          FROM smp WINDOW w AS (PARTITION BY step, uid))
    SELECT sample_id, {adv} AS adv_sum, {adv} AS ret_sum FROM g"""


MU = "CASE WHEN n = 1 THEN 0 ELSE mu END"


@query("adv_grpo", _scalar_sql(f"(score - {MU}) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6)"))
def adv_grpo(spark, sf):
    return _per_sample(A.grpo(rewarded(spark, sf)))


@query("adv_grpo_no_std", _scalar_sql(f"score - {MU}"))
def adv_grpo_no_std(spark, sf):
    return _per_sample(A.grpo(rewarded(spark, sf), norm_by_std=False))


@query(
    "adv_grpo_vectorized",
    _scalar_sql(f"(score - {MU}) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(sd*sd, 1e-6)) END + 1e-6)"),
)
def adv_grpo_vectorized(spark, sf):
    return _per_sample(A.grpo_vectorized(rewarded(spark, sf)))


@query(
    "adv_grpo_passk",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL},
    g AS (SELECT *, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, max(score) OVER w AS best,
            row_number() OVER (PARTITION BY step, uid ORDER BY score DESC, sample_id) AS rk
          FROM smp WINDOW w AS (PARTITION BY step, uid)),
    s AS (SELECT step, uid, score AS second FROM g WHERE rk = 2)
    SELECT sample_id, {sq("CASE WHEN rk = 1 AND n > 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END * n_valid")} AS adv_sum,
      {sq("CASE WHEN rk = 1 AND n > 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END * n_valid")} AS ret_sum
    FROM g LEFT JOIN s USING (step, uid)""",
)
def adv_grpo_passk(spark, sf):
    return _per_sample(A.grpo_passk(rewarded(spark, sf), single="zero"))


@query("adv_rloo", _scalar_sql("CASE WHEN n > 1 THEN score*n/(n-1) - mu*n/(n-1) ELSE score END"))
def adv_rloo(spark, sf):
    return _per_sample(A.rloo(rewarded(spark, sf)))


@query("adv_rloo_vectorized", _scalar_sql("CASE WHEN n > 1 THEN (n*score - n*mu)/(n-1) ELSE 0 END"))
def adv_rloo_vectorized(spark, sf):
    return _per_sample(A.rloo_vectorized(rewarded(spark, sf)))


@query(
    "adv_opo",
    _scalar_sql("score - CASE WHEN n = 1 THEN 0 ELSE ws / nullif(wl, 0) END").replace(
        "FROM smp WINDOW",
        ", sum(n_valid*score) OVER w AS ws, sum(n_valid) OVER w AS wl FROM smp WINDOW",
    ),
)
def adv_opo(spark, sf):
    return _per_sample(A.opo(rewarded(spark, sf)))


@query(
    "adv_gpg",
    _scalar_sql(f"bs / greatest(nz, 1) * (score - {MU})").replace(
        "FROM smp WINDOW",
        ", count(*) OVER s AS bs, count(*) FILTER (score <> 0) OVER s AS nz FROM smp WINDOW s AS (PARTITION BY step),",
    ),
)
def adv_gpg(spark, sf):
    return _per_sample(A.gpg(rewarded(spark, sf)))


WHITEN_SQL = """wh AS (SELECT step, sum(x*m)/(sum(m)+1e-8) AS mu FROM {src} GROUP BY step),
    wv AS (SELECT step, any_value(mu) AS mu, sum((x-mu)*(x-mu)*m)/(sum(m)+1e-8)*sum(m)/(sum(m)-1) AS var
           FROM {src} JOIN wh USING (step) GROUP BY step)"""


@query(
    "adv_reinforce_plus_plus_baseline",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL},
    g AS (SELECT sample_id, score - CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS c
          FROM smp WINDOW w AS (PARTITION BY step, uid)),
    x AS (SELECT t.step, t.sample_id, t.pos, t.m, c*m AS x FROM t JOIN g USING (sample_id)),
    {WHITEN_SQL.format(src="x")}
    SELECT sample_id, pos, {sq("(x-mu)/sqrt(var+1e-8)*m")} AS advantage, {sq("(x-mu)/sqrt(var+1e-8)*m")} AS ret
    FROM x JOIN wv USING (step)""",
)
def adv_rpp_baseline(spark, sf):
    return _per_token(A.reinforce_plus_plus_baseline(rewarded(spark, sf)))


@query(
    "adv_reinforce_plus_plus",
    f"""WITH RECURSIVE {TOKENS_SQL},
    d AS (SELECT step, sample_id, pos, len, m, r, r AS x FROM t WHERE pos = len - 1
      UNION ALL
      SELECT t.step, t.sample_id, t.pos, t.len, t.m, t.r, t.r + 0.9*d.x*d.m FROM t JOIN d
        ON t.sample_id = d.sample_id AND t.pos = d.pos - 1),
    {WHITEN_SQL.format(src="d")}
    SELECT sample_id, pos, {sq("(x-mu)/sqrt(var+1e-8)*m")} AS advantage, {sq("x")} AS ret
    FROM d JOIN wv USING (step)""",
)
def adv_rpp(spark, sf):
    return _per_token(A.reinforce_plus_plus(rewarded(spark, sf), gamma=0.9))


@query(
    "adv_gae",
    f"""WITH RECURSIVE {TOKENS_SQL},
    d AS (
      SELECT step, sample_id, pos, m, val, CASE WHEN m = 1 THEN r - val ELSE 0 END AS x,
        CASE WHEN m = 1 THEN val ELSE 0 END AS nv FROM t WHERE pos = len - 1
      UNION ALL
      SELECT t.step, t.sample_id, t.pos, t.m, t.val,
        CASE WHEN t.m = 1 THEN t.r + 0.99*d.nv - t.val + 0.99*0.95*d.x ELSE d.x END,
        CASE WHEN t.m = 1 THEN t.val ELSE d.nv END
      FROM t JOIN d ON t.sample_id = d.sample_id AND t.pos = d.pos - 1),
    {WHITEN_SQL.format(src="d")}
    SELECT sample_id, pos, {sq("(x-mu)/sqrt(var+1e-8)")} AS advantage, {sq("x+val")} AS ret FROM d JOIN wv USING (step)""",
)
def adv_gae(spark, sf):
    return _per_token(A.gae(rewarded(spark, sf), gamma=0.99, lam=0.95))


@query(
    "adv_remax",
    f"""WITH {TOKENS_SQL},
    c AS (SELECT *, sum(r*m) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS g FROM t)
    SELECT sample_id, pos, {sq("g - base*m")} AS advantage, {sq("g")} AS ret FROM c""",
)
def adv_remax(spark, sf):
    return _per_token(A.remax(rewarded(spark, sf)))


OTB_SQL = f"""WITH {TOKENS_SQL}, {SAMPLES_SQL},
    c AS (SELECT step, uid, sample_id, pos, m, sum(r*m) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS g,
            sum((1 - 2*exp(old_lp) + sp2)*m) OVER (PARTITION BY sample_id ORDER BY pos) AS w,
            sum(m) OVER (PARTITION BY sample_id ORDER BY pos) AS vr FROM t),"""


@query(
    "adv_optimal_token_baseline",
    OTB_SQL
    + f"""b AS (SELECT step, uid, pos, sum(g*w*m)/(sum(w*m)+1e-8) AS b FROM c GROUP BY ALL),
    n AS (SELECT step, uid, count(*) AS n FROM smp GROUP BY ALL)
    SELECT sample_id, pos, {sq("(g - CASE WHEN n = 1 THEN 0 ELSE b END)*m")} AS advantage, {sq("g")} AS ret
    FROM c JOIN b USING (step, uid, pos) JOIN n USING (step, uid)""",
)
def adv_otb(spark, sf):
    return _per_token(A.optimal_token_baseline(rewarded(spark, sf)))


@query(
    "adv_tir_optimal_token_baseline",
    OTB_SQL
    + f"""b AS (SELECT step, uid, vr, sum(g*w)/(sum(w)+1e-8) AS b FROM c WHERE m = 1 GROUP BY ALL),
    n AS (SELECT step, uid, sample_id, n_valid, count(*) OVER w AS n, max(n_valid) OVER w AS mx,
            row_number() OVER (PARTITION BY step, uid ORDER BY n_valid DESC) AS rk
          FROM smp WHERE n_valid > 0 WINDOW w AS (PARTITION BY step, uid)),
    sec AS (SELECT step, uid, n_valid AS second FROM n WHERE rk = 2)
    SELECT c.sample_id, c.pos, {sq('''CASE WHEN m = 0 THEN 0 ELSE g - CASE WHEN n.n = 1 THEN 0
       WHEN n_valid = mx AND mx > second AND c.vr > second THEN 0 ELSE b END END''')} AS advantage, {sq("g")} AS ret
    FROM c LEFT JOIN b ON c.step = b.step AND c.uid = b.uid AND c.vr = b.vr AND c.m = 1
      LEFT JOIN n ON n.sample_id = c.sample_id LEFT JOIN sec ON sec.step = c.step AND sec.uid = c.uid""",
)
def adv_tir_otb(spark, sf):
    return _per_token(A.tir_optimal_token_baseline(rewarded(spark, sf)))


@query(
    "adv_optimal_token_baseline_weighted",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL},
    c AS (SELECT step, uid, sample_id, pos, m, sum(r*m) OVER (PARTITION BY sample_id ORDER BY pos DESC) AS g,
            sum((1 - 2*exp(old_lp) + sp2)*pow(least(exp(greatest(least(old_lp-roll_lp, 20), -20))*m, 2), 2)*m) OVER (PARTITION BY sample_id ORDER BY pos) AS w FROM t),
    b AS (SELECT step, uid, pos, sum(g*w*m)/(sum(w*m)+1e-8) AS b FROM c GROUP BY ALL),
    n AS (SELECT step, uid, sample_id, n_valid, count(*) OVER w AS n, max(n_valid) OVER w AS mx,
            row_number() OVER (PARTITION BY step, uid ORDER BY n_valid DESC) AS rk FROM smp WINDOW w AS (PARTITION BY step, uid)),
    sec AS (SELECT step, uid, n_valid AS second FROM n WHERE rk = 2)
    SELECT c.sample_id, c.pos, {sq("(g - CASE WHEN n.n = 1 OR (n_valid = mx AND mx > second AND c.pos >= second) THEN 0 ELSE b END)*m")} AS advantage, {sq("g")} AS ret
    FROM c JOIN b USING (step, uid, pos) JOIN n ON n.sample_id = c.sample_id LEFT JOIN sec ON sec.step = c.step AND sec.uid = c.uid""",
)
def adv_otb_weighted(spark, sf):
    rows = importance_weights(with_log_ratio(rewarded(spark, sf)), "token", 2.0)
    return _per_token(A.optimal_token_baseline(rows, is_weights="rollout_is_weights", zero_tail=True))


@query(
    "rewards_with_kl",
    f"""WITH {TOKENS_SQL} SELECT sample_id, {sq("sum(r - (old_lp - ref_lp)*0.1)")} AS reward FROM t GROUP BY sample_id""",
)
def rewards_with_kl(spark, sf):
    df = A.rewards_minus_kl(trajectories(spark, sf), 0.1)
    return df.select("sample_id", rnd(asum("token_level_rewards")).alias("reward"))


K3 = "(exp(greatest(least(ref_lp-old_lp,20),-20)) - greatest(least(ref_lp-old_lp,20),-20) - 1)"


@query(
    "kl_in_reward",
    f"""WITH {TOKENS_SQL},
    k AS (SELECT step, sample_id, sum({K3}*m)/(sum(m)+1e-8) AS kl, sum(r - 0.05*{K3}*m) AS rew FROM t GROUP BY ALL)
    SELECT step, {sq("avg(kl)")} AS current_kl, count(*) AS batch_size, {sq("avg(rew)", 5)} AS mean_reward FROM k GROUP BY step""",
)
def kl_in_reward(spark, sf):
    df = A.apply_kl_penalty(trajectories(spark, sf), 0.05, "low_var_kl")
    return (
        df.withColumn("rew", asum("token_level_rewards"))
        .groupBy("step")
        .agg(
            rnd(F.avg("seq_kl")).alias("current_kl"),
            F.count(F.lit(1)).alias("batch_size"),
            rnd(F.avg("rew"), 5).alias("mean_reward"),
        )
    )


@query(
    "kl_adaptive_coefficient",
    f"""WITH {TOKENS_SQL},
    k AS (SELECT step, sample_id, sum(abs(old_lp-ref_lp)*m)/(sum(m)+1e-8) AS kl FROM t GROUP BY ALL),
    s AS (SELECT step, avg(kl) AS kl, count(*) AS n FROM k GROUP BY step),
    f AS (SELECT step, ln(1 + greatest(least(kl/0.3-1, 0.2), -0.2)*n/100000) AS lf FROM s)
    SELECT step, {sq("0.2*exp(coalesce(sum(lf) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))", 9)} AS kl_coef,
      {sq("0.2*exp(sum(lf) OVER (ORDER BY step))", 9)} AS kl_coef_after FROM f""",
)
def kl_adaptive(spark, sf):
    steps = A.current_kl(A.apply_kl_penalty(trajectories(spark, sf), 0.2, "abs"))
    out = A.adaptive_kl_coefficients(steps, 0.2, 0.3, 100000)
    return out.select("step", rnd("kl_coef", 9).alias("kl_coef"), rnd("kl_coef_after", 9).alias("kl_coef_after"))


@query(
    "kl_adaptive_any_sign",
    f"""WITH {TOKENS_SQL},
    k AS (SELECT step, sample_id, sum(abs(old_lp-ref_lp)*m)/(sum(m)+1e-8) AS kl FROM t GROUP BY ALL),
    s AS (SELECT step, avg(kl) AS kl, count(*) AS n FROM k GROUP BY step),
    f AS (SELECT step, 1 + greatest(least(kl/3.0-1, 0.2), -0.2)/0.15 AS f FROM s)
    SELECT step, {sq("0.2*coalesce(product(f) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)", 9)} AS kl_coef,
      {sq("0.2*product(f) OVER (ORDER BY step)", 9)} AS kl_coef_after FROM f""",
)
def kl_adaptive_any_sign(spark, sf):
    """A horizon below a fifth of the batch turns the sign of the coefficient at every step below target."""
    steps = A.current_kl(A.apply_kl_penalty(trajectories(spark, sf), 0.2, "abs"))
    out = A.adaptive_kl_coefficients(steps.withColumn("batch_size", F.lit(1)), 0.2, 3.0, 0.15)
    return out.select("step", rnd("kl_coef", 9).alias("kl_coef"), rnd("kl_coef_after", 9).alias("kl_coef_after"))


@query(
    "score_resample_weights",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}
    SELECT sample_id, {sq("score*score + 1e-8")} AS w_pow,
      {sq("CASE WHEN score = max(score) OVER s OR score = min(score) OVER s THEN 1.0 ELSE 0.0 END + 1e-8", 9)} AS w_max_min,
      {sq("CASE WHEN score = max(score) OVER s THEN 0.4 ELSE 0.1 END + 1e-8", 9)} AS w_max_random
    FROM smp WINDOW s AS (PARTITION BY step)""",
)
def score_resample_weights(spark, sf):
    rows = trajectories(spark, sf).select("step", "sample_id", "token_level_scores")
    out = A.resample_weights(rows, "pow").withColumnRenamed("weight", "w_pow")
    out = A.resample_weights(out, "max_min").withColumnRenamed("weight", "w_max_min")
    out = A.resample_weights(out, "max_random").withColumnRenamed("weight", "w_max_random")
    return out.select(
        "sample_id",
        rnd("w_pow").alias("w_pow"),
        rnd("w_max_min", 9).alias("w_max_min"),
        rnd("w_max_random", 9).alias("w_max_random"),
    )


@query("score_resample")
def score_resample(spark, sf):
    return A.resample(trajectories(spark, sf).select("step", "sample_id", "token_level_scores"), seed=7)


@query(
    "score_resample_properties",
    f"WITH {TOKENS_SQL}, {SAMPLES_SQL} SELECT step, count(*) AS n, count(*) AS draws, count(*) AS members, true AS weighted FROM smp GROUP BY step",
)
def score_resample_properties(spark, sf):
    """Per step: as many draws as rows, all of them rows of the step, and heavier rows drawn more often.

    `weighted` compares the mean weight of the drawn rows with that of all rows, which drawing by weight raises.
    """
    rows = trajectories(spark, sf).select("step", "sample_id", "token_level_scores")
    weights = A.resample_weights(rows).select("step", "sample_id", "weight")
    drawn = A.resample(rows, seed=7).join(weights, ["step", "sample_id"], "left")
    drawn = drawn.groupBy("step").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("draw_id").alias("draws"), F.count("weight").alias("members"), F.avg("weight").alias("w")
    )
    every = weights.groupBy("step").agg(F.avg("weight").alias("all"))
    return drawn.join(every, "step").select("step", "n", "draws", "members", (F.col("w") >= F.col("all")).alias("weighted"))


@query(
    "response_mask_from_ids",
    f"""WITH {TOKENS_SQL},
    e AS (SELECT sample_id, min(pos) FILTER (m = 0) AS first_end, any_value(len) AS len FROM t GROUP BY sample_id)
    SELECT sample_id, CAST(coalesce(first_end + 1, len) AS INTEGER) AS n_eos,
      CAST(coalesce(len - 1, 0) AS INTEGER) AS n_tail FROM e""",
)
def response_mask_from_ids(spark, sf):
    rows = trajectories(spark, sf).withColumn("ids", F.transform("response_mask", lambda m: m + 7))
    tail = A.response_mask_from_attention(F.transform("ids", lambda _: F.lit(1)), F.size("ids") - 1)
    return rows.select(
        "sample_id",
        mask_count(A.response_mask_from_eos(F.col("ids"), [7])).alias("n_eos"),
        mask_count(tail).alias("n_tail"),
    )


@query(
    "group_mean_std_count",
    f"""WITH {TOKENS_SQL}, {SAMPLES_SQL}
    SELECT uid, {sq("CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END")} AS mean,
      {sq("CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END")} AS std, count(*) AS n
    FROM smp GROUP BY uid""",
)
def group_mean_std_count(spark, sf):
    out = A.group_summary(trajectories(spark, sf))
    return out.select("uid", rnd("mean").alias("mean"), rnd("std").alias("std"), "n")


@query(
    "advantage_by_name",
    _scalar_sql(f"(score - {MU}) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6)").replace("SELECT sample_id,", "SELECT 'grpo' AS estimator, sample_id,")
    + " UNION ALL "
    + "SELECT 'rloo', sample_id, {a}, {a} FROM g".format(
        a=sq("(CASE WHEN n > 1 THEN score*n/(n-1) - mu*n/(n-1) ELSE score END) * n_valid")
    ),
)
def advantage_by_name(spark, sf):
    rows = rewarded(spark, sf)
    parts = [_per_sample(A.advantage(rows, name)).select(F.lit(name).alias("estimator"), "*") for name in ("grpo", "rloo")]
    return parts[0].unionByName(parts[1])


@query(
    "kl_estimators",
    f"""WITH {TOKENS_SQL}
    SELECT sample_id, {sq("sum((old_lp-ref_lp)*m)")} AS k1, {sq("sum(abs(old_lp-ref_lp)*m)")} AS k_abs,
      {sq("sum(0.5*(old_lp-ref_lp)*(old_lp-ref_lp)*m)")} AS k2, {sq(f"sum(least(greatest({K3},-10),10)*m)")} AS k3
    FROM t GROUP BY sample_id""",
)
def kl_estimators(spark, sf):
    df = trajectories(spark, sf)

    def total(kind):
        per = F.zip_with("old_log_probs", "ref_log_prob", lambda a, b: kl_token(a, b, kind))
        return rnd(masked_sum(per, "response_mask"))

    return df.select(
        "sample_id", total("k1").alias("k1"), total("abs").alias("k_abs"), total("k2").alias("k2"), total("k3+").alias("k3")
    )


@query(
    "masked_reductions",
    f"""WITH {TOKENS_SQL},
    s AS (SELECT sample_id, sum(ent*m) AS s, sum(ent*m)/(sum(m)+1e-8) AS mu, sum(m) AS n FROM t GROUP BY ALL),
    v AS (SELECT sample_id, sum((ent-mu)*(ent-mu)*m) AS v FROM t JOIN s USING (sample_id) GROUP BY ALL)
    SELECT sample_id, {sq("s")} AS total, {sq("mu")} AS mean,
      {sq("CASE WHEN n > 1 THEN v/(n+1e-8)*n/(n-1) END")} AS var FROM s JOIN v USING (sample_id)""",
)
def masked_reductions(spark, sf):
    from ..functions.arrays import masked_var

    df = trajectories(spark, sf)
    return df.select(
        "sample_id",
        rnd(masked_sum("entropys", "response_mask")).alias("total"),
        rnd(masked_mean("entropys", "response_mask")).alias("mean"),
        rnd(F.when(mask_count("response_mask") > 1, masked_var("entropys", "response_mask"))).alias("var"),
    )

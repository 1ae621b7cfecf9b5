"""Contrasts, intervals, bootstraps and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaksift.functions.counters import PRIME, drawn_sql
from leaksift.functions.intervals import two_proportion_z, two_sided_p
from leaksift.operators.metrics import combined_scores
from leaksift.operators.replicates import random_memberships, replicate_scores, resample_weights
from leaksift.operators.splits import proportional_targets
from leaksift.operators.stats import (CLUSTER_REPS, LEAST_LIKELY, NULL_TRIALS, RANK_REPS, RATE_FLOOR, agreement_errors, arm_means, attributable, bca_interval, cluster_rates,
                                      decompose, dose_response, effect_size, kendall, leave_top_out, mean_summary,
                                      normal_interval, null_summary, null_trials, paired_bootstrap,
                                      paired_contrast, pearson, percentile_interval, protocol_gap,
                                      rank_ranges, rank_replicates, rate_gap,
                                      ratio_bootstrap, signed_rank, spearman, t_interval,
                                      win_probabilities)
from leaksift.queries.base import PREDICTIONS, Registry, Z, r9, rounded, table
from leaksift.queries.metrics import combined_sql, scored
from leaksift.session import materialise

registry = Registry()
NULLS, RANKS = NULL_TRIALS, RANK_REPS
BOOT, PAIRS = CLUSTER_REPS, CLUSTER_REPS

# --- runs: (arm, seed) means of line items ---------------------------------------


def _runs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("arm"), (F.col("l_orderkey") % 10).alias("seed")).agg(
        F.avg("l_discount").alias("value"))


_RUNS = "WITH runs AS (SELECT l_returnflag arm, l_orderkey%10 seed, avg(l_discount) AS value FROM lineitem GROUP BY 1,2)"
_SUMMARY = """count({v}) n, round(avg({v}),9) mean, round(coalesce(stddev_samp({v}),0),9) sd_sample, round(stddev_pop({v}),9) sd_population,
 round(coalesce(stddev_samp({v}),0)/sqrt(count({v})),9) se, round(median({v}),9) median, round(min({v}),9) AS min, round(max({v}),9) AS max"""
_SUMMARY_COLUMNS = ("mean", "sd_sample", "sd_population", "se", "median")


@registry.add(f"""{_RUNS}, p AS (SELECT a.value-b.value d FROM runs a JOIN runs b USING (seed) WHERE a.arm='A' AND b.arm='N'),
s AS (SELECT count(d) n, avg(d) m, stddev_samp(d) sd, stddev_pop(d) sdp, stddev_samp(d)/sqrt(count(d)) se, median(d) md, min(d) lo, max(d) hi FROM p)
SELECT n, round(m,9) mean, round(sd,9) sd_sample, round(sdp,9) sd_population, round(se,9) se, round(md,9) median, round(lo,9) AS min, round(hi,9) AS max,
 round(m-2.262*se,9) t_low, round(m+2.262*se,9) t_high FROM s""")
def paired_seed_contrast(spark, sf):
    """Seed-paired difference of two arms with its t interval; ten shared seeds are demanded."""
    runs = _runs(spark, sf)
    out = paired_contrast(runs.where(F.col("arm") == "A"), runs.where(F.col("arm") == "N"),
                          seed="seed", value="value", seeds=10)
    return rounded(t_interval(out), *_SUMMARY_COLUMNS, "min", "max", "t_low", "t_high")


@registry.add(f"""{_RUNS}, d AS (SELECT r.arm, r.value v, r.value-b.value d FROM runs r JOIN runs b USING (seed) WHERE b.arm='N')
SELECT arm, count(*) n, round(avg(v),9) mean, round(coalesce(stddev_samp(v),0),9) sd_sample, round(avg(d),9)+0.0 delta, round(coalesce(stddev_samp(d),0),9) delta_sd FROM d GROUP BY 1""")
def arm_dose_response(spark, sf):
    """Every arm's mean with its seed-paired difference to the baseline arm."""
    return rounded(dose_response(_runs(spark, sf), "arm", "seed", "value", "N"), "mean", "sd_sample", "delta", "delta_sd")


@registry.add("""WITH m AS (SELECT l_linestatus, avg(l_quantity) FILTER (WHERE l_returnflag='A') a, avg(l_quantity) FILTER (WHERE l_returnflag='N') n,
 avg(l_quantity) FILTER (WHERE l_returnflag='R') r FROM lineitem GROUP BY 1)
SELECT l_linestatus, round(a,9) AS A, round(n,9) AS N, round(r,9) AS R, round(n-a,9) size_effect, round(r-n,9) class_effect, round(r-a,9) total_effect FROM m""")
def effect_decomposition(spark, sf):
    """Differences of arm means along a chain of arms."""
    means = arm_means(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", ["A", "N", "R"], ["l_linestatus"])
    out = decompose(means, {"size_effect": ("N", "A"), "class_effect": ("R", "N"), "total_effect": ("R", "A")})
    return rounded(out, "A", "N", "R", "size_effect", "class_effect", "total_effect")


@registry.add(f"""{_RUNS} SELECT arm, {_SUMMARY.format(v='value')}, round(avg(value)-1.96*stddev_samp(value)/sqrt(count(*)),9) low,
 round(avg(value)+1.96*stddev_samp(value)/sqrt(count(*)),9) high FROM runs GROUP BY 1""")
def arm_normal_interval(spark, sf):
    """Mean of every arm with its normal interval."""
    return rounded(normal_interval(mean_summary(_runs(spark, sf), ["arm"], "value")), *_SUMMARY_COLUMNS, "min", "max", "low", "high")


@registry.add("""WITH m AS (SELECT l_linenumber, avg(l_discount) FILTER (WHERE l_linestatus='O') a, avg(l_discount) FILTER (WHERE l_linestatus='F') b FROM lineitem GROUP BY 1)
SELECT l_linenumber, round(a,9) row_split, round(b,9) group_split, round(a-b,9) gap FROM m""")
def protocol_gaps(spark, sf):
    """Row-split less group-split mean per model."""
    return rounded(protocol_gap(table(spark, sf, "lineitem"), "l_linenumber", "l_linestatus", "l_discount", "O", "F"),
                   "row_split", "group_split", "gap")


# --- rates of events ----------------------------------------------------------------

def _user_rates(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))


_USERS = "WITH g AS (SELECT user_id, count(*) n, count(*) FILTER (WHERE event_type='error') k FROM events GROUP BY 1)"


@registry.add("""WITH g AS (SELECT event_type, count(*) n, count(*) FILTER (WHERE value>60) k FROM events GROUP BY 1),
f AS (SELECT n n0, k k0 FROM g ORDER BY event_type LIMIT 1)
SELECT event_type, k, n, round(k/n,9) rate, round(k/n-k0/n0,9) gap, round((k/n)/(k0/n0),9) ratio FROM g, f""")
def rate_gaps(spark, sf):
    """Difference and ratio of every rate to the first one."""
    rates = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 60).alias("k"))
    return rounded(rate_gap(rates, "event_type"), "rate", "gap", "ratio")


@registry.add("""WITH g AS (SELECT lang, count(*) n, count(*) FILTER (WHERE n_chars>2000) k FROM documents GROUP BY 1),
p AS (SELECT g.lang, g.k k1, g.n n1, f.k k2, f.n n2, (g.k+f.k)/(g.n+f.n) pool FROM g, (SELECT * FROM g ORDER BY lang LIMIT 1) f WHERE g.lang<>f.lang)
SELECT lang, round((k1/n1-k2/n2)/sqrt(pool*(1-pool)*(1/n1+1/n2)),9) z FROM p""")
def rate_tests(spark, sf):
    """Two-proportion z of every class against the first; the p-value is checked in the tests."""
    g = table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("k"))
    first = g.agg(F.min_by(F.struct("lang", "k", "n"), "lang").alias("_f"))
    z = two_proportion_z(F.col("k"), F.col("n"), F.col("_f.k"), F.col("_f.n"))
    return g.join(first, F.lit(True)).where(F.col("lang") != F.col("_f.lang")).select("lang", r9(z).alias("z"))


_TAIL_STEPS, _TAIL_REACH = 4000, 12.0


@registry.add(f"""{_USERS}, t AS (SELECT sum(n) tn, sum(k) tk FROM g),
q AS (SELECT user_id, k::DOUBLE k1, n::DOUBLE n1, (tk-k)::DOUBLE k2, (tn-n)::DOUBLE n2, (tk::DOUBLE/tn) pool FROM g, t),
z AS (SELECT user_id, (k1/n1-k2/n2)/sqrt(pool*(1-pool)*(1/n1+1/n2)) z FROM q),
a AS (SELECT user_id, z, i, abs(z)+i*{_TAIL_REACH}/{_TAIL_STEPS} x FROM z, (SELECT unnest(range({_TAIL_STEPS}+1)) i))
SELECT user_id, round(z,9) z, round(2*sum(exp(-x*x/2)*CASE WHEN i IN (0,{_TAIL_STEPS}) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*{_TAIL_REACH}/{_TAIL_STEPS}/3/sqrt(2*pi()),9) p
FROM a GROUP BY user_id, z""")
def rate_test_p(spark, sf):
    """Two-sided p-values of error rates per user against all other users."""
    users = _user_rates(spark, sf)
    total = users.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    z = two_proportion_z(F.col("k"), F.col("n"), F.col("_k") - F.col("k"), F.col("_n") - F.col("n"))
    return users.join(total, F.lit(True)).select("user_id", r9(z).alias("z"), r9(two_sided_p(z)).alias("p"))


_RATIO_REPS = f"rp AS (SELECT unnest(range({CLUSTER_REPS})) AS rep, 0 AS slot)"
_RATIO_DRAWS = " UNION ALL ".join(f"SELECT {h} AS h, rep, x::DOUBLE/{PRIME} AS u FROM {drawn_sql(f'ratio:{h + 1}', 'rp', '', 'rep', 'slot')}" for h in (0, 1))


@registry.add(f"""WITH s AS (SELECT user_id%2 AS h, count(*) n, count(*) FILTER (WHERE event_type='error') k FROM events GROUP BY 1),
l AS (SELECT h, n, i, sum(CASE WHEN i=0 THEN 0.0 ELSE ln((n-i+1)/i*((k/n)/(1-k/n))) END) OVER (PARTITION BY h ORDER BY i) l
  FROM (SELECT *, unnest(range(n+1)) i FROM s)),
w AS (SELECT h, n, i, exp(l-max(l) OVER (PARTITION BY h)) w FROM l),
c AS (SELECT h, n, i, sum(w) OVER (PARTITION BY h ORDER BY i)/sum(w) OVER (PARTITION BY h) f FROM w WHERE w>{LEAST_LIKELY}),
{_RATIO_REPS}, d AS ({_RATIO_DRAWS}), v AS (SELECT d.h, rep, i/n+{RATE_FLOOR} v FROM d ASOF JOIN c ON d.h=c.h AND d.u<c.f),
r AS (SELECT max(v) FILTER (WHERE h=0)/max(v) FILTER (WHERE h=1) r FROM v GROUP BY rep),
q AS (SELECT median(r) m, quantile_cont(r,0.025) lo, quantile_cont(r,0.975) hi FROM r)
SELECT round(m,9) median_ratio, round(lo,9) low, round(hi,9) high, round(log10(m),9) log10_median, round(log10(greatest(lo,{RATE_FLOOR})),9) log10_low, round(log10(hi),9) log10_high FROM q""")
def rate_ratio_bootstrap(spark, sf):
    """Binomial bootstrap of the ratio of two error rates."""
    events = table(spark, sf, "events")
    row = events.agg(*[f(F.col("user_id") % 2 == h).alias(f"n{h}") for h in (0, 1) for f in (F.count_if,)],
                     *[F.count_if((F.col("user_id") % 2 == h) & (F.col("event_type") == "error")).alias(f"k{h}") for h in (0, 1)]).first()
    out = ratio_bootstrap(row["k0"], row["n0"], row["k1"], row["n1"], spark)
    return rounded(out, *out.columns)


_NUMBERED = "num AS (SELECT *, row_number() OVER (ORDER BY md5('boot:'||user_id), user_id) pos, count(*) OVER () c FROM g)"
_RATES = f"""{_USERS}, {_NUMBERED},
slots AS (SELECT pos-1 AS slot, c, rep FROM num, (SELECT unnest(range({BOOT})) rep)),
draws AS (SELECT rep, x%c+1 AS pos FROM {drawn_sql('boot', 'slots', 'c', 'rep', 'slot')}),
rates AS (SELECT rep, CASE WHEN sum(n)>0 THEN sum(k)/sum(n) ELSE 0 END::DOUBLE rate FROM draws JOIN num USING (pos) GROUP BY 1)"""


@registry.add(f"""{_RATES} SELECT round(avg(rate),9) boot_mean, round(median(rate),9) boot_median, round(quantile_cont(rate,0.025),9) low,
 round(quantile_cont(rate,0.975),9) high FROM rates""")
def cluster_bootstrap_rate(spark, sf):
    """Percentile interval of the error rate when whole users are resampled."""
    rates = cluster_rates(_user_rates(spark, sf), "user_id", BOOT, "boot")
    return rounded(percentile_interval(rates, "rate"), "boot_mean", "boot_median", "low", "high")


def _phi_sql(x):
    """The normal distribution function by a Simpson sum from 0."""
    return (f"(0.5+list_sum(list_transform(range(0,2001), lambda t: exp(-pow(({x})*t/2000.0,2)/2)*CASE WHEN t IN (0,2000) THEN 1.0 "
            f"WHEN t%2=1 THEN 4.0 ELSE 2.0 END))*({x})/2000.0/3/sqrt(2*pi()))")


_MID = "((lo+hi)/2)"


def _bca_end_sql(z):
    q = f"greatest(0.0,least(1.0,{_phi_sql(f'z0+(z0+({z}))/(1-a*(z0+({z})))')}))"
    return f"(SELECT l[floor(p)::INTEGER+1]+(p-floor(p))*(l[least(floor(p)::INTEGER+2,len(l))]-l[floor(p)::INTEGER+1]) FROM (SELECT l, {q}*(len(l)-1) p FROM one))"


@registry.add(f"""{_RATES.replace('WITH', 'WITH RECURSIVE', 1)}, pt AS (SELECT sum(k)/sum(n) rate, sum(n) tn, sum(k) tk FROM g),
jk AS (SELECT CASE WHEN tn-n>0 THEN (tk-k)/(tn-n) ELSE 0 END::DOUBLE j FROM g, pt),
mo AS (SELECT sum(pow(mu-j,3)) m3, sum(pow(mu-j,2)) m2 FROM jk, (SELECT avg(j) mu FROM jk)),
be AS (SELECT count(*) FILTER (WHERE rates.rate<pt.rate) c, count(*) FILTER (WHERE rates.rate<pt.rate)/count(*) p FROM rates, pt),
bi AS (SELECT 0 AS i, -8.0::DOUBLE lo, 8.0::DOUBLE hi UNION ALL SELECT i+1, CASE WHEN {_phi_sql(_MID)}<p THEN {_MID} ELSE lo END,
 CASE WHEN {_phi_sql(_MID)}<p THEN hi ELSE {_MID} END FROM bi, be WHERE i<50),
one AS (SELECT pt.rate, CASE WHEN c>0 THEN lo ELSE 0.0 END z0, CASE WHEN m2>0 THEN m3/(6*pow(m2,1.5)) ELSE 0.0 END a, (SELECT list_sort(list(rate)) FROM rates) l
 FROM pt, mo, be, bi WHERE i=50)
SELECT round(rate,9) rate, round(z0,9) z0, round(a,9) acceleration, round({_bca_end_sql(f'-{Z}')},9) bca_low, round({_bca_end_sql(f'{Z}')},9) bca_high FROM one""")
def bca_rate(spark, sf):
    """Bias-corrected accelerated interval of the same rate."""
    users = materialise(_user_rates(spark, sf))
    rates = cluster_rates(users, "user_id", BOOT, "boot")
    return rounded(bca_interval(users, "user_id", rates), "rate", "z0", "acceleration", "bca_low", "bca_high")


@registry.add(f"""{_USERS}, r AS (SELECT n, k, row_number() OVER (ORDER BY k DESC, user_id) r FROM g)
SELECT d::INTEGER AS dropped, sum(n)::BIGINT n, sum(k)::BIGINT k, round(sum(k)/sum(n),9) rate FROM r, (SELECT unnest([1,2,3]) d) WHERE r>d GROUP BY 1""")
def leave_top_k_out(spark, sf):
    """Error rate after dropping the users with most errors."""
    return rounded(leave_top_out(_user_rates(spark, sf), "user_id"), "rate")


# --- paired deltas --------------------------------------------------------------------

def _deltas(spark, sf, groups):
    value = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return table(spark, sf, "events").groupBy((F.col("user_id") % groups).alias("team")).agg(
        F.round(value("click") - value("view"), 6).alias("delta")).where(F.col("delta").isNotNull())


def _deltas_sql(groups):
    return (f"d AS (SELECT user_id%{groups} AS team, round(avg(value) FILTER (WHERE event_type='click')-avg(value) FILTER (WHERE event_type='view'),6) AS delta "
            "FROM events GROUP BY 1 HAVING delta IS NOT NULL)")


@registry.add(f"""WITH {_deltas_sql(40)}, num AS (SELECT *, row_number() OVER (ORDER BY md5('pair:'||team), team) pos, count(*) OVER () c FROM d),
slots AS (SELECT pos-1 AS slot, c, rep FROM num, (SELECT unnest(range({PAIRS})) rep)),
draws AS (SELECT rep, x%c+1 AS pos FROM {drawn_sql('pair', 'slots', 'c', 'rep', 'slot')}),
m AS (SELECT rep, avg(delta) m FROM draws JOIN num USING (pos) GROUP BY 1)
SELECT round(avg(m),6) boot_mean, round(median(m),6) boot_median, round(quantile_cont(m,0.025),6) low, round(quantile_cont(m,0.975),6) high FROM m""")
def paired_delta_bootstrap(spark, sf):
    """Percentile interval of the mean of paired differences."""
    out = paired_bootstrap(_deltas(spark, sf, 40), "team", "delta", PAIRS, "pair")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@registry.add(f"""WITH {_deltas_sql(11)}, r AS (SELECT team, delta, row_number() OVER (ORDER BY abs(delta)) r FROM d WHERE delta<>0),
s AS (SELECT count(*) n, sum(r) FILTER (WHERE delta>0) p, sum(r) FILTER (WHERE delta<0) m FROM r),
w AS (SELECT b, sum(CASE WHEN (b>>(r-1))&1=1 THEN r ELSE 0 END) w FROM (SELECT unnest(range(2048)) b), r GROUP BY b),
p AS (SELECT avg((w<=p)::INTEGER) less, avg((w>=p)::INTEGER) more FROM w, s)
SELECT n, coalesce(p,0)::DOUBLE w_plus, coalesce(m,0)::DOUBLE w_minus, least(coalesce(p,0),coalesce(m,0))::DOUBLE w,
 round(least(1.0,2*least(less,more)),9)::DOUBLE p_two_sided, round(less,9)::DOUBLE p_less, 'exact' AS method FROM s, p""")
def signed_rank_test(spark, sf):
    """Exact Wilcoxon test of paired differences, against all sign assignments."""
    return rounded(signed_rank(_deltas(spark, sf, 11), [], "delta", "exact"), "p_two_sided", "p_less")


@registry.add(f"""WITH {_deltas_sql(12)}, t AS (SELECT team, round(delta*2) AS delta FROM d), z AS (SELECT * FROM t WHERE delta<>0),
r AS (SELECT delta, rank() OVER (ORDER BY abs(delta))+(count(*) OVER (PARTITION BY abs(delta))-1)/2 r, row_number() OVER (ORDER BY team) nth FROM z),
s AS (SELECT count(*) n, sum(r) FILTER (WHERE delta>0) p, sum(r) FILTER (WHERE delta<0) m FROM r),
w AS (SELECT b, sum(CASE WHEN (b>>(nth-1))&1=1 THEN r ELSE 0 END) w FROM (SELECT unnest(range((1<<(SELECT n FROM s))::BIGINT)) b), r GROUP BY b),
p AS (SELECT avg((w<=coalesce(p,0))::INTEGER) less, avg((w>=coalesce(p,0))::INTEGER) more FROM w, s)
SELECT n, coalesce(p,0)::DOUBLE w_plus, coalesce(m,0)::DOUBLE w_minus, least(coalesce(p,0),coalesce(m,0))::DOUBLE w,
 CASE WHEN n>0 THEN round(least(1.0,2*least(less,more)),9)::DOUBLE END p_two_sided, CASE WHEN n>0 THEN round(less,9)::DOUBLE END p_less, 'exact' AS method FROM s, p""")
def signed_rank_ties(spark, sf):
    """The exact test of coarse differences, many of them equal in size, against all sign assignments."""
    coarse = _deltas(spark, sf, 12).withColumn("delta", F.round(F.col("delta") * 2))
    return rounded(signed_rank(coarse, [], "delta", "exact"), "p_two_sided", "p_less")


@registry.add(f"""WITH {_deltas_sql(40)} SELECT count(*) n, round(avg(delta),6) mean, round(stddev_samp(delta),6) sd_sample,
 round(avg(delta)/stddev_samp(delta),6) d_z FROM d""")
def paired_effect_size(spark, sf):
    out = effect_size(_deltas(spark, sf, 40), [], "delta")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd_sample", "d_z")])


# --- agreement of two boards -------------------------------------------------------------

def _boards(spark, sf):
    """Two scores per nation: mean customer balance and mean supplier balance, coarse enough to tie."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("team")).agg(F.round(F.avg("c_acctbal") / 100).alias("x"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("team")).agg(F.round(F.avg("s_acctbal") / 1000).alias("y"))
    return c.join(s, "team")


_BOARD = """WITH b AS (SELECT c.team, x, y FROM (SELECT c_nationkey team, round(avg(c_acctbal)/100) x FROM customer GROUP BY 1) c
 JOIN (SELECT s_nationkey team, round(avg(s_acctbal)/1000) y FROM supplier GROUP BY 1) s USING (team)),
r AS (SELECT *, rank() OVER (ORDER BY x DESC)+(count(*) OVER (PARTITION BY x)-1)/2 rx, rank() OVER (ORDER BY y DESC)+(count(*) OVER (PARTITION BY y)-1)/2 ry FROM b)"""


@registry.add(f"""{_BOARD}, k AS (SELECT sum(sign(p.x-q.x)*sign(p.y-q.y)) s, sum((p.x<>q.x)::INTEGER) nx, sum((p.y<>q.y)::INTEGER) ny FROM b p JOIN b q ON p.team<q.team)
SELECT count(*) n, round(corr(x,y),9) pearson, round(corr(rx,ry),9) spearman, round(max(s)/sqrt(max(nx)*max(ny)),9) kendall FROM r, k""")
def rank_agreement(spark, sf):
    """Pearson, Spearman and tau-b of two boards with ties."""
    rows = materialise(_boards(spark, sf))
    out = (pearson(rows, [], "x", "y").join(spearman(rows, [], "x", "y").select("spearman"), F.lit(True))
           .join(kendall(rows, [], "x", "y").select("kendall"), F.lit(True)))
    return rounded(out, "pearson", "spearman", "kendall")


@registry.add(f"""{_BOARD} SELECT count(*) n, round(avg(abs(y-x)),9) mae, round(avg(y-x),9) bias, round(sqrt(avg((y-x)*(y-x))),9) rmse,
 round(avg(abs(ry-rx)),9) rank_mae, round(median(abs(ry-rx)),9) rank_median_error FROM r""")
def board_errors(spark, sf):
    return rounded(agreement_errors(_boards(spark, sf), [], "x", "y"), "mae", "bias", "rmse", "rank_mae", "rank_median_error")


# --- nulls and rank uncertainty ---------------------------------------------------------------

_TRIAL_COLUMNS = ("mean_delta", "median_delta", "rho", "max_drop", "max_rise", "median_abs_shift")


def _trial_sql(members):
    return f"""{PREDICTIONS}, {combined_sql('o', 'team', 'zero')}, {members},
tp AS (SELECT trial, pred.* FROM pred JOIN mem USING (vec_id)), tl AS (SELECT trial, long.* FROM long JOIN mem USING (vec_id)),
{combined_sql('u', 'trial, team', 'zero', 'tp', 'tl')},
j AS (SELECT trial, team, round(o.combined,12) a, round(u.combined,12) b FROM u JOIN o USING (team)),
k AS (SELECT *, b-a d, rank() OVER (PARTITION BY trial ORDER BY a DESC)+(count(*) OVER (PARTITION BY trial, a)-1)/2 ra,
  rank() OVER (PARTITION BY trial ORDER BY b DESC)+(count(*) OVER (PARTITION BY trial, b)-1)/2 rb FROM j),
trials AS (SELECT trial, count(*) n_teams, avg(d) mean_delta, median(d) median_delta, corr(ra,rb) rho, count(*) FILTER (WHERE abs(ra-rb)>1e-9) n_changed,
  min(ra-rb) max_drop, max(ra-rb) max_rise, median(abs(ra-rb)) median_abs_shift FROM k GROUP BY 1)"""


def _drawn_trials_sql(seed):
    """Every item's draw per trial; a subset takes the least."""
    counter = f"('0x'||substr(md5('{seed}:'||vec_id),1,7))::BIGINT"
    source = f"(SELECT vec_id, y, {counter} AS nth, trial FROM items, (SELECT unnest(range({NULLS}))::INTEGER trial))"
    return drawn_sql(seed, source, "vec_id, y", "trial", "nth")


_PLAIN = f"""mem AS (SELECT trial, vec_id FROM {_drawn_trials_sql('null')}
 QUALIFY row_number() OVER (PARTITION BY trial ORDER BY x, md5('null:'||vec_id), vec_id)<=150)"""
_TRIALS_OUT = "trial, n_teams, n_changed, " + ", ".join(f"round({c},9) {c}" for c in _TRIAL_COLUMNS)


def _trials(spark, sf, stratified=False):
    rows = scored(spark, sf)
    items = rows.where(F.col("team") == "team0").select("vec_id", "y")
    original = combined_scores(rows, ["team"], "zero")
    if stratified:
        members = random_memberships(items, "vec_id", NULLS, "strat", targets=proportional_targets(items, "y", 150), by=["y"])
    else:
        members = random_memberships(items, "vec_id", NULLS, "null", size=150)
    trials = replicate_scores(rows, members, NULLS, "vec_id", "team")
    return rows, original, null_trials(trials, original, "team")


@registry.add(f"{_trial_sql(_PLAIN)} SELECT {_TRIALS_OUT} FROM trials")
def random_null_trials(spark, sf):
    """Every team re-scored on random subsets of fixed size."""
    return rounded(_trials(spark, sf)[2], *_TRIAL_COLUMNS)


_STRAT = f"""cc AS (SELECT y, count(*) n FROM items GROUP BY 1), tt AS (SELECT y, n, round_even(n*150/(SELECT sum(n) FROM cc),0)::BIGINT t FROM cc),
goal AS (SELECT y, t + CASE WHEN row_number() OVER (ORDER BY n DESC, y)=1 THEN 150-(SELECT sum(t) FROM tt) ELSE 0 END AS target FROM tt),
mem AS (SELECT trial, vec_id FROM {_drawn_trials_sql('strat')} d JOIN goal USING (y)
 QUALIFY row_number() OVER (PARTITION BY trial, d.y ORDER BY x, md5('strat:'||vec_id), vec_id)<=target)"""


@registry.add(f"{_trial_sql(_STRAT)} SELECT {_TRIALS_OUT} FROM trials")
def stratified_null_trials(spark, sf):
    """The same with class shares kept."""
    return rounded(_trials(spark, sf, True)[2], *_TRIAL_COLUMNS)


_NULL = "".join(f", round(avg({v}),9) {v}_mean, round(quantile_cont({v},0.025),9) {v}_low, round(quantile_cont({v},0.975),9) {v}_high"
                for v in ("mean_delta", "rho", "n_changed"))


@registry.add(f"{_trial_sql(_PLAIN)} SELECT count(*) n_trials{_NULL} FROM trials")
def random_null_summary(spark, sf):
    out = null_summary(_trials(spark, sf)[2])
    return rounded(out, *[c for c in out.columns if c != "n_trials"])


@registry.add(f"""{_trial_sql(_PLAIN)},
op AS (SELECT * FROM pred WHERE part<3), ol AS (SELECT * FROM long WHERE part<3), {combined_sql('z', 'team', 'zero', 'op', 'ol')},
ob AS (SELECT avg(z.combined-o.combined) v FROM z JOIN o USING (team))
SELECT round(v,9) observed, round(v-(SELECT avg(mean_delta) FROM trials),9) attributable,
 round(v-(SELECT quantile_cont(mean_delta,0.975) FROM trials),9) low, round(v-(SELECT quantile_cont(mean_delta,0.025) FROM trials),9) high FROM ob""")
def attributable_effect(spark, sf):
    """Observed mean change of a subset less what random subsets of fixed size give."""
    rows, original, trials = _trials(spark, sf)
    subset = combined_scores(rows.where(F.col("part") < 3), ["team"], "zero").select("team", F.col("combined").alias("_s"))
    observed = subset.join(original.select("team", "combined"), "team").agg(F.avg(F.col("_s") - F.col("combined")).alias("observed"))
    return rounded(attributable(observed, null_summary(trials)), "observed", "attributable", "low", "high")


_REPS = f"""num AS (SELECT vec_id, row_number() OVER (ORDER BY md5('rank:'||vec_id), vec_id) pos, count(*) OVER () c FROM items),
slots AS (SELECT pos-1 AS slot, c, rep FROM num, (SELECT unnest(range({RANKS}))::INTEGER rep)),
dr AS (SELECT rep, x%c+1 AS pos, count(*) w FROM {drawn_sql('rank', 'slots', 'c', 'rep', 'slot')} GROUP BY 1,2),
wt AS (SELECT rep, vec_id, w FROM dr JOIN num USING (pos)),
wp AS (SELECT rep, w, pred.* FROM pred JOIN wt USING (vec_id)), wl AS (SELECT rep, w, long.* FROM long JOIN wt USING (vec_id)),
{combined_sql('b', 'rep, team', 'zero', 'wp', 'wl', 'w')},
rk AS (SELECT rep, team, row_number() OVER (PARTITION BY rep ORDER BY round(combined,12) DESC, team) r FROM b)"""


def _replicates(spark, sf):
    rows = scored(spark, sf)
    weights = resample_weights(rows.where(F.col("team") == "team0").select("vec_id"), "vec_id", RANKS, "rank")
    return rank_replicates(replicate_scores(rows, weights, RANKS, "vec_id", "team"), "team")


@registry.add(f"""{PREDICTIONS}, {_REPS}
SELECT team, median(r) rank_median, round(quantile_cont(r,0.025),9) rank_low, round(quantile_cont(r,0.975),9) rank_high, avg((r<=3)::INTEGER) top_probability FROM rk GROUP BY 1""")
def rank_bootstrap(spark, sf):
    """Rank ranges when rows are resampled and every team is re-scored."""
    return rounded(rank_ranges(_replicates(spark, sf), "team", 3), "rank_low", "rank_high")


@registry.add(f"""{PREDICTIONS}, {_REPS}, p AS (SELECT a.team team_a, b.team team_b, avg((a.r<b.r)::INTEGER) p FROM rk a JOIN rk b ON a.rep=b.rep AND a.team<b.team GROUP BY 1,2)
SELECT team_a, team_b, p AS p_a_above_b FROM p WHERE p>=0.95 OR p<=1-0.95""")
def sure_wins(spark, sf):
    """Team pairs of which one nearly always ranks above the other."""
    return win_probabilities(_replicates(spark, sf), "team")


QUERIES, SQL = registry.queries, registry.sql

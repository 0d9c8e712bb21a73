"""Queries over the driver's tables, one or more for each operator, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import expr
from quillon.operators import candidates as cand
from quillon.operators import case_path, conformal, events, gate, intervals, learners, memo, metrics, neighbours, resample, sequential, splits, toolcalls, trail
from quillon.plans import cases as v
from quillon.plans.cases import BANK, BOXES, CASES, KEPT, LEDGER, REPLAYS, REPORTS
from quillon.plans.written import shared_dir, written
from quillon.sources.grids import grids
from quillon.sources.snapshots import Snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def r9(x: str | Column) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 9)


def scored(s: SparkSession, d: str) -> DataFrame:
    return v.cases(s, d).withColumn("score", F.col("cand"))


# -- metrics ---------------------------------------------------------------------

_AUROC = "r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 r from x), g as (select sum(case when y = 1 then r end) rp, sum(y) p, sum(1 - y) n from r) select round((rp - p * (p + 1) / 2e0) / (cast(p as double) * n), 9) auroc from g"


@query("a1_auroc", f"with {CASES}, x as (select y, cand s from cases), {_AUROC}")
def _(s, d):
    return metrics.auroc(v.cases(s, d), score="cand").select(r9("auroc").alias("auroc"))


@query("a1_auroc_ties", f"with x as (select case when l_returnflag = 'R' then 1 else 0 end y, l_discount s from lineitem), {_AUROC}")
def _(s, d):
    x = v.table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_discount").alias("score"))
    return metrics.auroc(x).select(r9("auroc").alias("auroc"))


@query(
    "a1_auroc_by_site",
    f"with {CASES}, r as (select site, y, rank() over (partition by site order by cand) + (count(*) over (partition by site, cand) - 1) / 2e0 r from cases), g as (select site, sum(case when y = 1 then r end) rp, sum(y) p, sum(1 - y) n from r group by site) select site, round((rp - p * (p + 1) / 2e0) / (cast(p as double) * n), 9) auroc, cast(p + n as bigint) n_cases from g",
)
def _(s, d):
    return metrics.auroc_by(v.cases(s, d), ["site"], score="cand").select("site", r9("auroc").alias("auroc"), F.col("n_cases").cast("bigint").alias("n_cases"))


_THR = "n as (select cand s, row_number() over (order by cand) rn, count(*) over () n from cases where y = 0), t as (select max(case when rn = greatest(1, least(n, cast(ceil(0.96::double * n) as bigint))) then s end) thr from n)"


@query("a2_sens_at_spec", f"with {CASES}, {_THR} select round(avg(case when cand > thr then 1e0 else 0e0 end), 9) sensitivity from cases cross join t where y = 1")
def _(s, d):
    return metrics.sensitivity_at_specificity(scored(s, d)).select(r9("sensitivity").alias("sensitivity"))


@query(
    "a3_partial_auc",
    f"""with {CASES}, g as (select cand s, sum(y) p, sum(1 - y) n from cases group by cand),
r as (select s, sum(p) over (order by s desc) * 1e0 / sum(p) over () tpr, sum(n) over (order by s desc) * 1e0 / sum(n) over () fpr from g),
l as (select fpr x1, tpr y1, coalesce(lag(fpr) over (order by s desc), 0e0) x0, coalesce(lag(tpr) over (order by s desc), 0e0) y0 from r),
w as (select x0, y0, x1, y1, least(x1, 1e0 - 0.9e0) xc from l where x0 < 1e0 - 0.9e0)
select round(sum(case when xc > x0 then (xc - x0) * (y0 + y0 + (y1 - y0) * ((xc - x0) / (x1 - x0))) / 2 else 0 end) / (1e0 - 0.9e0), 9) partial_auc from w""",
)
def _(s, d):
    return metrics.partial_auc(scored(s, d)).select(r9("partial_auc").alias("partial_auc"))


@query("a4_brier", f"with {CASES} select round(avg((cand - y) * (cand - y)), 9) brier from cases")
def _(s, d):
    return metrics.brier(scored(s, d)).select(r9("brier").alias("brier"))


@query("a5_ece", f"with {CASES}, b as (select y, cand s, ntile(10) over (order by cand, case_id) t from cases), g as (select t, count(*) n, abs(avg(s) - avg(y)) d from b group by t) select round(sum(n * d) / sum(n), 9) ece from g")
def _(s, d):
    return metrics.ece_adaptive(scored(s, d)).select(r9("ece").alias("ece"))


_P = resample.PRIME
_WEIGHTS = f"""p as (select distinct pid, ('0x' || substr(md5(cast(pid as varchar)), 1, 7))::bigint code from cases),
h0 as (select it, pid, code, (it + 1) * {resample.FIRST} % {_P} a, (it + 1) * {resample.SECOND} % {_P} b from p cross join range({{n}}) r(it)),
h1 as (select *, (code * a + b) % {_P} v1 from h0), h2 as (select *, (v1 * v1 + a) % {_P} v2 from h1), h3 as (select *, (v2 * v2 + b) % {_P} v3 from h2), h4 as (select *, (v3 * v3 + code) % {_P} v4 from h3),
w as (select it, pid, cast({' + '.join(f'(v4 >= {c})::int' for c in resample.CUTS)} as bigint) w from h4)"""


@query("r1_weights", f"with {CASES}, {_WEIGHTS.format(n=2000)} select it, pid, w from w")
def _(s, d):
    return resample.hashed_weights(v.cases(s, d), 2000)


@query(
    "a7_paired_bootstrap",
    f"""with {CASES}, {_WEIGHTS.format(n=2000)}, {_THR.replace('n as (', 'nc as (').replace('from n)', 'from nc)').replace('t as (', 'tc as (')},
a as (select pid, y, 'cand' arm, cand s from cases union all select pid, y, 'champ', champ from cases),
g as (select it, arm, s, sum(y * w) p, sum((1 - y) * w) n from a join w using (pid) where w > 0 group by all),
c as (select *, sum(n) over (partition by it, arm order by s) upto, sum(n) over (partition by it, arm) nn from g),
t as (select it, arm, min(case when upto >= greatest(1, least(nn, ceil(0.96::double * nn))) then s end) thr from c group by all),
m as (select it, arm, sum(case when s > thr then p else 0 end) * 1e0 / sum(p) sens from c join t using (it, arm) group by all),
e as (select it, max(case when arm = 'cand' then sens end) - max(case when arm = 'champ' then sens end) d from m group by it),
th as (select max(case when rn = greatest(1, least(n, cast(ceil(0.96::double * n) as bigint))) then s end) thr from (select champ s, row_number() over (order by champ) rn, count(*) over () n from cases where y = 0)),
o as (select avg(case when cand > tc.thr then 1e0 else 0e0 end) - avg(case when champ > th.thr then 1e0 else 0e0 end) point from cases cross join tc cross join th where y = 1)
select round(point, 9) point, lo, hi, n from o, (select round(quantile_cont(d, 0.025), 9) lo, round(quantile_cont(d, 0.975), 9) hi, count(d) n from e)""",
)
def _(s, d):
    return resample.paired_delta(v.cases(s, d)).select(r9("point").alias("point"), r9("lo").alias("lo"), r9("hi").alias("hi"), "n")


@query(
    "a6_intervals",
    f"""with {CASES}, {_WEIGHTS.format(n=2000)}, w1 as (select it, pid, w from w where w > 0 union all select -1, pid, 1 from p),
g as (select it, cand s, sum(y * w) p, sum((1 - y) * w) n, sum(w * (cand - y) * (cand - y)) d from cases join w1 using (pid) group by all),
c as (select *, sum(n) over (partition by it order by s) upto, sum(n) over (partition by it) nn, sum(p) over (partition by it) pp from g),
t as (select it, min(case when upto >= greatest(1, least(nn, ceil(0.96::double * nn))) then s end) thr from c group by it),
m as (select it, sum(d) / sum(p + n) brier, case when min(pp) > 0 and min(nn) > 0 then sum(p * (upto - n / 2e0)) / (cast(min(pp) as double) * min(nn)) end auroc, case when min(pp) > 0 and min(nn) > 0 then sum(case when s > thr then p else 0 end) * 1e0 / min(pp) end sensitivity from c join t using (it) group by it),
u as (select it, 'auroc' metric, auroc x from m union all select it, 'brier', brier from m union all select it, 'sensitivity', sensitivity from m)
select metric, round(max(case when it < 0 then x end), 9) point, round(quantile_cont(x, 0.025) filter (it >= 0), 9) lo, round(quantile_cont(x, 0.975) filter (it >= 0), 9) hi, count(x) filter (it >= 0) n from u group by metric""",
)
def _(s, d):
    kinds = {"auroc": intervals.Auroc(), "brier": intervals.Brier(), "sensitivity": "sensitivity"}
    rows = [intervals.interval(v.cases(s, d), m, score="cand").select(F.lit(name).alias("metric"), r9("point").alias("point"), r9("lo").alias("lo"), r9("hi").alias("hi"), "n") for name, m in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


@query("a6_bootstrap_drawn")
def _(s, d):
    return resample.bootstrap(v.cases(s, d), ["cand", "champ"])


@query(
    "a8_efficiency",
    f"with {CASES}, {_THR}, {REPORTS}, s as (select avg(case when cand > thr then 1e0 else 0e0 end) v from cases cross join t where y = 1), c as (select sum(tool_calls) c, sum(usd) u, sum(wall_ms) w from reports) select round(v, 9) sensitivity, round(v / (c / 1000e0), 9) per_1k_calls, round(v / u, 9) per_usd, round(v / (w / 60000e0), 9) per_minute from s, c",
)
def _(s, d):
    e = metrics.efficiency(v.reports(s, d), metrics.sensitivity_at_specificity(scored(s, d)))
    return e.select(*(r9(c).alias(c) for c in e.columns))


@query("a9_lane_costs", f"with {REPORTS} select coalesce(nullif(lane, ''), 'unrouted') lane, count(*) n, round(coalesce(avg(tool_calls), 0), 9) mean_tool_calls, round(coalesce(avg(wall_ms), 0), 9) mean_wall_ms, round(coalesce(avg(usd), 0), 9) mean_usd from reports group by 1")
def _(s, d):
    e = events.lane_costs(v.reports(s, d))
    return e.select("lane", "n", *(r9(c).alias(c) for c in e.columns[2:]))


@query(
    "a10_ablation",
    f"""with {CASES}, x as (select 'cand' arm, case_id, y, cand s from cases union all select 'champ', case_id, y, champ from cases), r as (select *, rank() over (partition by arm order by s) + (count(*) over (partition by arm, s) - 1) / 2e0 r from x),
g as (select arm, sum(case when y = 1 then r end) rp, sum(y) p, sum(1 - y) n, avg(case when arm = 'cand' then coalesce(nullif(case_id % 9, 0), 0) else 4 end) c, avg(case_id % 50 * 1e0) w, avg(case when arm = 'cand' then 0.25e0 else 0e0 end) u from r group by arm),
neg as (select arm, s, row_number() over (partition by arm order by s) i, count(*) over (partition by arm) m from x where y = 0), t as (select arm, s t from neg where i = greatest(1, ceil(0.96e0 * m))), h as (select arm, avg(case when s > t then 1e0 else 0e0 end) sens from x join t using (arm) where y = 1 group by arm)
select arm, round((rp - p * (p + 1) / 2e0) / (cast(p as double) * n), 9) auroc, round(sens, 9) sensitivity, cast(p + n as bigint) n_cases, round(c, 9) mean_tool_calls, round(w, 9) mean_wall_ms, round(u, 9) mean_usd from g join h using (arm)""",
)
def _(s, d):
    c, k = v.cases(s, d), F.col("case_id")
    arm = lambda name, calls, usd: c.select("y", F.lit(name).alias("arm"), F.col(name).alias("score"), calls.alias("tool_calls"), (k % 50 * 1.0).alias("wall_ms"), usd.alias("usd"))
    arms = arm("cand", F.nullif(k % 9, F.lit(0)), F.lit(0.25)).unionByName(arm("champ", F.lit(4).cast("bigint"), F.lit(None).cast("double")))
    out = metrics.ablation(arms)
    return out.select("arm", r9("auroc").alias("auroc"), r9("sensitivity").alias("sensitivity"), F.col("n_cases").cast("bigint").alias("n_cases"), *(r9(x).alias(x) for x in out.columns if x.startswith("mean_")))


@query("a11_tool_calls", "with g as (select user_id case_id, event_type tool, count(*) n from events group by all) select case_id, string_agg(tool || '=' || n, ',' order by tool) calls from g group by case_id")
def _(s, d):
    e = events.tool_calls(v.table(s, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("tool")))
    return e.select("case_id", F.array_join(F.transform(F.map_entries("calls"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("calls"))


@query("a12_disagreement", f"with {BOXES}, r as (select case_id, read_id, max(case when score >= 0.3e0 then 1 else 0 end) p from reads group by all), g as (select case_id, avg(p) p from r group by case_id) select case_id, round(p * (1 - p) * 4, 9) disagreement from g")
def _(s, d):
    return cand.disagreement(v.reads(s, d), 0.3).select("case_id", r9("disagreement").alias("disagreement"))


@query("a13_case_score", f"with {BOXES}, {KEPT} select case_id, coalesce(max(case when kept then score end), 0) case_score from kept group by case_id")
def _(s, d):
    return cand.case_score(_kept(s, d))


@query(
    "a14_worst_slice",
    f"""with {CASES}, x as (select y, cand s, 'site=' || site slice from cases union all select y, cand, 'density=' || density from cases),
g as (select slice, s, sum(y) p, sum(1 - y) n from x group by all), c as (select *, sum(n) over (partition by slice order by s) upto, sum(n) over (partition by slice) nn from g),
t as (select slice, min(case when upto >= greatest(1, least(nn, ceil(0.96::double * nn))) then s end) thr from c group by slice)
select slice, cast(sum(p + n) as bigint) n, round(sum(case when s > thr then p else 0 end) * 1e0 / sum(p), 9) sensitivity from c join t using (slice) group by slice""",
)
def _(s, d):
    return metrics.worst_slice(scored(s, d), ["site", "density"]).select("slice", F.col("n").cast("bigint").alias("n"), r9("sensitivity").alias("sensitivity"))


@query(
    "a15_negative_flips",
    f"with {CASES}, t as (select quantile_cont(cand, 0.96) tc, quantile_cont(champ, 0.96) th from cases where y = 0) select count(*) filter (champ > th and cand <= tc) flips, count(*) filter (champ > th) champion_correct, round(count(*) filter (champ > th and cand <= tc) * 1e0 / greatest(count(*) filter (champ > th), 1), 9) flip_rate from cases cross join t where y = 1",
)
def _(s, d):
    return metrics.negative_flips(v.cases(s, d)).select("flips", "champion_correct", r9("flip_rate").alias("flip_rate"))


@query("a16_agreement", f"with {CASES} select round(avg(case when abs(cand - rerun) <= 1e-8 + 1e-5 * abs(rerun) then 1e0 else 0e0 end), 9) agreement from cases")
def _(s, d):
    return metrics.agreement(v.cases(s, d)).select(r9("agreement").alias("agreement"))


@query("a17_promotion_rate", "with l as (select value > 20 p from events where event_type = 'purchase' order by event_id desc limit 50) select round(coalesce(avg(p::int), 0), 9) promotion_rate from l")
def _(s, d):
    e = v.table(s, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "gate_evaluation").otherwise("tool_call").alias("kind"), (F.col("value") > 20).alias("gate_passed"))
    return sequential.promotion_rate(e).select(r9("promotion_rate").alias("promotion_rate"))


@query("a18_pass_rate", f"with {REPLAYS} select policy_id, round(avg(passed::int), 9) pass_rate from replays where status = 'confirmed' and policy_id = 'p1' group by 1")
def _(s, d):
    return events.pass_rate(v.replays(s, d).where("policy_id = 'p1'")).select(F.lit("p1").alias("policy_id"), r9("pass_rate").alias("pass_rate"))


@query(
    "a19_regressions",
    f"with {REPLAYS}, c as (select record_id, passed from replays where policy_id = 'p2' and status = 'confirmed'), h as (select record_id, passed b from replays where policy_id = 'p1'), j as (select c.*, coalesce(b, false) b from c left join h using (record_id)) select count(*) filter (not passed and b) regressions, count(*) filter (not passed) failed, array_to_string(list_slice(list_sort(list(record_id) filter (not passed and b)), 1, 5), ',') first5 from j",
)
def _(s, d):
    r = v.replays(s, d)
    return events.regressions(r.where("policy_id = 'p2'"), r.where("policy_id = 'p1'")).select("regressions", "failed", F.array_join("first5", ",").alias("first5"))


@query("a20_transfer_matrix", f"with {REPLAYS} select policy_id, record_id, bool_or(passed) passed from replays group by all")
def _(s, d):
    return events.transfers(v.replays(s, d))


@query("a20_flips", f"with {REPLAYS}, l as (select *, lag(passed) over (partition by record_id order by ts) b from replays) select record_id, policy_id from l where b and not passed")
def _(s, d):
    return events.flips(v.replays(s, d))


@query("a21_efficiency_ratio", f"with {REPORTS}, g as (select avg(case when arm = 'cand' then usd end) cu, avg(case when arm = 'champ' then usd end) hu, avg(case when arm = 'cand' then tool_calls end) ct, avg(case when arm = 'champ' then tool_calls end) ht from reports) select round(cu / hu, 9) cost_ratio, round(ct / ht, 9) call_ratio from g")
def _(s, d):
    return sequential.efficiency_ratios(v.reports(s, d)).select(r9("cost_ratio").alias("cost_ratio"), r9("call_ratio").alias("call_ratio"))


_BINS = f"""{CASES}, b as (select range bin, range / 10e0 lo from range(10)), c as (select least(cast(floor(cand * 10) as bigint), 9) raw, cand, (case_id % 10 < 9 or cand < 0.3e0) agrees from cases),
e as (select (cand >= 1 / 10e0)::int + (cand >= 2 / 10e0)::int + (cand >= 3 / 10e0)::int + (cand >= 4 / 10e0)::int + (cand >= 5 / 10e0)::int + (cand >= 6 / 10e0)::int + (cand >= 7 / 10e0)::int + (cand >= 8 / 10e0)::int + (cand >= 9 / 10e0)::int bin, agrees from c),
g as (select bin, count(*) n, avg(agrees::int) agreement from e group by bin), bins as (select cast(b.bin as int) bin, lo, coalesce(n, 0) n, agreement from b left join g on b.bin = g.bin)"""


def _agreement(s, d):
    c = v.cases(s, d).select(F.col("cand").alias("confidence"), ((F.col("case_id") % 10 < 9) | (F.col("cand") < 0.3)).alias("agrees"))
    return learners.agreement_bins(c)


@query("a22_agreement_bins", f"with {_BINS} select bin, lo, n, round(agreement, 9) agreement from bins")
def _(s, d):
    return _agreement(s, d).select("bin", "lo", "n", r9("agreement").alias("agreement"))


@query("a23_confidence_threshold", f"with {_BINS}, w as (select lo, min(agreement) over (order by lo desc) worst, sum(n) over (order by lo desc) above from bins) select min(case when above > 0 and worst >= 0.85e0 then lo end) tau from w")
def _(s, d):
    return learners.confidence_threshold(_agreement(s, d), 0.85)


_Q = f"""{CASES}, p as (select 1 - cand a, row_number() over (order by 1 - cand) rn, count(*) over () n from cases where y = 1), m as (select cand a, row_number() over (order by cand) rn, count(*) over () n from cases where y = 0),
q as (select (select coalesce(max(case when rn = ceil((n + 1) * (1e0 - 0.1e0)) then a end), 'infinity'::double) from p) q_pos, (select coalesce(max(case when rn = ceil((n + 1) * (1e0 - 0.1e0)) then a end), 'infinity'::double) from m) q_neg)"""


@query("a24_conformal_fit", f"with {_Q} select q_pos, q_neg from q")
def _(s, d):
    return conformal.fit(scored(s, d))


@query("p8_prediction_sets", f"with {_Q} select case_id, concat(case when 1 - cand <= q_pos then '1' else '' end, case when cand <= q_neg then '0' else '' end) labels, ((1 - cand <= q_pos)::int + (cand <= q_neg)::int) <> 1 ambiguous from cases cross join q")
def _(s, d):
    c = scored(s, d)
    return conformal.prediction_sets(c, conformal.fit(c)).select("case_id", F.array_join(F.col("labels").cast("array<string>"), "").alias("labels"), "ambiguous")


@query(
    "p9_conformal_override",
    f"with {_Q}, d as (select case_id, case when cand > 0.65e0 then 'recall' when cand >= 0.35e0 then 'defer_to_human' else 'no_recall' end dec, ((1 - cand <= q_pos)::int + (cand <= q_neg)::int) <> 1 amb from cases cross join q) select case_id, case when dec <> 'defer_to_human' and amb then 'defer_to_human' else dec end decision from d",
)
def _(s, d):
    c = scored(s, d)
    x = conformal.prediction_sets(c, conformal.fit(c))
    dec = F.when(F.col("cand") > 0.65, "recall").when(F.col("cand") >= 0.35, "defer_to_human").otherwise("no_recall")
    return x.select("case_id", conformal.override(dec, F.col("ambiguous")).alias("decision"))


@query("a25_cluster_differences", f"with {CASES} select pid, round(avg(cand - champ) + 0.02e0, 9) x, min(case_id) first from cases where y = 1 group by pid")
def _(s, d):
    return sequential.payoffs(v.cases(s, d), 0.02, order="case_id").select("pid", r9("x").alias("x"), "first")


@query("a26_balanced_sample", "with r as (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) rn, count(*) over (partition by source) n from documents), m as (select min(n) least from r) select doc_id, source from r cross join m where rn <= least")
def _(s, d):
    return splits.balanced_sample(v.table(s, d, "documents").select("doc_id", "source"), "source", "doc_id")


# -- gate and sequential ----------------------------------------------------------

_WEALTH = f"""{CASES}, o as (select avg(cand - champ) + 0.02e0 x, row_number() over (order by min(case_id)) - 1 i from cases where y = 1 group by pid),
b as (select floor(i / 25e0) b, x, i from o), g as (select b, sum(x) sx, sum(x * x) sx2 from b group by b),
l as (select b, greatest(0e0, least(0.5e0 / 0.98e0, (0.02e0 + coalesce(sum(sx) over (order by b rows between unbounded preceding and 1 preceding), 0)) / (0.0004e0 + 0.25e0 + coalesce(sum(sx2) over (order by b rows between unbounded preceding and 1 preceding), 0)))) lam from g),
p as (select i, b.b, lam, sum(ln(1 + lam * x)) over (order by i rows between unbounded preceding and current row) lw from b join l on b.b = l.b)"""


def _path(s, d):
    return sequential.wealth(sequential.payoffs(v.cases(s, d), 0.02, order="case_id"), batch_size=25)


@query("w3_wealth_path", f"with {_WEALTH} select cast(i as bigint) i, round(lam, 8) lam, round(lw, 8) log_wealth from p")
def _(s, d):
    return _path(s, d).select("i", F.round("lam", 8).alias("lam"), F.round("log_wealth", 8).alias("log_wealth"))


@query("x16_eprocess", f"with {_WEALTH} select count(*) n, round(greatest(max(lw), 0e0), 8) max_log_wealth, min(case when lw >= ln(20e0) then i + 1 end) accepted_at from p")
def _(s, d):
    return sequential.verdict(_path(s, d)).select("n", F.round("max_log_wealth", 8).alias("max_log_wealth"), "accepted_at")


@query("x21_gate")
def _(s, d):
    r = v.replays(s, d)
    return gate.run_gate(v.cases(s, d), None, ["site", "density"], rerun="rerun", regressions=events.regressions(r.where("policy_id = 'p2'"), r.where("policy_id = 'p1'")), costs=v.reports(s, d), path=_path(s, d))


# -- candidates and decisions --------------------------------------------------------


def _kept(s, d):
    return cand.reproduction(v.candidates(s, d), v.reads(s, d), 5, least=2)


@query("j2_reproduction", f"with {BOXES}, {KEPT} select case_id, candidate_id, reproduced, reproduced_fraction, kept from kept")
def _(s, d):
    return _kept(s, d).select("case_id", "candidate_id", "reproduced", "reproduced_fraction", "kept")


@query("j3_unexamined", f"with {BOXES} select case_id, event_id from blindspots b where score >= 0.2e0 and not exists (select 1 from candidates e where e.case_id = b.case_id and (((b.x0 + b.x1) / 2e0 between e.x0 and e.x1 and (b.y0 + b.y1) / 2e0 between e.y0 and e.y1) or {v.sql_iou('b', 'e')} > 0.1e0))")
def _(s, d):
    return cand.unexamined(v.blindspots(s, d), v.candidates(s, d), 0.2).select("case_id", "event_id")


@query(
    "j13_zoom_confirm",
    f"""with {BOXES}, {KEPT}, z as (select *, kept and row_number() over (partition by case_id, kept order by candidate_id) <= 8 zoomed from kept),
ok as (select distinct c.case_id, c.candidate_id from z c join reads r on r.case_id = c.case_id and r.event_id % 7 = c.candidate_id % 7 where zoomed and abs((r.x0 + r.x1) / 2e0 - 220 / 2e0) < 220 / 3e0 and abs((r.y0 + r.y1) / 2e0 - 200 / 2e0) < 200 / 3e0 and r.score >= 0.4e0 * c.score)
select z.case_id, z.candidate_id, case when zoomed then ok.case_id is not null else kept end zoom_confirmed, kept and (case when zoomed then ok.case_id is not null else kept end) kept from z left join ok using (case_id, candidate_id)""",
)
def _(s, d):
    z = cand.zoom_budget(_kept(s, d), 8)
    r = v.reads(s, d).select("case_id", F.col("event_id").alias("e"), "x0", "y0", "x1", "y1", "score")
    crops = z.where("zoomed").select("case_id", "candidate_id").join(r, "case_id").where("e % 7 = candidate_id % 7").select("case_id", "candidate_id", F.lit(220).alias("width"), F.lit(200).alias("height"), "x0", "y0", "x1", "y1", "score")
    return cand.zoom_confirm(z, crops).select("case_id", "candidate_id", "zoom_confirmed", "kept")


@query("p1_quality_verdict", "with x as (select vec_id, list_max(embedding) - list_min(embedding) r, len(list_filter(embedding, lambda e: e >= 0.1::float)) / cast(len(embedding) as double) b from embeddings) select vec_id, case when r < 0.4e0 then 'inadequate_defer' when b > 0.2e0 then 'degraded' else 'adequate' end qc from x")
def _(s, d):
    return v.vectors(s, d).select("vec_id", cand.quality_verdict(F.col("embedding"), 0.4, 0.1, 0.2).alias("qc"))


@query("p2_lane", f"with {BOXES}, t as (select case_id, max(score) top from candidates group by 1), b as (select case_id, count(*) n from blindspots where score >= 0.3e0 group by 1) select p.case_id, case when coalesce(top, 0) < 0.7e0 and coalesce(n, 0) = 0 then 'fast_negative' else 'routine' end lane from patients p left join t using (case_id) left join b using (case_id)")
def _(s, d):
    t = v.candidates(s, d).groupBy("case_id").agg(F.max("score").alias("top"))
    b = v.blindspots(s, d).where("score >= 0.3").groupBy("case_id").agg(F.count("*").alias("n"))
    return v.patients(s, d).join(t, "case_id", "left").join(b, "case_id", "left").select("case_id", cand.lane(F.col("top"), F.coalesce("n", F.lit(0)), 0.7).alias("lane"))


_CROPPED = """crops as (select c.case_id, c.candidate_id, r.x0, r.y0, r.x1, r.y1, r.score from candidates c join reads r on r.case_id = c.case_id and r.event_id % 7 = c.candidate_id % 7)"""
_LEFT = f"""left_ as (select case_id, count(*) n from blindspots b where score >= 0.55e0 and not exists (select 1 from candidates e where e.case_id = b.case_id and (((b.x0 + b.x1) / 2e0 between e.x0 and e.x1 and (b.y0 + b.y1) / 2e0 between e.y0 and e.y1) or {v.sql_iou('b', 'e')} > 0.1e0)) group by 1)"""
_RUN = f"""with {BOXES}, {KEPT}, {_CROPPED}, {_LEFT},
tops as (select case_id, max(score) top, count(*) m from candidates group by 1),
lanes as (select p.case_id, qc, coalesce(n, 0) nb, m, case when qc <> 'inadequate_defer' then case when coalesce(top, 0) < 0.2e0 and coalesce(n, 0) = 0 then 'fast_negative' else 'routine' end end lane from patients p left join tops using (case_id) left join left_ using (case_id)),
v1 as (select k.* exclude (kept, reproduced_fraction), lane = 'routine' and kept kept, case when lane = 'routine' then reproduced_fraction else 0e0 end fraction from kept k join lanes using (case_id) where lane is not null),
v2 as (select *, kept and row_number() over (partition by case_id, kept order by candidate_id) <= 8 zoomed from v1),
ok as (select distinct c.case_id, c.candidate_id from v2 c join crops r using (case_id, candidate_id) where zoomed and abs((r.x0 + r.x1) / 2e0 - 110e0) < 220 / 3e0 and abs((r.y0 + r.y1) / 2e0 - 100e0) < 200 / 3e0 and r.score >= 0.4e0 * c.score),
v3 as (select v2.* exclude (kept), case when zoomed then ok.case_id is not null else kept end zoom_confirmed, kept and (case when zoomed then ok.case_id is not null else kept end) zk from v2 left join ok using (case_id, candidate_id)),
v4 as (select *, zk and (candidate_id % 11 = 0 or candidate_id % 9 > 6) vetoed, zk and not (candidate_id % 11 = 0 or candidate_id % 9 > 6) keep from v3),
rd as (select case_id, read_id, max(case when score >= 0.5e0 then 1 else 0 end) p from reads group by all), dis as (select case_id, 4 * avg(p) * (1 - avg(p)) ds from rd group by 1),
agg as (select case_id, max(case when keep then score end) sc, count(*) filter (keep) k, count(*) filter (vetoed) nv, avg(fraction) fr from v4 group by 1),
s as (select l.case_id, qc, lane, nb, coalesce(k, 0) k, coalesce(nv, 0) nv, coalesce(fr, 0) fr, case when lane is null then 0.5e0 else 0.5e0 * coalesce(sc, 0) + 0.5e0 * (l.case_id % 100 / 100e0) end sc, case when lane is null then 1e0 when lane = 'routine' and m is not null then coalesce(ds, 0) else 0e0 end ds from lanes l left join agg using (case_id) left join dis using (case_id)),
r as (select *, case when lane is null or ds > 0.4e0 or sc between 0.35e0 and 0.65e0 then 'defer_to_human' when sc > 0.65e0 then 'recall' when nb > 0 then 'defer_to_human' else 'no_recall' end rule, ((1 - sc <= 0.45e0)::int + (sc <= 0.7e0)::int) <> 1 amb from s),
w as (select *, lane is not null and (rule = 'defer_to_human' or amb or nb > 0) wanted from r),
st as (select *, case when not wanted then null when fr <= 0.05e0 then case when sc <= 0.3e0 then 'no_recall' end else case when sc > 0.6e0 then 'recall' end end said from w),
q as (select *, wanted and said is null wants, case_id % 3 batch from st),
n as (select case_id, ceil(0.25e0 * row_number() over o) - sum(wants::int) over o slack from q where lane is not null window o as (partition by batch order by case_id rows between unbounded preceding and current row)),
b as (select q.*, wants and not (slack < 0 and slack < coalesce(min(slack) over (partition by batch order by case_id rows between unbounded preceding and 1 preceding), 0)) inv from q join n using (case_id) union all by name select q.*, false inv from q where lane is null),
d as (select *, case when said is not null then said when inv and case_id % 5 <> 0 then case when case_id % 2 = 0 then 'recall' else 'defer_to_human' end else rule end dec from b),
fin as (select case_id, qc, case when inv then 'hard' else lane end lane, k n_kept, round(sc, 9) case_score, round(ds, 9) disagreement, nb n_blindspot, wanted escalation_wanted, said is not null student_absorbed, inv llm_invoked, wants and not inv llm_denied_by_cap,
  case when lane is not null and amb and dec <> 'defer_to_human' then 'defer_to_human' else dec end decision,
  case when lane is null then 'preflight QC' when dec <> 'defer_to_human' then case when amb then 'conformal set is not a singleton' end when said is not null then 'student' when inv then 'costly adjudicator' else 'rules' end deferral_reason from d),
found as (select case_id, candidate_id, score, greatest(x1 - x0, y1 - y0) * 0.1e0 size_mm, case when fraction >= 0.6e0 and zoom_confirmed then case when score >= 0.5e0 then 'present' else 'uncertain' end else 'absent' end assessment from v4 where keep)"""

#: Sure of low scores without reproduction and of high ones with it, unsure of the rest.
_SURE = {"tree": {"feature": 0, "threshold": 0.05, "left": {"feature": 1, "threshold": 0.3, "left": {"leaf": [0, 9, 1]}, "right": {"leaf": [4, 3, 3]}}, "right": {"feature": 1, "threshold": 0.6, "left": {"leaf": [3, 4, 3]}, "right": {"leaf": [8, 0, 2]}}}}


def _run(s, d):
    """Every stage of the case path over the view of the tables as cases."""
    c, r = v.candidates(s, d), v.reads(s, d)
    at = r.select("case_id", (F.col("event_id") % 7).alias("_m"), "x0", "y0", "x1", "y1", "score")
    crops = c.select("case_id", "candidate_id", (F.col("candidate_id") % 7).alias("_m")).join(at, ["case_id", "_m"]).withColumns({"width": F.lit(220), "height": F.lit(200)})
    segments = c.select("case_id", "candidate_id", (F.col("candidate_id") % 11 != 0).alias("found"), F.lit("no seed").alias("reason"), (F.col("candidate_id") % 9 / 2.0).alias("aspect_ratio"))
    k = F.col("case_id")
    people = v.patients(s, d).withColumns({"head": k % 100 / 100.0, "batch": k % 3})
    answers = people.where(k % 5 != 0).select("case_id", F.when(k % 2 == 0, "recall").otherwise("defer_to_human").alias("decision"))
    return case_path.run(
        people, c, r, v.blindspots(s, d), 5, {"min_reproduced": 2, "student_min_confidence": 0.75}, crops=crops, segments=segments, head="head", thresholds=s.range(1).selectExpr("0.45d as q_pos", "0.7d as q_neg"),
        student=learners.Student("tree", ["mean_reproduced_fraction", "case_score"], _SURE), answers=answers, batch="batch",
        # the order in which the SQL's window over (case_id, kept) hands candidates to its avg
        mean_order=[F.col("reproduced") >= 2, F.col("candidate_id")],
    )


@query("x22_run_cases", f"{_RUN} select * from fin")
def _(s, d):
    r = _run(s, d).cases
    return r.withColumns({"case_score": r9("case_score"), "disagreement": r9("disagreement")})


@query("x22_findings", f"{_RUN} select case_id, candidate_id, score, round(size_mm, 9) size_mm, assessment from found")
def _(s, d):
    return _run(s, d).findings.select("case_id", "candidate_id", "score", r9("size_mm").alias("size_mm"), "assessment")


@query(
    "x22_trail",
    f"{_RUN}, e as (select v4.case_id, count(*) nv, count(*) filter (vetoed) nx, count(*) filter (keep) nk from v4 join lanes l on l.case_id = v4.case_id where l.lane = 'routine' group by 1) select lanes.case_id, 2 + (lane is not null)::int + coalesce(nv, 0) + coalesce(nx, 0) + coalesce(nk, 0) entries, true intact, 2 * coalesce(nk, 0) cited, true resolved from lanes left join e using (case_id)",
)
def _(s, d):
    """How many entries of each kind the chains have, whether all chains are whole, and whether each cited hash is an entry of the finding's case."""
    entries, cited = trail.trail(_run(s, d))
    whole = events.verify_chain(entries, "case_id", "seq", "body").select("case_id", "entries", "intact")
    refs = cited.select("case_id", F.explode("evidence").alias("entry_sha"))
    found = refs.join(entries.select("case_id", "entry_sha", F.lit(True).alias("_there")), ["case_id", "entry_sha"], "left").groupBy("case_id").agg(F.count("*").alias("cited"), F.every(F.coalesce("_there", F.lit(False))).alias("resolved"))
    return whole.join(found, "case_id", "left").select("case_id", "entries", "intact", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("resolved", F.lit(True)).alias("resolved"))


@query("x22_reviews", f"{_RUN}, g as (select case_id, count(*) n, string_agg(candidate_id, ',' order by candidate_id) ids from found group by 1) select case_id, deferral_reason reason, coalesce(n, 0) n_regions, coalesce(ids, '') ids from fin left join g using (case_id) where decision = 'defer_to_human'")
def _(s, d):
    r = _run(s, d).reviews
    return r.select("case_id", "reason", F.size("regions").cast("bigint").alias("n_regions"), F.array_join(F.transform("regions", lambda x: x["candidate_id"].cast("string")), ",").alias("ids"))


@query("x23_lane_counts", f"{_RUN} select lane, count(*) n, count(*) filter (escalation_wanted) wanted, count(*) filter (student_absorbed) absorbed, count(*) filter (llm_invoked) invoked, count(*) filter (llm_denied_by_cap) denied from fin where lane is not null group by 1")
def _(s, d):
    return events.lane_counts(_run(s, d).cases)


@query(
    "p3_escalate",
    f"with {CASES} select case_id, (dec = 'defer_to_human' or amb or bs > 0) escalate from (select case_id, case when cand > 0.65e0 then 'recall' when cand >= 0.35e0 then 'defer_to_human' else 'no_recall' end dec, case_id % 11 = 0 amb, case_id % 13 // 12 bs from cases)",
)
def _(s, d):
    dec = F.when(F.col("cand") > 0.65, "recall").when(F.col("cand") >= 0.35, "defer_to_human").otherwise("no_recall")
    return v.cases(s, d).select("case_id", cand.escalate(dec, F.col("case_id") % 11 == 0, F.floor(F.col("case_id") % 13 / 12)).alias("escalate"))


@query("p4_decide", f"with {CASES} select case_id, case when case_id % 10 = 0 then 'defer_to_human' when champ > 0.4e0 then 'defer_to_human' when cand between 0.35e0 and 0.65e0 then 'defer_to_human' when cand > 0.65e0 then 'recall' when case_id % 3 > 0 then 'defer_to_human' else 'no_recall' end decision from cases")
def _(s, d):
    qc = F.when(F.col("case_id") % 10 == 0, "inadequate_defer").otherwise("adequate")
    return v.cases(s, d).select("case_id", cand.decide(qc, F.col("champ"), F.col("cand"), F.col("case_id") % 3).alias("decision"))


@query("p5_assess", f"with {BOXES}, {KEPT} select case_id, candidate_id, case when candidate_id % 7 = 0 then 'absent' when reproduced_fraction >= 0.6e0 and coalesce(case when candidate_id % 2 = 0 then candidate_id % 5 <> 0 end, true) then case when score >= 0.5e0 then 'present' else 'uncertain' end else 'absent' end assessment from kept")
def _(s, d):
    confirmed = F.when(F.col("candidate_id") % 2 == 0, F.col("candidate_id") % 5 != 0)
    return _kept(s, d).select("case_id", "candidate_id", cand.assess(F.col("candidate_id") % 7 == 0, F.col("reproduced_fraction"), confirmed, F.col("score")).alias("assessment"))


@query(
    "p6_features",
    f"""with {BOXES}, {KEPT}, c as (select case_id, count(*) a, count(*) filter (kept) b, count(*) filter (candidate_id % 7 = 0) c, max(score) d, avg(reproduced_fraction) e, max(case when kept then score end) f from kept group by 1), b as (select case_id, count(*) n from blindspots group by 1)
select p.case_id, coalesce(f, 0) case_score, 0.25e0 disagreement_rate, coalesce(a, 0)::double n_candidates, coalesce(b, 0)::double n_kept, coalesce(c, 0)::double n_vetoed, coalesce(d, 0) max_candidate_score, round(coalesce(e, 0), 9) mean_reproduced_fraction, coalesce(n, 0)::double n_blindspot, case when qc = 'adequate' then 1e0 else 0e0 end qc_adequate from patients p left join c using (case_id) left join b using (case_id)""",
)
def _(s, d):
    k = _kept(s, d).withColumn("vetoed", F.col("candidate_id") % 7 == 0)
    c = v.patients(s, d).join(cand.case_score(k), "case_id", "left").withColumn("case_score", F.coalesce("case_score", F.lit(0.0))).withColumn("disagreement", F.lit(0.25))
    return cand.features(c, k, v.blindspots(s, d)).withColumn("mean_reproduced_fraction", r9("mean_reproduced_fraction"))


@query("p7_compact", f"with {BOXES}, r as (select *, row_number() over (partition by case_id order by score desc, candidate_id) rn from candidates) select case_id, string_agg(cast(candidate_id as varchar), ',' order by rn) filter (rn <= 8) ids, count(*) filter (rn > 8) omitted, max(score) filter (rn > 8) max_omitted from r group by 1")
def _(s, d):
    return cand.compact(v.candidates(s, d)).select("case_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "omitted", "max_omitted")


@query("p7_compact_request")
def _(s, d):
    c = v.patients(s, d).join(cand.case_score(_kept(s, d)), "case_id", "left").withColumn("disagreement", F.lit(0.25))
    return cand.compact_request(c, _kept(s, d))


@query("w11_zoom_budget", f"with {BOXES}, {KEPT} select case_id, candidate_id, kept and row_number() over (partition by case_id, kept order by candidate_id) <= 3 zoomed from kept")
def _(s, d):
    return cand.zoom_budget(_kept(s, d), 3).select("case_id", "candidate_id", "zoomed")


@query("j12_findings", f"with {BOXES}, {KEPT} select case_id, candidate_id, case when candidate_id % 3 = 0 then 'present' else 'uncertain' end assessment from kept where kept")
def _(s, d):
    k = _kept(s, d)
    m = k.where("candidate_id % 3 = 0").groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("candidate_id").cast("string"), F.lit("present")))).alias("per_candidate"))
    return cand.findings(k, m).select("case_id", "candidate_id", "assessment")


@query("p10_tags", "select doc_id, regexp_matches(source, '^[A-Za-z0-9_.:+/=-]{1,64}$') and regexp_matches(text, '^[A-Za-z0-9_.:+/=-]{1,64}$') valid from documents")
def _(s, d):
    return v.table(s, d, "documents").select("doc_id", expr.valid_tags(F.create_map("source", "text")).alias("valid"))


@query("p11_record_validity", f"with {BANK} select record_id, seq, record_id % 3 <> seq % 3 and not (kind = 'confirm' and record_id % 2 = 0) and seq % 4 in (0, 1) valid from bank")
def _(s, d):
    b, c = v.bank_events(s, d), F.col
    source, status = F.when(c("record_id") % 2 == 0, "eval_miss").otherwise("report"), F.when(c("kind") == "confirm", "confirmed").otherwise("probation")
    return b.select("record_id", "seq", events.valid_record(c("seq") % 4, c("record_id") % 3, c("seq") % 3, source, status).alias("valid"))


@query("p14_topic_search", "select p_partkey, p_name from part where contains(lower(p_name), '7') or contains(lower(p_type), 'e')")
def _(s, d):
    part = v.table(s, d, "part")
    return events.topic_entries(part, "7", "p_name").unionByName(events.topic_entries(part, "E", "p_type")).select("p_partkey", "p_name").distinct()


# -- joins, splits ----------------------------------------------------------------------

_SIGN = "select vec_id, label % 3 split, list_reduce(list_transform(list_slice(embedding, 1, 62), lambda e: case when e > 0 then 1::bigint else 0::bigint end), lambda a, b: (a << 1) | b) h from embeddings"


def _signs(s, d):
    bits = F.aggregate(F.slice("embedding", 1, 62), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))
    return v.vectors(s, d).select("vec_id", (F.col("label") % 3).alias("split"), bits.alias("ahash"))


@query("j4_near_images", f"with x as ({_SIGN}) select least(a.vec_id, b.vec_id) a, greatest(a.vec_id, b.vec_id) b, cast(bit_count(xor(a.h, b.h)) as int) distance from x a join x b on a.vec_id < b.vec_id and a.split <> b.split where bit_count(xor(a.h, b.h)) <= 15")
def _(s, d):
    return splits.near_images(_signs(s, d), 15, key="vec_id")


@query("j5_nearest_record", "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), j as (select n.vec_id new_id, r.vec_id record_id, list_cosine_similarity(n.v, r.v) c from e n join e r on n.label = r.label and n.vec_id <> r.vec_id where n.vec_id % 20 = 0), k as (select *, row_number() over (partition by new_id order by c desc, record_id desc) rn from j where c >= 0.2) select new_id, record_id from k where rn = 1")
def _(s, d):
    e = v.vectors(s, d).select("vec_id", "label", "embedding", F.lit("confirmed").alias("status"), F.lit("recall").alias("expected"), F.lit("no_recall").alias("observed"))
    return events.nearest_record(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "new_id"), e.withColumnRenamed("vec_id", "record_id"), 0.2, others=True).select("new_id", "record_id")


@query("j6_nearest", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings), j as (select q.vec_id query_id, a.vec_id atlas_id, list_distance(q.v, a.v) x from e q join e a on q.vec_id <> a.vec_id where q.vec_id % 20 = 0), k as (select *, row_number() over (partition by query_id order by round(x, 4), atlas_id) rn from j) select query_id, atlas_id, cast(rn as int) rank from k where rn <= 5")
def _(s, d):
    e = v.vectors(s, d)
    return splits.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("atlas_id"), "embedding"), others=True)


@query("j1_split_join", "with s as (select c_custkey pid, case when c_custkey % 5 = 0 then 'test' else 'train' end split from customer where c_custkey % 3 <> 0) select coalesce(split, 'unassigned') split, count(*) n from orders left join s on o_custkey = pid group by 1")
def _(s, d):
    a = v.table(s, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return splits.with_split(v.table(s, d, "orders").select(F.col("o_custkey").alias("pid")), a).groupBy("split").agg(F.count("*").alias("n"))


@query("j1_leaking_patients", "select user_id pid, string_agg(distinct sp, ',' order by sp) splits from (select user_id, case when user_id % 7 = 0 and event_id % 2 = 0 then 'test' when user_id % 11 = 0 then 'unassigned' else 'train' end sp from events) group by 1 having count(distinct sp) > 1 or bool_or(sp = 'unassigned')")
def _(s, d):
    e = v.table(s, d, "events").select(F.col("user_id").alias("pid"), F.when((F.col("user_id") % 7 == 0) & (F.col("event_id") % 2 == 0), "test").when(F.col("user_id") % 11 == 0, "unassigned").otherwise("train").alias("split"))
    return splits.leaking_patients(e).select("pid", F.array_join("splits", ",").alias("splits"))


@query(
    "r2_splits",
    """with p as (select c_custkey pid, c_nationkey site, row_number() over (partition by c_nationkey order by md5(cast(c_custkey as varchar)), c_custkey) rn, count(*) over (partition by c_nationkey) n from customer),
e as (select *, n * 0.7e0 a, n * 0.15e0 b, n * 0.15e0 c from p), f as (select *, floor(a) fa, floor(b) fb, floor(c) fc, a - floor(a) ra, b - floor(b) rb, c - floor(c) rc, n - floor(a) - floor(b) - floor(c) rest from e),
g as (select *, fa + case when (rb > ra)::int + (rc > ra)::int < rest then 1 else 0 end ka, fb + case when (ra >= rb)::int + (rc > rb)::int < rest then 1 else 0 end kb from f)
select pid, site, case when rn <= n - ka - kb then 'test' when rn <= n - kb then 'train' else 'val' end split from g""",
)
def _(s, d):
    p = v.table(s, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("site"))
    return splits.hash_splits(p, {"train": 0.7, "val": 0.15, "test": 0.15})


@query("w7_holdout", "select doc_id, (row_number() over (order by doc_id) - 1) % 3 = 2 holdout from documents")
def _(s, d):
    return splits.interleaved(v.table(s, d, "documents").select("doc_id"), "doc_id")


@query("j8_paired", f"with {CASES} select case_id, pid, y, cand, champ from cases")
def _(s, d):
    c = v.cases(s, d)
    return sequential.paired(c.select("case_id", "pid", "y", F.col("cand").alias("score")), c.select(F.col("champ").alias("score"), "case_id"), keep=("pid", "y"))


@query("j9_labelled", "select d.doc_id, quality, n_chars from documents d join labels using (doc_id)")
def _(s, d):
    return learners.labelled(v.table(s, d, "documents"), v.table(s, d, "labels"), "doc_id", "quality").select("doc_id", "quality", "n_chars")


# -- event stores ---------------------------------------------------------------------------

_CHAIN = f"with recursive {LEDGER}, n as (select *, row_number() over (partition by conv_id order by turn) k from ledger), c as (select conv_id, turn, k, repeat('0', 64) prev_sha, sha256(body || '|' || repeat('0', 64)) entry_sha from n where k = 1 union all select n.conv_id, n.turn, n.k, c.entry_sha, sha256(n.body || '|' || c.entry_sha) from c join n on n.conv_id = c.conv_id and n.k = c.k + 1)"


@query("h2_chain", f"{_CHAIN} select conv_id, turn, prev_sha, entry_sha from c")
def _(s, d):
    return events.chain(v.ledger(s, d), "conv_id", "turn", "body").select("conv_id", "turn", "prev_sha", "entry_sha")


@query("h3_verify_chain", f"{_CHAIN} select conv_id, count(*) entries, max_by(entry_sha, turn) head, conv_id % 5 <> 0 or count(*) < 2 intact from c group by 1")
def _(s, d):
    c = events.chain(v.ledger(s, d), "conv_id", "turn", "body")
    # the second entry of every fifth chain has been edited
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("k", first).withColumn("body", F.when((F.col("conv_id") % 5 == 0) & (F.col("k") == 2), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return events.verify_chain(c, "conv_id", "turn", "body")


@query("h4_content_ids", "select doc_id, substr(sha256(text), 1, 12) id from documents")
def _(s, d):
    return v.table(s, d, "documents").select("doc_id", expr.short_id(F.col("text")).alias("id"))


@query("h1_canonical_json", """select event_id, '{"kind": "' || event_type || '", "n": ' || event_id || ', "user": ' || user_id || '}' body from events""")
def _(s, d):
    from quillon.functions.canonical import canonical

    return v.table(s, d, "events").select("event_id", canonical(F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("n"), F.col("event_type").alias("kind")))).alias("body"))


@query("h5_memo_lookup", "with k as (select o_custkey c, o_orderkey k, sha256('detect' || '|' || 'v1' || '|' || cast(o_custkey as varchar)) key, o_orderstatus r from orders), m as (select key, r, row_number() over (partition by key order by k desc) rn from k where k % 3 = 0) select k.k o_orderkey, m.r result, m.r is not null hit from k left join m on k.key = m.key and rn = 1")
def _(s, d):
    o = v.table(s, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("result"), events.memo_key(F.lit("detect"), F.lit("v1"), F.col("o_custkey").cast("string"), F.lit("cross")).alias("key"))
    return events.memo_lookup(o.select("o_orderkey", "key"), events.memo_load(o.where("seq % 3 = 0"))).select("o_orderkey", "result", "hit")


_TOOL = "case event_type when 'view' then 'measure' when 'click' then 'segment' when 'purchase' then 'run_detector' when 'error' then 'crop_region' else 'list_reports' end"


@query(
    "h5_nested_keys",
    f"""with c as (select event_id, {_TOOL} tool, event_id * 7 % (select 2 * max(doc_id) from documents) a, user_id b, event_id % 8 / 8e0 part, cast(floor(value * 100) as bigint) cents, user_id % 5 run from events),
h as (select doc_id, sha256(text) sha from documents)
select event_id, case when tool in ('measure', 'run_detector') then 'cross:' when tool in ('segment', 'crop_region') then 'inrun:' || run || ':' end || sha256('{{"kwargs":{{"boxes":[[0.123456789012,' || cents || '],{{"of":[{{"__artifact_sha256__":"' || y.sha || '"}},' || part || ']}}],"image":{{"__artifact_sha256__":"' || x.sha || '"}},"note":"no art:1"}},"tool":"' || tool || '","version":"' || case tool when 'measure' then 'v2' else '' end || '"}}') key
from c left join h x on x.doc_id = a left join h y on y.doc_id = b""",
)
def _(s, d):
    docs = v.table(s, d, "documents").select(F.concat(F.lit("art:"), F.col("doc_id").cast("string")).alias("handle"), F.sha2("text", 256).alias("sha256"), "doc_id")
    most = docs.agg(F.max("doc_id").alias("_m"))
    e, handle = v.table(s, d, "events").crossJoin(F.broadcast(most)), lambda c: F.concat(F.lit("art:"), c.cast("string"))
    of = F.concat(F.lit('{"of": ["'), handle(F.col("user_id")), F.lit('", '), (F.col("event_id") % 8 / 8.0).cast("string"), F.lit("]}"))
    text = F.concat(F.lit('{"note": "no art:1", "image": "'), handle(F.col("event_id") * 7 % (2 * F.col("_m"))), F.lit('", "boxes": [[0.12345678901234, '), F.floor(F.col("value") * 100).cast("string"), F.lit("], "), of, F.lit("]}"))
    return memo.call_keys(e.select("event_id", F.expr(_TOOL).alias("tool"), text.alias("arguments"), (F.col("user_id") % 5).alias("run")), docs, {"measure": "v2"}).select("event_id", "key")


@query("k5_memo_store", "with m as (select o_custkey % 500 k, o_orderkey seq, o_orderstatus result, octet_length(encode('cross:' || (o_custkey % 500))) + octet_length(encode(o_orderstatus)) bytes from orders), l as (select *, row_number() over (partition by k order by seq desc) rn from m), r as (select *, sum(bytes) over (order by seq desc) t, max(seq) over () newest from l where rn = 1) select 'cross:' || k key, seq, result from r where t <= 2000 or seq = newest")
def _(s, d):
    o = v.table(s, d, "orders").select(F.concat(F.lit("cross:"), (F.col("o_custkey") % 500).cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("result"))
    store = memo.Memo(Snapshots(s, f"{shared_dir(s)}/memo-{uuid.uuid4().hex}"), cap=2000)
    for k in range(3):  # three writers' parts, in no order
        store.put(o.where(F.col("seq") % 3 == (k + 1) % 3))
    store.compact()
    return store.load().select("key", "seq", "result")


@query("w9_memo_compact", "with m as (select o_custkey key, max(o_orderkey) seq, max_by(cast(floor(o_totalprice) as bigint), o_orderkey) bytes from orders group by 1), r as (select *, sum(bytes) over (order by seq desc) t, max(seq) over () newest from m) select key, seq, bytes from r where t <= 5000000 or seq = newest")
def _(s, d):
    log = v.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("bytes"))
    return events.memo_compact(events.memo_load(log), 5_000_000).select("key", "seq", "bytes")


@query("x17_bank_state", f"with {BANK} select record_id, max_by(case kind when 'add' then 'probation' when 'confirm' then 'confirmed' else 'retired' end, seq) filter (kind <> 'merge') status, count(*) filter (kind = 'merge') + 1 cluster_size from bank group by 1 having count(*) filter (kind = 'add') > 0")
def _(s, d):
    return events.bank_state(v.bank_events(s, d))


@query("x17_add_records")
def _(s, d):
    e = v.vectors(s, d).select(F.col("vec_id").alias("seq"), F.sha2(F.col("vec_id").cast("string"), 256).alias("record_id"), "label", F.lit("recall").alias("expected"), F.lit("no_recall").alias("observed"), "embedding")
    return events.add_records(e, 0.3)


@query("x26_replay", f"with {BANK}, st as (select record_id, max_by(case kind when 'add' then 'probation' when 'confirm' then 'confirmed' else 'retired' end, seq) filter (kind <> 'merge') status from bank group by 1 having count(*) filter (kind = 'add') > 0) select 'p9' policy_id, record_id, status, coalesce(case when o_custkey % 2 = 0 then 'recall' else 'no_recall' end = 'recall', false) passed from st left join orders on o_orderkey = record_id where status <> 'retired'")
def _(s, d):
    r = events.bank_state(v.bank_events(s, d)).withColumn("case_ref", F.col("record_id")).withColumn("expected", F.lit("recall"))
    dec = v.table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 2 == 0, "recall").otherwise("no_recall").alias("decision"))
    return events.replay(r, dec, "p9")


_LINE = "reg as (select o_orderkey id, case when o_orderkey >= 10 then o_orderkey // 2 end parent from orders)"


@query("x18_lineage", f"with recursive {_LINE}, up as (select id, parent, 0 depth from reg where id = 1500 union all select r.id, r.parent, depth + 1 from reg r join up on r.id = up.parent) select id policy_id, depth from up")
def _(s, d):
    return events.lineage(v.registrations(s, d), 1500)


@query("x18_champion", "select max_by(o_custkey, o_orderkey) policy_id from orders where o_orderstatus in ('F', 'O')")
def _(s, d):
    kind = F.when(F.col("o_orderstatus") == "F", "promote").when(F.col("o_orderstatus") == "O", "rollback").otherwise("register")
    return events.champion(v.table(s, d, "orders").select(kind.alias("kind"), F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("seq")))


@query("j14_held_title", "select c_custkey policy_id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus in ('F', 'O'))")
def _(s, d):
    kind = F.when(F.col("o_orderstatus") == "F", "promote").when(F.col("o_orderstatus") == "O", "rollback").otherwise("register")
    return events.held_title(v.table(s, d, "orders").select(kind.alias("kind"), F.col("o_custkey").alias("policy_id")), v.table(s, d, "customer").select(F.col("c_custkey").alias("policy_id")))


@query("x18_promotion_refusals", "select o_orderkey policy_id, case when o_orderkey % 5 = 0 then 'unknown policy' when o_orderkey % 7 = 0 then 'gate did not pass' when o_orderkey % 11 = 0 then 'no gate summary' when o_orderkey % 13 = 0 then 'summary reports a failure' end reason from orders")
def _(s, d):
    k = F.col("o_orderkey")
    summary = F.when(k % 11 == 0, " ").when(k % 13 == 0, "[FAIL] x\nGATE: FAIL").otherwise("GATE: PASS")
    p = v.table(s, d, "orders").select(k.alias("policy_id"), (k % 5 != 0).alias("registered"), (k % 7 != 0).alias("gate_passed"), summary.alias("gate_summary"))
    return events.promotion_refusals(p).select("policy_id", "reason")


@query("x18_rollback_refusals", "select c_custkey policy_id, case when c_custkey % 5 = 0 then 'unknown policy' when c_custkey % 7 = 0 then 'no reason given' when not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'never champion' end reason from customer")
def _(s, d):
    k = F.col("c_custkey")
    e = v.table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "promote").otherwise("register").alias("kind"), F.col("o_custkey").alias("policy_id"))
    t = v.table(s, d, "customer").select(k.alias("policy_id"), (k % 5 != 0).alias("registered"), F.when(k % 7 != 0, "worse on site b").alias("note"))
    return events.rollback_refusals(t, e).select("policy_id", "reason")


@query("p15_listing", f"with {BANK}, st as (select record_id, max_by(case kind when 'add' then 'probation' when 'confirm' then 'confirmed' else 'retired' end, seq) filter (kind <> 'merge') status from bank group by 1) select record_id, status from st where status = 'confirmed'")
def _(s, d):
    return events.bank_state(v.bank_events(s, d)).where("status = 'confirmed'").select("record_id", "status").orderBy("record_id")


@query("u1_set_operations", "select 'unknown' kind, source name from (select distinct source from documents except select 'src' || label from embeddings) union all select 'seen', source from (select distinct source from documents intersect select 'src' || label from embeddings)")
def _(s, d):
    a, b = v.table(s, d, "documents").select("source"), v.vectors(s, d).select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"))
    return a.subtract(b).select(F.lit("unknown").alias("kind"), F.col("source").alias("name")).unionByName(a.intersect(b).select(F.lit("seen").alias("kind"), F.col("source").alias("name")))


@query("j10_content_addressed_calls", "select e.event_id, sha256('embed' || '|' || coalesce(sha256(d.text), 'absent')) key from events e left join documents d on d.doc_id = e.user_id")
def _(s, d):
    handles = v.table(s, d, "documents").select(F.col("doc_id").alias("user_id"), F.sha2("text", 256).alias("sha"))
    e = v.table(s, d, "events").select("event_id", "user_id").join(handles, "user_id", "left")
    return e.select("event_id", F.sha2(F.concat_ws("|", F.lit("embed"), F.coalesce("sha", F.lit("absent"))), 256).alias("key"))


_CALL = "case event_type when 'click' then 'retrieve_similar' when 'purchase' then 'submit_review' when 'error' then 'run_eval_gate' else 'lookup_criteria' end"


@query(
    "x20_tool_calls",
    f"""with c as (select event_id call, {_CALL} tool, event_id * 3 % (select 2 * max(vec_id) from embeddings) crop, event_id % 9 policy, user_id % 40 topic from events),
f as (select *, case when tool = 'lookup_criteria' then min(call) over (partition by tool, topic) when tool = 'retrieve_similar' then min(call) over (partition by tool, crop) else call end original,
  case tool when 'retrieve_similar' then crop in (select vec_id from embeddings) when 'run_eval_gate' then policy < 6 else true end fine from c),
k as (select tool, 'tool_call' kind from f union all select tool, case when not fine then 'tool_failure' when original <> call then 'tool_result_cached' else 'tool_result' end from f)
select tool, kind, count(*) n, true intact from k group by all""",
)
def _(s, d):
    """Every event as a tool call of its user's case: how many entries of each kind each tool has, and whether all chains are whole."""
    vectors = v.vectors(s, d).select(F.col("vec_id").alias("id"), "embedding")
    most, e = vectors.agg(F.max("id").alias("_m")), F.col("event_id")
    crop = F.concat(F.lit('{"crop": "'), (e * 3 % (2 * F.col("_m"))).cast("string"), F.lit('"}'))
    policy = F.concat(F.lit('{"policy_id": "p'), (e % 9).cast("string"), F.lit('"}'))
    topic = F.concat(F.lit('{"topic": "'), (F.col("user_id") % 40).cast("string"), F.lit('"}'))
    review = F.concat(F.lit('{"case_id": "'), F.col("user_id").cast("string"), F.lit('"}'))
    calls = v.table(s, d, "events").crossJoin(F.broadcast(most)).select(e.alias("call"), F.col("user_id").alias("case_id"), e.alias("seq"), F.expr(_CALL).alias("tool"), "event_type", crop.alias("crop"), policy.alias("policy"), topic.alias("topic"), review.alias("review"), F.lit("run").alias("run"))
    calls = calls.withColumn("arguments", F.expr("case tool when 'retrieve_similar' then crop when 'run_eval_gate' then policy when 'submit_review' then review else topic end"))
    calls = memo.call_keys(calls, s.createDataFrame([], "handle string, sha256 string"), at_once=True)
    verdicts = v.replays(s, d).groupBy("policy_id").agg(F.every("passed").alias("passed"), F.count("*").cast("string").alias("summary"))
    corpus = v.table(s, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), "n_name").alias("topic"), F.col("n_name").alias("text"))
    index = neighbours.build(vectors.withColumnRenamed("id", "atlas_id"), "atlas_id", pivots=neighbours.balls(vectors.count()))
    tools = {
        "retrieve_similar": toolcalls.retrieve_similar(vectors, index), "lookup_criteria": toolcalls.lookup_criteria(corpus, "v1"),
        "run_eval_gate": toolcalls.run_eval_gate(verdicts), "submit_review": toolcalls.submit_review(),
    }
    entries = events.checked(toolcalls.answer(calls, tools), "case_id", "body")
    counted = entries.groupBy(F.get_json_object("body", "$.tool").alias("tool"), "kind").agg(F.count("*").alias("n"), F.every("ok").alias("ok"))
    # a row for each tool and kind
    return counted.select("tool", "kind", "n", F.every("ok").over(Window.partitionBy()).alias("intact"))


@query("x24_budget", "select o_orderkey case_id, case when o_totalprice > 200000 then 'usd' when o_custkey % 100 > 80 then 'output_tokens' end fallback_reason, case when o_totalprice > 200000 or o_custkey % 100 > 80 then 'no_recall' else 'recall' end decision from orders")
def _(s, d):
    from quillon.operators.adjudicate import enforce_budget

    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("recall").alias("decision"), F.lit("no_recall").alias("rule_decision"), F.col("o_totalprice").alias("usd"), (F.col("o_custkey") % 100).alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    return enforce_budget(o, 200_000.0, 80).select("case_id", "fallback_reason", "decision")


@query(
    "w6_breaker",
    f"""with {CASES}, n as (select site, case_id seq, cand > 0.2e0 wants, ceil(0.25e0 * row_number() over o) - sum((cand > 0.2e0)::int) over o slack from cases window o as (partition by site order by case_id rows between unbounded preceding and current row)),
m as (select *, least(0, min(slack) over (partition by site order by seq rows between unbounded preceding and 1 preceding)) low from n) select site, seq, wants and slack >= coalesce(low, 0) granted from m""",
)
def _(s, d):
    c = v.cases(s, d).select("site", F.col("case_id").alias("seq"), (F.col("cand") > 0.2).alias("wants"))
    return events.admitted(c, 0.25, "site")


_MARK = "case event_type when 'signup' then 'start' when 'error' then 'finish' when 'purchase' then 'llm' else 'tool' end"


@query(
    "x19_case_costs",
    f"""with m as (select user_id case_id, {_MARK} kind, event_id ts, event_type tool, value wall_ms, event_id % 100 pixels, event_id % 3 = 0 cached, event_id % 4 turns, event_id % 50 i, event_id % 20 o, case when event_id % 7 > 0 then event_id % 10 end c, value / 100e0 usd from events),
g as (select case_id, string_agg(tool || '=' || n, ',' order by tool) calls from (select case_id, tool, count(*) n from m where kind = 'tool' group by all) group by 1)
select case_id, coalesce(any_value(calls), '') tool_calls, count(*) filter (kind = 'tool') total_tool_calls, count(*) filter (kind = 'tool' and cached) cached_hits, cast(coalesce(sum(pixels) filter (kind = 'tool'), 0) as bigint) detector_pixels, max(ts) filter (kind = 'finish') - min(ts) filter (kind = 'start') wall_ms,
  round(coalesce(sum(wall_ms) filter (kind = 'tool'), 0), 6) tool_wall_ms, cast(coalesce(sum(turns) filter (kind = 'llm'), 0) as bigint) llm_turns, cast(coalesce(sum(i) filter (kind = 'llm'), 0) as bigint) llm_input_tokens, cast(coalesce(sum(o) filter (kind = 'llm'), 0) as bigint) llm_output_tokens,
  cast(coalesce(sum(c) filter (kind = 'llm'), 0) as bigint) llm_cache_read_tokens, round(coalesce(sum(usd) filter (kind = 'llm'), 0), 6) llm_usd from m left join g using (case_id) group by 1""",
)
def _(s, d):
    e = F.col("event_id")
    m = v.table(s, d, "events").select(
        F.col("user_id").alias("case_id"), F.expr(_MARK).alias("kind"), e.alias("ts"), F.col("event_type").alias("tool"), F.col("value").alias("wall_ms"), (e % 100).alias("pixels"), (e % 3 == 0).alias("cached"), (e % 4).alias("turns"),
        (e % 50).alias("input_tokens"), (e % 20).alias("output_tokens"), F.when(e % 7 > 0, e % 10).alias("cache_read_tokens"), (F.col("value") / 100.0).alias("usd"),
    )
    calls = F.array_join(F.transform(F.map_entries("tool_calls"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return events.case_costs(m).withColumns({"tool_calls": calls, "tool_wall_ms": F.round("tool_wall_ms", 6), "llm_usd": F.round("llm_usd", 6)})


@query(
    "k9_gate_audit",
    """with recursive e as (select o_custkey cust, o_orderkey seq, 'gate_evaluation|' || (o_orderkey % 6) || '|' || case when o_custkey % 3 <> 0 then 'passed' else 'failed' end || '|' || case when o_orderkey % 4 > 0 then cast(o_orderkey % 40 as varchar) else 'none' end || '|' || o_orderstatus body,
  row_number() over (partition by o_custkey order by o_orderkey) i from orders),
c as (select cust, seq, i, body, repeat('0', 64) prev_sha, sha256(body || '|' || repeat('0', 64)) entry_sha from e where i = 1 union all select e.cust, e.seq, e.i, e.body, c.entry_sha, sha256(e.body || '|' || c.entry_sha) from c join e on e.cust = c.cust and e.i = c.i + 1)
select cust, seq, 'gate_evaluation' kind, body, prev_sha, entry_sha from c""",
)
def _(s, d):
    k = F.col("o_orderkey")
    e = v.table(s, d, "orders").select(F.col("o_custkey").alias("cust"), k.alias("seq"), (k % 6).alias("policy_id"), (F.col("o_custkey") % 3 != 0).alias("gate_passed"), F.when(k % 4 > 0, k % 40).alias("e_value"), F.col("o_orderstatus").alias("checks"))
    return events.audit_log(e, "cust", "seq")


# -- learners --------------------------------------------------------------------------------

_LOGIT = "ln((cand + 1e-9) / (1 - cand + 1e-9))"


@query("x11_temperature", f"with {CASES}, g as (select range k, 0.1e0 * pow(100e0, range / 119e0) t from range(120)), p as (select k, t, y, 1 / (1 + exp(-greatest(-30e0, least(30e0, {_LOGIT} / t)))) p from cases cross join g), n as (select k, t, avg(-(y * ln(p + 1e-9) + (1 - y) * ln(1 - p + 1e-9))) nll from p group by all) select round(t, 6) t, round(nll, 8) nll from n order by n.nll, k limit 1")
def _(s, d):
    c = v.cases(s, d).withColumn("logit", F.log((F.col("cand") + 1e-9) / (1 - F.col("cand") + 1e-9)))
    return learners.best_temperature(c).select(F.round("t", 6).alias("t"), F.round("nll", 8).alias("nll"))


@query("x12_prior_shift", f"with {CASES}, p as (select avg(y) a from cases) select round(ln(0.01e0 / (1 - 0.01e0 + 1e-9) + 1e-9) - ln(a / (1 - a + 1e-9) + 1e-9), 9) shift from p")
def _(s, d):
    return v.cases(s, d).agg(F.avg("y").alias("a")).select(r9(learners.prior_shift(F.col("a"), F.lit(0.01))).alias("shift"))


_TREE = {"tree": {"feature": 0, "threshold": 0.35, "left": {"leaf": [0, 9, 1]}, "right": {"feature": 1, "threshold": 0.5, "left": {"leaf": [3, 3, 4]}, "right": {"leaf": [8, 0, 2]}}}}


@query("x15_student_tree", f"with {CASES} select case_id, case when cand <= 0.35e0 then 'no_recall' when champ <= 0.5e0 then 'defer_to_human' else 'recall' end decision, case when cand <= 0.35e0 then 0.9e0 when champ <= 0.5e0 then 0.4e0 else 0.8e0 end confidence from cases")
def _(s, d):
    return learners.Student("tree", ["cand", "champ"], _TREE).predict(v.cases(s, d)).select("case_id", "decision", "confidence")


_LOGIST = {"mean": [0.2, 0.4], "std": [0.1, 0.2], "weights": [[1.5, 0.5, -1.0], [-1.0, -0.5, 0.5], [0.2, 0.1, 0.0]]}


@query(
    "x15_student_logistic",
    f"""with {CASES}, z as (select case_id, (cand - 0.2e0) / 0.1e0 a, (champ - 0.4e0) / 0.2e0 b from cases),
p as (select case_id, 1 / (1 + exp(-greatest(-30e0, least(30e0, -1e0 + a * 1.5e0 + b * 0.5e0)))) r, 1 / (1 + exp(-greatest(-30e0, least(30e0, 0.5e0 - a - b * 0.5e0)))) n, 1 / (1 + exp(-greatest(-30e0, least(30e0, a * 0.2e0 + b * 0.1e0)))) d from z)
select case_id, case when r >= n and r >= d then 'recall' when n >= d then 'no_recall' else 'defer_to_human' end decision, round(greatest(r, n, d) / (r + n + d), 7) confidence from p""",
)
def _(s, d):
    return learners.Student("logistic", ["cand", "champ"], _LOGIST).predict(v.cases(s, d)).select("case_id", "decision", F.round("confidence", 7).alias("confidence"))


@query("x25_disagreements", f"with {CASES}, p as (select case_id, case when cand <= 0.35e0 then 'no_recall' when champ <= 0.5e0 then 'defer_to_human' else 'recall' end o, case when cand <= 0.35e0 then 0.9e0 when champ <= 0.5e0 then 0.4e0 else 0.8e0 end c, y from cases) select case_id, case when y = 1 then 'recall' else 'no_recall' end expected, o observed from p where c >= 0.75e0 and o <> case when y = 1 then 'recall' else 'no_recall' end and case_id % 2 = 0")
def _(s, d):
    c = v.cases(s, d)
    truth = c.where("case_id % 2 = 0").select("case_id", F.when(F.col("y") == 1, "recall").otherwise("no_recall").alias("truth"))
    return learners.disagreements(learners.Student("tree", ["cand", "champ"], _TREE).predict(c).select("case_id", "decision", "confidence"), truth, 0.75)


@query("x10_fit_head")
def _(s, d):
    h = learners.fit_head(v.cases(s, d), ["cand", "champ"])
    return s.createDataFrame([(k, float(w)) for k, w in enumerate([*h.weights, h.bias])], "k int, weight double")


def _labelled(s, d):
    """Cases with the decision that fixed thresholds of their score give."""
    return v.cases(s, d).select("case_id", "cand", "champ", F.when(F.col("cand") > 0.65, "recall").when(F.col("cand") < 0.35, "no_recall").otherwise("defer_to_human").alias("decision"))


@query("x13_fit_logistic")
def _(s, d):
    p = learners.fit_logistic(_labelled(s, d), ["cand", "champ"]).params
    return s.createDataFrame([(c, k, float(w)) for c, row in zip(learners.CLASSES, p["weights"], strict=True) for k, w in enumerate(row)], "class string, k int, weight double")


@query("x14_fit_tree", f"with {CASES} select case_id, case when cand > 0.65e0 then 'recall' when cand < 0.35e0 then 'no_recall' else 'defer_to_human' end decision from cases where cand < 0.34e0 or cand between 0.36e0 and 0.64e0 or cand > 0.66e0")
def _(s, d):
    """Away from its thresholds, a tree fitted to a rule of two thresholds decides as the rule does."""
    c = _labelled(s, d)
    tree = learners.fit_tree(c, ["cand", "champ"])
    return tree.predict(c.drop("decision")).where("cand < 0.34 or cand between 0.36 and 0.64 or cand > 0.66").select("case_id", "decision")


# -- images: tested against plain numpy where SQL can't say it -------------------------------------------------


def _images(s, d):
    """An image for each vector."""
    return grids(v.vectors(s, d), "vec_id", "embedding")


@query("s13_phantom")
def _(s, d):
    """A drawn case for each supplier, its stream and label by the supplier's key."""
    from quillon.sources.phantom import generate

    drawn = generate(s, patients=v.table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), images=1, prevalence=0.5, size=96)
    return drawn.select("case_id", "patient_id", "site", "label", F.size("pixels").alias("n_pixels"))


@query("x2_detect")
def _(s, d):
    from quillon.operators.kernels import detect

    return detect(_images(s, d))


@query("x3_reads")
def _(s, d):
    from quillon.operators.kernels import reads

    return reads(_images(s, d))


@query("x5_segments")
def _(s, d):
    from quillon.operators.kernels import detect, segments

    return segments(_images(s, d), detect(_images(s, d)))


@query("x9_embeddings")
def _(s, d):
    from quillon.operators.kernels import embeddings

    return embeddings(_images(s, d)).select("case_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("x6_measurements")
def _(s, d):
    from quillon.operators.kernels import detect, measurements

    return measurements(_images(s, d), detect(_images(s, d)))


def _earlier(im):
    """Each image moved by four rows and three columns."""
    from quillon.operators.kernels import moved

    return moved(im, -4, -3)


@query("x7_registrations")
def _(s, d):
    from quillon.operators.kernels import registrations

    return registrations(_images(s, d), _earlier(_images(s, d)))


@query("x8_comparisons")
def _(s, d):
    from quillon.operators.kernels import comparisons

    im = _images(s, d)
    return comparisons(im, _earlier(im), im.select("case_id", F.lit(20).alias("x0"), F.lit(20).alias("y0"), F.lit(60).alias("x1"), F.lit(60).alias("y1")))


@query(
    "h7_average_hash",
    """with x as (select vec_id, list_transform(embedding, lambda e: least(1e0, greatest(0e0, 0.5e0 + 1.5e0 * e::double))::float::double) p from embeddings where len(embedding) = 64),
b as (select vec_id, list_transform(p, lambda e: (e > (list_sort(p)[32] + list_sort(p)[33]) / 2)::int::bigint) b from x),
h as (select vec_id, list_reduce(list_slice(b, 1, 32), lambda a, c: a * 2 + c) hi, list_reduce(list_slice(b, 33, 64), lambda a, c: a * 2 + c) lo from b)
select vec_id case_id, (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo ahash from h""",
)
def _(s, d):
    from quillon.operators.kernels import hashes

    return hashes(_images(s, d))


@query("x22_image_pipeline")
def _(s, d):
    from quillon.operators import kernels as k

    im = _images(s, d)
    base, second, read = (written(x, "detected") for x in (k.detect(im), k.detect(im, "blindspot"), k.reads(im)))
    qc = im.select("case_id", cand.quality_verdict(F.col("pixels")).alias("qc"))
    return case_path.run_cases(qc, base, read, second, crops=k.zoom_reads(im, base), segments=k.segments(im, base))

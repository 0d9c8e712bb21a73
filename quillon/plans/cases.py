"""Views of the driver's tables as cases, candidates, events and records: fixtures of operators, without clinical meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / (F.col("value") + 100.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("case_id"), F.col("user_id").alias("pid"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
        (F.col("user_id") % 4).cast("string").alias("site"), (F.col("event_id") % 3).cast("string").alias("density"), v.alias("cand"),
        (0.5 * v + 0.5 * ((F.col("event_id") * 7919) % 1000 / 1000.0)).alias("champ"), (v + F.when(F.col("event_id") % 100 == 0, 0.001).otherwise(0.0)).alias("rerun"),
    )


CASES = """cases as (select event_id case_id, user_id pid, case when event_type = 'error' then 1 else 0 end y, cast(user_id % 4 as varchar) site, cast(event_id % 3 as varchar) density,
  value / (value + 100e0) cand, 0.5e0 * (value / (value + 100e0)) + 0.5e0 * ((event_id * 7919) % 1000 / 1000e0) champ,
  value / (value + 100e0) + case when event_id % 100 = 0 then 0.001e0 else 0e0 end rerun from events)"""


def _boxes(spark: SparkSession, sf_dir: str, kinds: list[str], a: int, b: int) -> DataFrame:
    e = F.col("event_id")
    x0, y0 = e * a % 200, e * b % 200
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(kinds)).select(
        F.col("user_id").alias("case_id"), e.alias("event_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + e % 30).alias("x1"), (y0 + 20 + e % 17).alias("y1"), (F.col("value") / (F.col("value") + 100.0)).alias("score"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, ["view", "click"], 37, 53).withColumnRenamed("event_id", "candidate_id")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, ["purchase", "error"], 41, 59).withColumn("read_id", F.col("event_id") % 5)


def blindspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, ["signup"], 43, 61)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(u.alias("case_id")).distinct().withColumn("qc", F.when(F.col("case_id") % 10 == 0, "inadequate_defer").when(F.col("case_id") % 10 == 1, "degraded").otherwise("adequate"))


def _sql_boxes(name: str, kinds: str, a: int, b: int, own: str) -> str:
    return f"""{name} as (select user_id case_id, event_id {own}, event_id * {a} % 200 x0, event_id * {b} % 200 y0, event_id * {a} % 200 + 20 + event_id % 30 x1, event_id * {b} % 200 + 20 + event_id % 17 y1,
  value / (value + 100e0) score from events where event_type in ({kinds}))"""


def sql_iou(a: str, b: str) -> str:
    common = f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    return f"({common}) / cast(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - {common} as double)"


BOXES = ",\n".join(
    [
        _sql_boxes("candidates", "'view', 'click'", 37, 53, "candidate_id"), _sql_boxes("reads", "'purchase', 'error'", 41, 59, "event_id, event_id % 5 read_id"), _sql_boxes("blindspots", "'signup'", 43, 61, "event_id"),
        "patients as (select distinct user_id case_id, case when user_id % 10 = 0 then 'inadequate_defer' when user_id % 10 = 1 then 'degraded' else 'adequate' end qc from events)",
    ]
)
KEPT = f"""hits as (select c.case_id, c.candidate_id, count(distinct r.read_id) k from candidates c join reads r on c.case_id = r.case_id where {sql_iou("c", "r")} >= 0.3e0 group by all),
kept as (select c.*, coalesce(k, 0) reproduced, coalesce(k, 0) / 5e0 reproduced_fraction, coalesce(k, 0) >= 2 kept from candidates c left join hits using (case_id, candidate_id))"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit("|"), F.coalesce("text", F.lit(""))).alias("body"))


LEDGER = "ledger as (select conv_id, turn, role || '|' || coalesce(text, '') body from conversations)"


def bank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    kind = F.when(t == 0, "add").when(t % 3 == 1, "merge").when(t % 3 == 2, "confirm").otherwise("retire")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), t.alias("seq"), kind.alias("kind"), F.lit("probation").alias("status"))


BANK = "bank as (select conv_id record_id, turn seq, case when turn = 0 then 'add' when turn % 3 = 1 then 'merge' when turn % 3 = 2 then 'confirm' else 'retire' end kind from conversations)"


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a result of one of six policies on a record; record ids have three digits or more, none cut."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), (F.col("o_orderkey") % 6).cast("string")).alias("policy_id"), (F.col("o_orderkey") % 6).alias("ts"), F.format_string("r%03d", F.floor(F.col("o_orderkey") / 6)).alias("record_id"),
        F.when(F.floor(F.col("o_orderkey") / 6) % 4 == 0, "probation").otherwise("confirmed").alias("status"), (F.col("o_custkey") % 3 != 0).alias("passed"),
    )


REPLAYS = """replays as (select 'p' || (o_orderkey % 6) policy_id, o_orderkey % 6 ts, printf('r%03d', o_orderkey // 6) record_id, case when (o_orderkey // 6) % 4 = 0 then 'probation' else 'confirmed' end status,
  o_custkey % 3 <> 0 passed from orders)"""


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit("register").alias("kind"), k.alias("policy_id"), F.when(k >= 10, F.floor(k / 2)).alias("parent_id"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 4 == 0, "").when(k % 4 == 1, "routine").when(k % 4 == 2, "hard").otherwise("fast_negative").alias("lane"), F.when(k % 5 != 0, F.col("o_custkey") % 7).alias("tool_calls"),
        F.when(k % 4 != 3, F.col("o_custkey") % 100 * 1.0).alias("wall_ms"), (k % 10 * 1.0).alias("usd"), F.when(k % 2 == 0, "cand").otherwise("champ").alias("arm"),
    )


REPORTS = """reports as (select case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then 'routine' when o_orderkey % 4 = 2 then 'hard' else 'fast_negative' end lane, case when o_orderkey % 5 <> 0 then o_custkey % 7 end tool_calls,
  case when o_orderkey % 4 <> 3 then o_custkey % 100 * 1e0 end wall_ms, o_orderkey % 10 * 1e0 usd, case when o_orderkey % 2 = 0 then 'cand' else 'champ' end arm from orders)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")

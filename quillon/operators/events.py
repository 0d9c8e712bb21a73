"""Event-sourced tables: hash chains, the failure bank, policies, memoised results, costs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quillon.functions.canonical import dumps
from quillon.operators.leaders import TYPE
from quillon.operators.leaders import add_records as add_records
from quillon.operators.neighbours import most_alike

GENESIS = "0" * 64


def chain(events: DataFrame, key: str, seq: str, body: str, start: str | None = None, laid: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """events with prev_sha and entry_sha: each entry's hash covers its body and the hash before it, within its chain.

    A chain is folded in its order as its rows stream by, chains in parallel; a task holds one batch of rows and one
    hash, so long chains cost time in proportion and no more memory. seq should be unique within a chain: entries that
    tie come in order of their bodies. A null body counts as empty, rows with a null key are one chain, and columns
    named prev_sha or entry_sha are replaced. start names a column with the hash that a chain goes on from, one for all its rows.
    With laid nothing is moved: batches go through it first, and then each chain must lie in one piece in one partition, in its order.
    """
    events = events.drop("prev_sha", "entry_sha")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = object(), GENESIS
        for batch in laid(batches) if laid else batches:
            before, after = [], []
            begins = batch.column(start).to_pylist() if start else [GENESIS] * batch.num_rows
            for k, text, begin in zip(batch.column(key).to_pylist(), batch.column(body).to_pylist(), begins, strict=True):
                if k != of:
                    of, sha = k, begin
                before.append(sha)
                sha = hashlib.sha256(f"{text or ''}|{sha}".encode()).hexdigest()
                after.append(sha)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "prev_sha", "entry_sha"])

    out_type = StructType([*events.schema.fields, StructField("prev_sha", StringType()), StructField("entry_sha", StringType())])
    events = events if laid else events.repartition(key).sortWithinPartitions(key, seq, body)
    return events.mapInArrow(over, out_type)


def verify_chain(entries: DataFrame, key: str, seq: str, body: str) -> DataFrame:
    """(key, entries, head, intact): every link and every hash is checked in parallel.

    head and the count anchor the tail: a chain cut short stays intact but has another head. A null body counts as
    empty; a missing hash breaks its chain.
    """
    w = Window.partitionBy(key).orderBy(seq, body)
    linked = F.lag("entry_sha", 1, GENESIS).over(w).eqNullSafe(F.col("prev_sha"))
    hashed = F.sha2(F.concat(F.coalesce(body, F.lit("")), F.lit("|"), F.col("prev_sha")), 256).eqNullSafe(F.col("entry_sha"))
    e = entries.withColumn("_ok", linked & hashed & F.col("entry_sha").isNotNull())
    return e.groupBy(key).agg(F.count("*").alias("entries"), F.max_by("entry_sha", seq).alias("head"), F.every("_ok").alias("intact"))


def checked(entries: DataFrame, key: str, body: str) -> DataFrame:
    """entries as chain() gives them, with ok: do an entry's link and hash hold? Nothing is moved: rows are checked as they stream by.

    A chain that does not lie in one piece and in its order is not ok where a piece begins. For tables that were stored, and may
    lie in any order, use verify_chain.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = object(), GENESIS
        for batch in batches:
            ok = []
            for k, text, before, after in zip(*(batch.column(c).to_pylist() for c in (key, body, "prev_sha", "entry_sha")), strict=True):
                if k != of:
                    of, sha = k, GENESIS
                ok.append(before == sha and after == hashlib.sha256(f"{text or ''}|{sha}".encode()).hexdigest())
                sha = after
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=[*batch.schema.names, "ok"])

    return entries.mapInArrow(over, StructType([*entries.schema.fields, StructField("ok", BooleanType())]))


class Ledger:
    """A single-writer ledger of canonical JSON lines on the driver."""

    def __init__(self, entries: list[dict] | None = None) -> None:
        self.entries: list[dict] = list(entries or [])

    def append(self, kind: str, payload: dict, ts: str) -> str:
        body = {"ts": ts, "kind": kind, "payload": payload, "prev_sha": self.entries[-1]["entry_sha"] if self.entries else GENESIS}
        sha = hashlib.sha256(dumps(body).encode()).hexdigest()
        self.entries.append(body | {"entry_sha": sha})
        return sha

    def verify(self) -> bool:
        before = GENESIS
        for e in self.entries:
            body = {k: v for k, v in e.items() if k != "entry_sha"}
            if e["prev_sha"] != before or hashlib.sha256(dumps(body).encode()).hexdigest() != e["entry_sha"]:
                return False
            before = e["entry_sha"]
        return True


# -- the failure bank ---------------------------------------------------------


def bank_state(events: DataFrame) -> DataFrame:
    """(record_id, status, cluster_size) from add, merge, confirm and retire events: the last status stands, merges count."""
    status = F.when(F.col("kind") == "add", F.col("status")).when(F.col("kind") == "confirm", "confirmed").when(F.col("kind") == "retire", "retired")
    e = events.withColumn("_s", status)
    g = e.groupBy("record_id").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("seq"))).alias("status"), (F.count_if(F.col("kind") == "merge") + 1).alias("cluster_size"), F.count_if(F.col("kind") == "add").alias("_a"))
    return g.where("_a > 0").drop("_a")


def valid_record(label: Column, expected: Column, observed: Column, source: Column, status: Column) -> Column:
    """May a record enter the bank? The outcome must miss what was expected, the label be 0 or 1, and what an evaluation missed not be confirmed. Nulls may not."""
    return F.coalesce((observed != expected) & label.isin(0, 1) & ~((source == "eval_miss") & (status == "confirmed")), F.lit(False))


def topic_entries(corpus: DataFrame, topic: str, *columns: str) -> DataFrame:
    """The entries whose topic holds a text, in any case; of several columns one is enough. Null topics hold none, the empty text is in all others."""
    hits = [F.coalesce(F.contains(F.lower(c), F.lower(F.lit(topic))), F.lit(False)) for c in columns or ("topic",)]
    return corpus.where(reduce(lambda a, b: a | b, hits))


def nearest_record(new: DataFrame, records: DataFrame, least: float = 0.85, others: bool = False) -> DataFrame:
    """(new_id, record_id, cos): the most similar active record of the same type; equal ones give the largest id. With others, never itself."""
    return most_alike(new, records.where("status != 'retired'"), TYPE, least, others)


def replay(records: DataFrame, decisions: DataFrame, policy_id: str) -> DataFrame:
    """(policy_id, record_id, status, passed) of every active record against a policy's decisions."""
    j = records.where("status != 'retired'").join(decisions, records["case_ref"] == decisions["case_id"], "left")
    return j.select(F.lit(policy_id).alias("policy_id"), "record_id", "status", F.coalesce(F.col("decision") == F.col("expected"), F.lit(False)).alias("passed"))


def pass_rate(results: DataFrame) -> DataFrame:
    """Of confirmed records; 1 without any."""
    return results.where("status = 'confirmed'").agg(F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(1.0)).alias("pass_rate"))


def regressions(cand: DataFrame, champ: DataFrame) -> DataFrame:
    """(regressions, failed, first5): confirmed records that fail now and passed under the champion; unknown ones don't count."""
    c = cand.where("status = 'confirmed'").select("record_id", "passed")
    j = c.join(champ.select("record_id", F.col("passed").alias("before")), "record_id", "left")
    worse = ~F.col("passed") & F.coalesce("before", F.lit(False))
    return j.agg(F.count_if(worse).alias("regressions"), F.count_if(~F.col("passed")).alias("failed"), F.slice(F.sort_array(F.collect_list(F.when(worse, F.col("record_id")))), 1, 5).alias("first5"))


def transfer_matrix(results: DataFrame, records: list[str]) -> DataFrame:
    """A row for each policy, a column for each of the named records."""
    return results.groupBy("policy_id").pivot("record_id", records).agg(F.bool_or("passed"))


def transfers(results: DataFrame) -> DataFrame:
    """(policy_id, record_id, passed): the transfer matrix of all records, a row for each cell that has a result."""
    return results.groupBy("policy_id", "record_id").agg(F.bool_or("passed").alias("passed"))


def flips(results: DataFrame, order: str = "ts") -> DataFrame:
    """(record_id, policy_id): passes of an earlier policy that a later one lost."""
    before = F.lag("passed").over(Window.partitionBy("record_id").orderBy(order))
    return results.withColumn("_b", before).where("_b and not passed").select("record_id", "policy_id")


# -- policies -----------------------------------------------------------------


def champion(events: DataFrame) -> DataFrame:
    """The policy of the last promotion or rollback; no row without any."""
    return events.where(F.col("kind").isin("promote", "rollback")).agg(F.max_by("policy_id", "seq").alias("policy_id")).where("policy_id is not null")


def held_title(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Those targets that were champion before: the only ones a rollback may return to."""
    return targets.join(events.where(F.col("kind").isin("promote", "rollback")), "policy_id", "left_semi")


def lineage(events: DataFrame, policy_id: str) -> DataFrame:
    """(policy_id, depth): a policy and its ancestors, by a recursive query over registrations."""
    spark = events.sparkSession
    events.where("kind = 'register'").select("policy_id", "parent_id").createOrReplaceTempView("_registered")
    return spark.sql("with recursive up as (select policy_id, parent_id, 0 depth from _registered where policy_id = :id union all select r.policy_id, r.parent_id, depth + 1 from _registered r join up on r.policy_id = up.parent_id) select policy_id, depth from up", args={"id": policy_id})


def promotion_refusals(proposals: DataFrame) -> DataFrame:
    """proposals (policy_id, registered, gate_passed, gate_summary) with reason, null if the promotion may go ahead.

    The summary is read again, so a claim that the gate passed cannot stand against a summary that says it failed.
    """
    summary = F.trim(F.coalesce("gate_summary", F.lit("")))
    reason = (
        F.when(~F.coalesce("registered", F.lit(False)), "unknown policy").when(~F.coalesce("gate_passed", F.lit(False)), "gate did not pass")
        .when(F.length(summary) == 0, "no gate summary").when(F.contains(summary, F.lit("GATE: FAIL")), "summary reports a failure")
    )
    return proposals.withColumn("reason", reason)


def rollback_refusals(targets: DataFrame, events: DataFrame) -> DataFrame:
    """targets (policy_id, registered, note) with reason, null if the rollback may go ahead: it needs a note and a former champion."""
    held = events.where(F.col("kind").isin("promote", "rollback")).select("policy_id").distinct().withColumn("_h", F.lit(True))
    reason = F.when(~F.coalesce("registered", F.lit(False)), "unknown policy").when(F.length(F.trim(F.coalesce("note", F.lit("")))) == 0, "no reason given").when(F.col("_h").isNull(), "never champion")
    return targets.join(held, "policy_id", "left").withColumn("reason", reason).drop("_h")


# -- memoised results ----------------------------------------------------------


def memo_key(tool: Column, version: Column, arguments: Column, scope: Column) -> Column:
    """A result's address: scope, tool, version and canonical arguments."""
    return F.concat(scope, F.lit(":"), F.sha2(F.concat_ws("|", tool, version, arguments), 256))


def memo_load(log: DataFrame) -> DataFrame:
    """The last write of each key, with its place as recency."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return log.withColumn("_r", last).where("_r = 1").drop("_r")


def memo_compact(memo: DataFrame, cap: int) -> DataFrame:
    """The most recent entries whose sizes sum to cap at most; always the newest one."""
    from quillon.plans.prefix import running

    out = running(memo, "seq", {"_sum": F.col("bytes")}, descending=True)
    newest = memo.agg(F.max("seq").alias("_newest"))
    return out.crossJoin(F.broadcast(newest)).where((F.col("_sum") <= cap) | (F.col("seq") == F.col("_newest"))).drop("_sum", "_newest")


def memo_lookup(calls: DataFrame, memo: DataFrame) -> DataFrame:
    """calls with result and hit."""
    return calls.join(memo.select("key", "result"), "key", "left").withColumn("hit", F.col("result").isNotNull())


# -- costs -----------------------------------------------------------------------


def lane_costs(reports: DataFrame, costs: tuple[str, ...] = ("tool_calls", "wall_ms", "usd")) -> DataFrame:
    """(lane, n, mean of each cost): all cases count, means are over those with a cost, 0 if none has one."""
    lane = F.coalesce(F.nullif(F.col("lane"), F.lit("")), F.lit("unrouted"))
    return reports.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in costs))


def tool_calls(events: DataFrame) -> DataFrame:
    """(case_id, calls): a map from tool to its number of calls."""
    g = events.groupBy("case_id", "tool").agg(F.count("*").alias("n"))
    return g.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tool", "n")))).alias("calls"))


#: What a case may have spent on a language model: event columns and the names of their sums.
SPENT = {"turns": "llm_turns", "input_tokens": "llm_input_tokens", "output_tokens": "llm_output_tokens", "cache_read_tokens": "llm_cache_read_tokens", "usd": "llm_usd"}


def case_costs(marks: DataFrame) -> DataFrame:
    """One row for each case: tool calls (all and by tool), memo hits, detector pixels, wall times, language-model spend.

    marks has (case_id, kind, ts, tool, wall_ms, pixels, cached) and the columns of SPENT; kind is start, finish, tool or
    llm. wall_ms is from the first start to the last finish, null unless both are there; ts is in milliseconds. Null
    numbers are 0, a null case_id is the unnamed case, null tools count as "". Sums are partial by tool before a case meets.
    """
    tool, llm = F.col("kind") == "tool", F.col("kind") == "llm"
    number = lambda when, c: F.sum(F.when(when, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    per = marks.groupBy("case_id", F.when(tool, F.coalesce("tool", F.lit(""))).alias("tool")).agg(
        F.count_if(tool).alias("calls"), F.count_if(tool & F.col("cached")).alias("cached_hits"), number(tool, "pixels").alias("detector_pixels"), number(tool, "wall_ms").alias("tool_wall_ms"),
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("a"), F.max(F.when(F.col("kind") == "finish", F.col("ts"))).alias("b"), *(number(llm, c).alias(name) for c, name in SPENT.items()),
    )
    named = F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("tool", "calls")))
    return per.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(named)).alias("tool_calls"), F.sum("calls").alias("total_tool_calls"), *(F.sum(c).alias(c) for c in ("cached_hits", "detector_pixels")),
        (F.max("b") - F.min("a")).alias("wall_ms"), F.sum("tool_wall_ms").alias("tool_wall_ms"), *(F.sum(name).alias(name) for name in SPENT.values()),
    )


def lane_counts(routes: DataFrame) -> DataFrame:
    """The router's counters by lane: (lane, n, wanted, absorbed, invoked, denied) of the routed cases."""
    flags = {"wanted": "escalation_wanted", "absorbed": "student_absorbed", "invoked": "llm_invoked", "denied": "llm_denied_by_cap"}
    return routes.where("lane is not null").groupBy("lane").agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(name) for name, c in flags.items()))


def audit_log(evaluations: DataFrame, by: str, seq: str) -> DataFrame:
    """Gate evaluations (by, seq, policy_id, gate_passed, e_value, checks) as chained entries (by, seq, kind, body, hashes).

    One chain for each value of by. The body has the verdict, the e-value ("none" without one) and the checks.
    """
    told = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    body = F.concat_ws("|", F.lit("gate_evaluation"), told("policy_id", ""), F.when(F.coalesce("gate_passed", F.lit(False)), "passed").otherwise("failed"), told("e_value", "none"), told("checks", ""))
    entries = evaluations.select(by, seq, F.lit("gate_evaluation").alias("kind"), body.alias("body"))
    return chain(entries, by, seq, "body")


class Breaker:
    """Grants the n-th request while fewer than ceil(fraction * seen) were granted; a fold, since a grant depends on those before."""

    def __init__(self, fraction: float) -> None:
        self.fraction, self.seen, self.granted = fraction, 0, 0

    def admit(self) -> bool:
        allowed = self.fraction > 0 and self.granted < int(np.ceil(self.fraction * max(self.seen, 1)))
        self.granted += allowed
        return bool(allowed)


def admitted(cases: DataFrame, fraction: float, by: str, order: str = "seq", wants: str = "wants", keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, keep, granted) for cases that want the expensive lane, in order; one breaker for each batch of column by.

    The breaker's fold as sums: the slack, what is allowed so far less what was wanted so far, falls by one at most, and
    the wish that takes it to a negative value for the first time is denied. Null wishes are none; cases that tie in
    order come in any order among them.
    """
    from quillon.plans.prefix import running_by

    want = F.coalesce(F.col(wants), F.lit(False))
    at = running_by(cases.select(by, order, *keep, want.alias("_want")), [by], order, {"_n": F.lit(1).cast("bigint"), "_w": F.col("_want").cast("bigint")})
    at = at.withColumn("_slack", F.ceil(F.lit(float(max(fraction, 0.0))) * F.col("_n")) - F.col("_w"))
    denied = at.where("_slack < 0").groupBy(by, "_slack").agg(F.min("_n").alias("_n")).alias("d")
    out = at.alias("a").join(denied, F.col(f"a.{by}").eqNullSafe(F.col(f"d.{by}")) & (F.col("a._n") == F.col("d._n")), "left")
    return out.select(f"a.{by}", f"a.{order}", *(f"a.{c}" for c in keep), (F.col("_want") & F.col("d._n").isNull()).alias("granted"))


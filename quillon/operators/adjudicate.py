"""Adjudicators as plug-ins, and the tools they may call: an allow-list with a ledger, results remembered by content."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.canonical import content_id
from quillon.operators.candidates import decide
from quillon.operators.events import Ledger


class Adjudicator(Protocol):
    """Gives every case of a table a decision."""

    def adjudicate(self, cases: DataFrame) -> DataFrame: ...


class Rules:
    """The rule ladder as an adjudicator over (case_id, qc, disagreement, case_score, n_blindspot)."""

    def __init__(self, low: float = 0.35, high: float = 0.65, most: float = 0.4) -> None:
        self.low, self.high, self.most = low, high, most

    def adjudicate(self, cases: DataFrame) -> DataFrame:
        d = decide(F.col("qc"), F.col("disagreement"), F.col("case_score"), F.col("n_blindspot"), self.low, self.high, self.most)
        return cases.withColumn("decision", d).withColumn("rule_decision", d)


class Scripted:
    """Answers from a table (case_id, decision, usd, output_tokens, error): a stand-in for an adjudicator behind a network.

    Answers over budget, failed or missing fall back to the rules, and the spending stays on record.
    """

    def __init__(self, answers: DataFrame, max_usd: float | None = None, max_tokens: int | None = None, rules: Rules | None = None) -> None:
        self.answers, self.max_usd, self.max_tokens, self.rules = answers, max_usd, max_tokens, rules or Rules()

    def adjudicate(self, cases: DataFrame) -> DataFrame:
        ruled = self.rules.adjudicate(cases).drop("decision")
        joined = ruled.join(self.answers, "case_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("decision").isNull(), "no answer")))
        return enforce_budget(joined, self.max_usd, self.max_tokens)


def enforce_budget(answers: DataFrame, max_usd: float | None = None, max_tokens: int | None = None) -> DataFrame:
    """answers with fallback_reason, and the rule's decision where there is one. Budgets are looked at after the fact."""
    reason = F.when(F.col("error").isNotNull(), F.col("error"))
    if max_usd is not None:
        reason = reason.when(F.col("usd") > max_usd, "usd")
    if max_tokens is not None:
        reason = reason.when(F.col("output_tokens") > max_tokens, "output_tokens")
    out = answers.withColumn("fallback_reason", reason)
    out = out.withColumn("decision", F.when(F.col("fallback_reason").isNull(), F.col("decision")).otherwise(F.col("rule_decision")))
    return out.withColumn("agreed_with_rule", F.col("decision") == F.col("rule_decision"))


class Toolbelt:
    """Named functions; every call and result is entered in a ledger, and equal calls are answered from memory."""

    def __init__(self, tools: dict[str, Callable[..., Any]], versions: dict[str, str] | None = None) -> None:
        self.tools, self.versions = dict(tools), versions or {}
        self.ledger, self.memo, self.calls, self.hits = Ledger(), {}, {}, 0

    def call(self, name: str, **arguments: Any) -> Any:
        if name not in self.tools:
            raise PermissionError(f"tool {name!r} is not allowed")
        key = content_id([name, self.versions.get(name, ""), arguments], 64)
        ref = self.ledger.append("tool_call", {"tool": name, "args": arguments}, "")
        self.calls[name] = self.calls.get(name, 0) + 1
        if key in self.memo:
            self.hits += 1
            result, source = self.memo[key]
            self.ledger.append("tool_result_cached", {"tool": name, "call": ref, "key": key, "original": source}, "")
            return result
        result = self.tools[name](**arguments)
        self.memo[key] = (result, self.ledger.append("tool_result", {"tool": name, "call": ref, "result": result}, ""))
        return result

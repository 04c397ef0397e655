"""Criterion programs run one after the other within a budget, each with a receipt. Nothing is combined into a score.

A program reads an artifact's relations and returns observations; what it computes is a Spark plan, while the order of programs, which hangs on what the ones before cost, is
kept on the driver. A run is a few dozen steps.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DESCRIPTOR = ("id", "version", "criterion", "epistemic_class", "deterministic")
STEP = "step int, program_id string, version string, criterion string, epistemic_class string, deterministic boolean, status string, usd double, wall_time_ms long, observation string, digest string, stop_reason string, message string"


@dataclass(frozen=True)
class Resources:
    usd: float = 0.0
    wall_time_ms: int = 0
    programs: int = 1

    def less(self, spent: Resources) -> Resources:
        """What is left, never below nothing."""
        return Resources(max(0.0, self.usd - spent.usd), max(0, self.wall_time_ms - spent.wall_time_ms), max(0, self.programs - spent.programs))

    def short_of(self, need: Resources) -> str | None:
        return "budget_exhausted" if need.usd > self.usd or need.wall_time_ms > self.wall_time_ms else "program_limit" if need.programs > self.programs else None


@dataclass(frozen=True)
class Program:
    """``run`` gives observations that JSON can hold, updates of beliefs, and dollars spent. ``applies`` gives None, or why not and whether it is unsupported."""

    id: str
    version: str
    criterion: str
    run: Callable[[object], tuple[object, dict[str, float], float]]
    epistemic_class: str = "measurement"
    deterministic: bool = True
    estimate: Resources = field(default_factory=Resources)
    applies: Callable[[object], tuple[str, str] | None] = lambda artifact: None


@dataclass
class Run:
    steps: list[dict]
    beliefs: dict[str, float]
    digests: list[str]
    remaining: Resources
    stopped_reason: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(s[c.split()[0]] for c in STEP.split(", ")) for s in self.steps], STEP)


def elapsed_ms(ns: int) -> int:
    """Whole milliseconds; anything above nothing is at least one."""
    return 0 if ns <= 0 else max(1, ns // 1_000_000)


def evaluate(artifact: object, programs: list[Program], beliefs: dict[str, float], budget: Resources) -> Run:
    """Runs programs until one stops: it does not apply, its estimate is beyond what remains, it fails, or it has used up the budget."""
    if not programs:
        raise ValueError("at least one criterion program is required")
    bad = [c for c, p in beliefs.items() if not 0 <= p <= 1]
    if bad or budget.usd < 0 or budget.wall_time_ms < 0 or budget.programs < 0:
        raise ValueError(f"no probability or no budget: {bad or budget}")
    out = Run([], dict(beliefs), [], budget, "complete")
    for k, p in enumerate(programs):
        step = dict.fromkeys(c.split()[0] for c in STEP.split(", ")) | {"step": k, "program_id": p.id, **{f: getattr(p, f) for f in DESCRIPTOR[1:]}, "usd": 0.0, "wall_time_ms": 0}
        out.steps.append(step)
        refused = p.applies(artifact)
        short = out.remaining.short_of(p.estimate)
        if refused or short:
            status, reason, message = (refused[0], refused[0], refused[1]) if refused else ("refused", short, "the estimate exceeds what remains")
            step.update(status=status, stop_reason=reason, message=message)
            out.stopped_reason = reason
            break
        began = time.perf_counter_ns()
        try:
            observation, updates, usd = p.run(artifact)
            text, wrong = json.dumps(observation, sort_keys=True), [c for c, v in updates.items() if c not in beliefs or not 0 <= v <= 1]
            if wrong:
                raise ValueError(f"updates of unknown claims or beyond 0 to 1: {wrong}")
        except Exception as failure:  # a program's failure is a result of the run
            spent = replace(p.estimate, usd=0.0, wall_time_ms=elapsed_ms(time.perf_counter_ns() - began), programs=1)
            out.remaining, out.stopped_reason = out.remaining.less(spent), "failed"
            step.update(status="failed", stop_reason="failed", message=str(failure), wall_time_ms=spent.wall_time_ms)
            break
        spent = Resources(usd, elapsed_ms(time.perf_counter_ns() - began), 1)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left, over = out.remaining.less(spent), out.remaining.short_of(spent)
        reason = over or ("program_limit" if not left.programs else "budget_exhausted" if usd > 0 and not left.usd or spent.wall_time_ms > 0 and not left.wall_time_ms else None)
        if k == len(programs) - 1 and not over:
            reason = "complete"
        step.update(status="completed", usd=usd, wall_time_ms=spent.wall_time_ms, observation=text, digest=digest, stop_reason=reason)
        out.beliefs.update(updates)
        out.digests.append(digest)
        out.remaining = left
        if reason:
            out.stopped_reason = reason
            break
    return out


def zipped(left: DataFrame, right: DataFrame, by: str = "step") -> DataFrame:
    """Steps of two runs side by side, in order: ``by``, and the first field of the descriptor in which they differ (``mismatch``, ``step`` if one side has no such step), with both values."""
    a, b = (x.select(F.col(by).alias(f"__{s}"), *(F.col(f if f != "id" else "program_id").cast("string").alias(f"{s}_{f}") for f in DESCRIPTOR)) for s, x in (("left", left), ("right", right)))
    both = a.join(b, F.col("__left") == F.col("__right"), "full_outer")
    first = F.when(F.col("__left").isNull() | F.col("__right").isNull(), "step")
    for f in DESCRIPTOR:
        first = first.when(~F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}")), f)
    value = lambda s: F.coalesce(*(F.when(F.col("mismatch") == f, F.col(f"{s}_{f}")) for f in DESCRIPTOR))
    return both.withColumn("mismatch", first).select(F.coalesce("__left", "__right").alias(by), "mismatch", value("left").alias("left"), value("right").alias("right"))

"""Information planning over claims and probes.

Single-probe figures, the Pareto frontier and joint figures by outcome enumeration are column plans over any number of rows. The greedy
selection is sequential by nature and works on one plan specification, which is input of the size of a form; it runs on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import binary_entropy, ratio
from tessera.plans.checkpoints import cut

STRATEGIES = ("max_information", "information_per_usd", "information_per_second", "max_risk_reduction")
ENUMERATION_LIMIT = 20


def joined(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes with their claims; a probe of an unknown claim fails the query."""
    c = claims.withColumnRenamed("id", "__claim").withColumn("__there", F.lit(True))
    j = probes.join(c, F.col("claim_id") == F.col("__claim"), "left")
    return j.withColumn("id", F.when(F.col("__there").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unknown claim: "), F.col("claim_id"))).cast("string"))).drop("__claim", "__there")


def probe_metrics(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """Posteriors, information gain, Bayes risk reduction and flip probability of each probe taken alone."""
    j = joined(claims, probes)
    p, s, c = F.col("prior_probability"), F.col("sensitivity"), F.col("specificity")
    fp, fn = F.col("false_positive_loss"), F.col("false_negative_loss")
    j = j.withColumns({"__tp": p * s, "__fp": (1 - p) * (1 - c), "__fn": p * (1 - s), "__tn": (1 - p) * c})
    j = j.withColumn("positive_probability", F.col("__tp") + F.col("__fp")).withColumn("__neg", 1 - F.col("positive_probability"))
    j = j.withColumns({"posterior_positive": F.coalesce(ratio(F.col("__tp"), F.col("positive_probability")), p), "posterior_negative": F.coalesce(ratio(F.col("__fn"), F.col("__fn") + F.col("__tn")), p)})
    after = F.col("positive_probability") * binary_entropy(F.least(F.lit(1.0), F.col("posterior_positive"))) + F.col("__neg") * binary_entropy(F.least(F.lit(1.0), F.col("posterior_negative")))
    gain = F.greatest(F.lit(0.0), binary_entropy(p) - after)
    risk = F.least((1 - p) * fp, p * fn) - F.least(F.col("__fp") * fp, F.col("__tp") * fn) - F.least(F.col("__tn") * fp, F.col("__fn") * fn)
    acts = lambda q: (1 - q) * fp < q * fn  # noqa: E731  a tie leaves the claim alone
    base = acts(p)
    flip = F.when(acts(F.col("posterior_positive")) != base, F.col("positive_probability")).otherwise(0.0) + F.when(acts(F.col("posterior_negative")) != base, F.col("__neg")).otherwise(0.0)
    j = j.withColumns({"information_bits": gain, "risk_reduction": F.greatest(F.lit(0.0), risk), "decision_flip_probability": flip})
    return j.select(
        "id", "claim_id", "importance", "expected_usd", "expected_seconds", "positive_probability", "posterior_positive", "posterior_negative", "information_bits", "risk_reduction", "decision_flip_probability",
        ratio(F.col("information_bits"), F.col("expected_usd")).alias("bits_per_usd"), ratio(F.col("information_bits"), F.col("expected_seconds")).alias("bits_per_second"),
    )


def undominated(rows: np.ndarray) -> np.ndarray:
    """Which rows (greater is better in every column) no other dominates. Rows of greater sums come first, so only kept rows can dominate those after them."""
    kept = np.zeros(len(rows), bool)
    best = np.zeros((0, rows.shape[1]))
    for k in np.argsort(-rows.sum(axis=1), kind="stable"):
        x = rows[k]
        if not ((best >= x).all(axis=1) & (best > x).any(axis=1)).any():
            kept[k] = True
            best = np.vstack([best, x])
    return kept


def frontier(values: DataFrame) -> DataFrame:
    """Rows (id, information, risk, usd, seconds) that no other dominates; rows worth nothing are none, and dominate none that is worth something.

    Equal quadruples stand or fall together. Each partition keeps its own undominated quadruples; only these few are compared with each other.
    """
    v = values.where("information > 0 or risk > 0")
    names = ["information", "risk", "usd", "seconds"]
    d = v.select(*(F.col(c).cast("double").alias(c) for c in names)).distinct()

    def local(frames):
        best = pd.DataFrame({c: np.zeros(0) for c in names})
        for pdf in frames:
            both = pd.concat([best, pdf], ignore_index=True) if len(best) else pdf
            best = both[undominated(both.to_numpy() * [1, 1, -1, -1])]
        yield best

    few = cut(d.mapInPandas(local, ", ".join(f"{c} double" for c in names)))
    o = few.select(*(F.col(c).alias(f"o_{c}") for c in names))
    at_least = (F.col("o_information") >= F.col("information")) & (F.col("o_risk") >= F.col("risk")) & (F.col("o_usd") <= F.col("usd")) & (F.col("o_seconds") <= F.col("seconds"))
    strict = (F.col("o_information") > F.col("information")) | (F.col("o_risk") > F.col("risk")) | (F.col("o_usd") < F.col("usd")) | (F.col("o_seconds") < F.col("seconds"))
    best = few.join(o, at_least & strict, "left_anti").select(*(F.col(c).alias(f"__{c}") for c in names))
    same = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"__{c}") for c in names))
    return v.join(best, same, "left_semi")


def weighted(metrics: DataFrame) -> DataFrame:
    return metrics.select("id", (F.col("importance") * F.col("information_bits")).alias("information"), (F.col("importance") * F.col("risk_reduction")).alias("risk"), F.col("expected_usd").alias("usd"), F.col("expected_seconds").alias("seconds"))


def joint_metrics(claims: DataFrame, probes: DataFrame) -> DataFrame:
    """Information and risk reduction of all probes of a claim together, over the 2^k outcomes; more than 20 probes fail the query."""
    j = joined(claims, probes)
    g = j.groupBy("claim_id", "prior_probability", "false_positive_loss", "false_negative_loss").agg(F.array_sort(F.collect_list(F.struct("id", "sensitivity", "specificity"))).alias("ps"))
    k = F.size("ps")
    top = F.when(k <= ENUMERATION_LIMIT, F.call_function("shiftleft", F.lit(1), k) - 1).otherwise(F.raise_error(F.lit("too many probes to enumerate")).cast("int"))
    m = g.withColumn("mask", F.explode(F.sequence(F.lit(0), top)))
    seen = lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1
    likely = lambda yes, no: F.aggregate(F.transform("ps", lambda x, i: F.when(seen(i), yes(x)).otherwise(no(x))), F.lit(1.0), lambda a, x: a * x)
    p = F.col("prior_probability")
    m = m.withColumn("t", p * likely(lambda x: x["sensitivity"], lambda x: 1 - x["sensitivity"])).withColumn("f", (1 - p) * likely(lambda x: 1 - x["specificity"], lambda x: x["specificity"]))
    chance = F.col("t") + F.col("f")
    after = F.when(chance > 0, chance * binary_entropy(F.least(F.lit(1.0), F.col("t") / chance))).otherwise(0.0)
    cost = F.least(F.col("f") * F.col("false_positive_loss"), F.col("t") * F.col("false_negative_loss"))
    out = m.groupBy("claim_id", "prior_probability", "false_positive_loss", "false_negative_loss").agg(F.sum(after).alias("after"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("outcomes"))
    bits = F.greatest(F.lit(0.0), binary_entropy(p) - F.col("after"))
    risk = F.greatest(F.lit(0.0), F.least((1 - p) * F.col("false_positive_loss"), p * F.col("false_negative_loss")) - F.col("cost"))
    return out.select("claim_id", "outcomes", bits.alias("information_bits"), risk.alias("risk_reduction"))


@dataclass(frozen=True)
class Budget:
    max_usd: float
    max_seconds: float
    max_probes: int


def entropy_bits(p: float) -> float:
    return 0.0 if p in (0.0, 1.0) else -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def joint(claim: dict, probes: list[dict]) -> tuple[float, float]:
    """Information bits and risk reduction of ``probes`` together."""
    states = [(claim["prior_probability"], 1 - claim["prior_probability"])]
    for p in probes:
        states = [s for t, f in states for s in ((t * p["sensitivity"], f * (1 - p["specificity"])), (t * (1 - p["sensitivity"]), f * p["specificity"]))]
    fp, fn, prior = claim["false_positive_loss"], claim["false_negative_loss"], claim["prior_probability"]
    after = math.fsum((t + f) * entropy_bits(min(1.0, t / (t + f))) for t, f in states if t + f > 0)
    cost = math.fsum(min(f * fp, t * fn) for t, f in states)
    return max(0.0, entropy_bits(prior) - after), max(0.0, min((1 - prior) * fp, prior * fn) - cost)


def dominated(a: dict, b: dict) -> bool:
    return b["information"] >= a["information"] and b["risk"] >= a["risk"] and b["usd"] <= a["usd"] and b["seconds"] <= a["seconds"] and (b["information"] > a["information"] or b["risk"] > a["risk"] or b["usd"] < a["usd"] or b["seconds"] < a["seconds"])


def _key(c: dict, strategy: str) -> tuple:
    def per(cost: float) -> tuple:
        free = cost == 0 and c["information"] > 0
        return free, 0.0 if free or cost == 0 else c["information"] / cost

    first = {"max_information": (c["information"],), "information_per_usd": per(c["usd"]), "information_per_second": per(c["seconds"]), "max_risk_reduction": (c["risk"],)}[strategy]
    return (*first, c["information"], c["risk"], -c["usd"], -c["seconds"])


def greedy_plan(claims: list[dict], probes: list[dict], budget: Budget, strategy: str = "max_information", independent: bool = True) -> tuple[list[dict], str]:
    """Steps of the plan in order, and why it stopped."""
    validate(claims, probes, budget, strategy)
    by_claim = {c["id"]: c for c in claims}
    chosen: dict[str, list[dict]] = {c: [] for c in by_claim}
    held = {c: (0.0, 0.0) for c in by_claim}
    steps: list[dict] = []
    taken: set[str] = set()
    usd = seconds = 0.0
    while True:
        if len(steps) >= budget.max_probes:
            return steps, "max probes reached"
        if not independent and steps:
            return steps, "dependence constraint"
        left = [p for p in probes if p["id"] not in taken]
        apart = [p for p in left if p["dependence_group"] not in {q["dependence_group"] for q in chosen[p["claim_id"]]}]
        small = [p for p in apart if len(chosen[p["claim_id"]]) < ENUMERATION_LIMIT]
        fits = [p for p in small if usd + p["expected_usd"] <= budget.max_usd and seconds + p["expected_seconds"] <= budget.max_seconds]
        if not fits:
            return steps, "no candidates" if not left else "dependence constraint" if not apart else "exact enumeration limit" if not small else "budget exhausted"
        values = []
        for p in fits:
            claim, before = by_claim[p["claim_id"]], held[p["claim_id"]]
            after = tuple(max(x, y) for x, y in zip(joint(claim, [*chosen[p["claim_id"]], p]), before))
            gain = [(x - y) * claim["importance"] for x, y in zip(after, before)]
            values.append({"id": p["id"], "probe": p, "after": after, "information": gain[0], "risk": gain[1], "usd": p["expected_usd"], "seconds": p["expected_seconds"]})
        front = [v for v in values if (v["information"] > 0 or v["risk"] > 0) and not any(dominated(v, o) for o in values)]
        if not front:
            return steps, "no positive marginal value"
        best = max(sorted(front, key=lambda v: v["id"]), key=lambda v: _key(v, strategy))
        if (best["risk"] if strategy == "max_risk_reduction" else best["information"]) <= 0:
            return steps, "no positive marginal value"
        claim_id = best["probe"]["claim_id"]
        taken.add(best["id"])
        chosen[claim_id].append(best["probe"])
        held[claim_id] = best["after"]
        usd, seconds = usd + best["usd"], seconds + best["seconds"]
        steps.append(
            {
                "ordinal": len(steps) + 1, "probe_id": best["id"], "claim_id": claim_id, "marginal_information_bits": best["information"], "marginal_risk_reduction": best["risk"],
                "cumulative_information_bits": math.fsum(by_claim[c]["importance"] * v[0] for c, v in held.items()),
                "cumulative_expected_risk_reduction": math.fsum(by_claim[c]["importance"] * v[1] for c, v in held.items()),
                "cumulative_usd": usd, "cumulative_seconds": seconds, "candidate_frontier": sorted(v["id"] for v in front),
            }
        )


def validate(claims: list[dict], probes: list[dict], budget: Budget, strategy: str) -> None:
    """Raises ValueError on a specification that is empty, repeats ids, names unknown claims or holds figures out of range."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    for what, rows in (("claim", claims), ("probe", probes)):
        ids = [r["id"] for r in rows]
        if any(not i for i in ids):
            raise ValueError(f"{what} id is empty")
        if len(set(ids)) < len(ids):
            raise ValueError(f"{what} ids repeat")
    known = {c["id"] for c in claims}
    unit = [(c["id"], k, c[k]) for c in claims for k in ("prior_probability",)] + [(p["id"], k, p[k]) for p in probes for k in ("sensitivity", "specificity")]
    positive = [(c["id"], k, c[k]) for c in claims for k in ("false_positive_loss", "false_negative_loss", "importance")] + [(p["id"], k, p[k]) for p in probes for k in ("expected_usd", "expected_seconds")]
    positive += [("budget", "max_usd", budget.max_usd), ("budget", "max_seconds", budget.max_seconds)]
    for name, k, v in unit:
        if not 0 <= v <= 1:
            raise ValueError(f"{name}: {k} is outside [0, 1]")
    for name, k, v in positive:
        if not (math.isfinite(v) and v >= 0):
            raise ValueError(f"{name}: {k} must be finite and not negative")
    for p in probes:
        if p["claim_id"] not in known:
            raise ValueError(f"{p['id']}: unknown claim {p['claim_id']}")

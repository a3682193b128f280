"""Scores of a session as column expressions: cost, axes, success, utility.

Terms are added in a fixed order, so that floating sums are the same everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Baselines:
    """Reference amounts at which an axis is one half."""

    cost_usd: float = 1.0
    tool_calls: float = 20.0
    turns: float = 8.0


#: Model name parts in order of match, with USD per million input, output and cached tokens.
PRICES = [
    (("opus",), (15.0, 75.0, 1.5)),
    (("sonnet",), (3.0, 15.0, 0.3)),
    (("haiku",), (0.8, 4.0, 0.08)),
    (("gpt", "codex", "o1", "o3"), (2.5, 10.0, 0.25)),
]
DEFAULT_PRICE = (3.0, 15.0, 0.3)
MOST_NUDGE = 12.0


def round_half_away(x: Column, digits: int) -> Column:
    """Rounding of the binary product, halves away from zero; unlike round() it never sees decimals."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round1(x: Column) -> Column:
    return round_half_away(x, 1)


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours from one timestamp to another."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cap_count(n: Column, most: int) -> Column:
    return F.least(F.greatest(n, F.lit(0)), F.lit(most))


def ratio(reference: float, x: Column) -> Column:
    """1 at nothing, one half at the reference, towards 0 beyond."""
    if reference <= 0:
        return F.lit(0.0)
    return F.lit(reference) / (F.lit(reference) + F.greatest(x.cast("double"), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def model_known(model: Column) -> Column:
    name = F.lower(model)
    return reduce(lambda a, b: a | b, [name.contains(p) for parts, _ in PRICES for p in parts])


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, tokens_cached: Column) -> Column:
    """Cost in dollars, rounded to cents, at the rates of the model's name or the default ones."""
    name = F.lower(model)
    rates = F.array(*map(F.lit, DEFAULT_PRICE))
    for parts, rate in reversed(PRICES):
        hit = reduce(lambda a, b: a | b, [name.contains(p) for p in parts])
        rates = F.when(hit, F.array(*map(F.lit, rate))).otherwise(rates)
    total = tokens_in * rates[0] + tokens_out * rates[1] + tokens_cached * rates[2]
    return round_half_away(total / 1e6, 2)


def efficiency(cost: Column, tool_calls: Column, b: Baselines = Baselines()) -> Column:
    return round1(100 * (ratio(b.cost_usd, cost) + ratio(b.tool_calls, tool_calls)) / 2)


def autonomy(tool_errors: Column, tool_calls: Column) -> Column:
    rate = F.when(tool_calls > 0, tool_errors.cast("double") / tool_calls).otherwise(F.lit(0.0))
    return round1(100 * (1 - clamp(rate, 0.0, 1.0)))


def friction(turns: Column, b: Baselines = Baselines()) -> Column:
    return round1(100 * ratio(b.turns, turns))


def judge_nudge(base: Column, judged: Column) -> Column:
    return round1(clamp((judged - base) * 0.25, -MOST_NUDGE, MOST_NUDGE))


def outcome_known(verification: Column, landed: Column, terminated: Column) -> Column:
    return (F.coalesce(verification, F.lit("")) != "") | F.coalesce(landed, F.lit(False)) | terminated.isNotNull()


def deterministic_success(verification: Column, landed: Column, terminated: Column) -> Column:
    score = F.when(verification == "passed", 85.0).when(verification == "failed", 30.0).otherwise(55.0)
    score = score + F.when(landed, 10.0).otherwise(0.0)
    score = score - F.when(~terminated, 25.0).otherwise(0.0)
    return clamp(score, 0.0, 100.0)


def success(verification: Column, landed: Column, terminated: Column, judged: Column) -> Column:
    """The success axis; null where neither signals nor a judge spoke."""
    base = deterministic_success(verification, landed, terminated)
    nudged = F.when(judged.isNull(), base).otherwise(base + judge_nudge(base, judged))
    known = outcome_known(verification, landed, terminated)
    return F.when(known, clamp(round1(nudged), 0.0, 100.0)).when(judged.isNotNull(), clamp(round1(judged), 0.0, 100.0))


def success_detail(verification: Column, landed: Column, terminated: Column, judged: Column, label: Column) -> Column:
    parts = F.concat_ws(
        " · ",
        F.when(verification == "passed", "tests passed").when(verification == "failed", "tests failed").otherwise("no tests run"),
        F.when(landed, "committed/PR"),
        F.when(terminated.isNull(), "end unknown").when(terminated, "clean end").otherwise("abandoned"),
    )
    known = outcome_known(verification, landed, terminated)
    spoken = F.when(F.coalesce(label, F.lit("")) == "", "judged").otherwise(label)
    return F.when(known, F.concat(parts, F.when(judged.isNotNull(), " + judge").otherwise(""))).when(judged.isNotNull(), spoken)


def utility_terms(s: dict[str, Column], b: Baselines = Baselines()) -> list[tuple[Column, Column, Column]]:
    """(applies, delta, label) of each term of the utility's logit, in order.

    s has verification, verified_after_edit, landed, terminated, edits, corrections, interruptions,
    rework, acceptances, tool_calls, tool_errors and turns.
    """
    yes, zero = F.lit(True), F.lit(0.0)
    corrections, interruptions, rework = cap_count(s["corrections"], 5), cap_count(s["interruptions"], 4), cap_count(s["rework"], 5)
    rate = s["tool_errors"].cast("double") / s["tool_calls"]
    extra = cap_count(s["turns"] - int(b.turns), 16)
    word = lambda c: c.cast("string")
    v, t = s["verification"], s["terminated"]
    return [
        (yes, F.when(v == "passed", 1.7).when(v == "failed", -2.0).otherwise(zero), F.when(v == "passed", "verification passed").when(v == "failed", "verification failed").otherwise("verification unknown")),
        (F.coalesce(s["verified_after_edit"], F.lit(False)), F.lit(0.7), F.lit("verified after edit")),
        (F.coalesce(s["landed"], F.lit(False)), F.lit(1.1), F.lit("landed action")),
        (yes, F.when(t.isNull(), zero).when(t, 0.4).otherwise(F.lit(-1.5)), F.when(t.isNull(), "termination unknown").when(t, "clean end").otherwise("abandoned")),
        (s["edits"] > 0, F.lit(0.25), F.lit("edits observed")),
        (corrections > 0, -0.35 * corrections, F.concat(F.lit("human corrections "), word(corrections))),
        (interruptions > 0, -0.20 * interruptions, F.concat(F.lit("interruptions "), word(interruptions))),
        (rework > 0, -0.20 * rework, F.concat(F.lit("rework "), word(rework))),
        (s["acceptances"] > 0, F.lit(0.8), F.lit("human acceptance")),
        ((s["tool_calls"] > 0) & (s["tool_errors"] > 0), -1.2 * clamp(rate, 0.0, 1.0), F.format_string("tool error rate %.0f%%", 100 * rate)),
        (extra > 0, -0.055 * extra, F.concat(F.lit("extra collaborative turns "), word(extra))),
    ]


def utility_logit(s: dict[str, Column], b: Baselines = Baselines()) -> Column:
    total = F.lit(-0.35)
    for applies, delta, _ in utility_terms(s, b):
        total = total + F.when(applies, delta).otherwise(F.lit(0.0))
    return total


def utility_evidence(s: dict[str, Column], b: Baselines = Baselines()) -> Column:
    lines = [F.when(applies, F.format_string("%s %+.2f", label, delta)) for applies, delta, label in utility_terms(s, b)]
    return F.array_compact(F.array(F.lit("baseline -0.35"), *lines))


def deterministic_utility(s: dict[str, Column], b: Baselines = Baselines()) -> Column:
    return round1(100 * sigmoid(utility_logit(s, b)))


def utility(s: dict[str, Column], judged: Column, b: Baselines = Baselines()) -> Column:
    base = deterministic_utility(s, b)
    return F.when(judged.isNull(), base).otherwise(clamp(round1(base + judge_nudge(base, judged)), 0.0, 100.0))


def utility_confidence(s: dict[str, Column], judged: Column) -> Column:
    seen = (s["corrections"] > 0) | (s["acceptances"] > 0) | (s["interruptions"] > 0)
    verified = F.coalesce(s["verification"], F.lit("")) != ""
    landed, ended = F.coalesce(s["landed"], F.lit(False)), s["terminated"].isNotNull()
    return F.when(verified & (landed | seen | ended), "high").when(verified | landed | ended | seen | judged.isNotNull(), "medium").otherwise("low")


def verdict_score(outcome: Column, corrections: Column, sentiment: Column) -> Column:
    base = F.when(outcome == "accepted", 100.0).when(outcome == "corrected", 60.0).when(outcome == "abandoned", 15.0).otherwise(0.0)
    return clamp(round1(base - 8 * corrections.cast("double") + 10 * sentiment), 0.0, 100.0)


def verdict_label(outcome: Column, corrections: Column, sentiment: Column) -> Column:
    return F.format_string("%s · %d correction(s) · sentiment %+.1f", outcome, corrections, sentiment)

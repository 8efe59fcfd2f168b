"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights go from the sources' own token shares p (exponent 0) to the target shares t (exponent 1) as p^(1-x) t^x, normalised. At a
given budget the exponent is the largest that the repetition limits permit, found by bisection; without a budget, the budget is the
largest at which the limits permit exponent 1, so that the target shares are met. With a target entropy instead of target shares,
weights are p^x with x bisected to meet it.

A source's tokens are then drawn in epochs, each a permutation of its documents by a seeded hash. Whole epochs take all documents;
the last takes a prefix of the permutation. The permutation is cut into BLOCKS blocks by the hash: block sums and their running total
show which blocks are taken whole and which one the budget ends in, and only that block is ordered document by document. The document
that the budget ends in is used if most of it is within. A document's place in its epoch's permutation spreads the source evenly over
the mix: in the order of `at`, any stretch of the mix has the sources in about their shares.

Defined cases: documents without text, tokens, source or a source with a target aren't used; a source without documents gets nothing
and its share is spread over the others; repeated documents count apart; empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.llm.tokens import TOKENIZER, with_token_counts
from interlace.plans.storage import written

BLOCKS = 4096
#: The targets are a small table that the driver computes with; more sources are refused.
SOURCES = 100_000


def bisect(low: float, high: float, holds, steps: int = 100) -> float:
    """The largest x in [low, high] with `holds`, which holds at `low`."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def tempered(own: dict[str, float], exponent: float, target: dict[str, float] | None = None) -> dict[str, float]:
    """p^x, or p^(1-x) t^x with targets, normalised over the sources that have tokens (and a target)."""
    if target is None:
        logs = {s: exponent * math.log(p) for s, p in own.items() if p > 0}
    else:
        logs = {s: (1 - exponent) * math.log(p) + exponent * math.log(target[s]) for s, p in own.items() if p > 0 and target.get(s, 0) > 0}
    top = max(logs.values(), default=0.0)
    total = sum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(x - top) / total for s, x in logs.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def weights_for_entropy(own: dict[str, float], target: float) -> tuple[float, dict[str, float]]:
    """The exponent in [0, 1] and the weights p^x of that entropy, or the nearest there is: entropy falls as x grows."""
    x = bisect(0.0, 1.0, lambda e: entropy(tempered(own, e)) >= target)
    return x, tempered(own, x)


@dataclass
class Plan:
    """exponent and budget of a mix, and by source: target share, weight, available tokens, most repeats, tokens to draw."""

    exponent: float
    budget: int
    sources: dict[str, tuple[float, float, int, int, int]]


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None, target_entropy: float | None = None) -> Plan:
    """Weights and token quotas from the tokens of each source, and its target share and most repeats. With a target entropy the
    weights are tempered own shares of that entropy, whatever the target shares, and a budget beyond the limits is cut to them."""
    use = {s: n for s, n in available.items() if n > 0 and targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0}
    total = sum(use.values())
    own = {s: n / total for s, n in use.items()}
    share = {s: targets[s][0] for s in use}
    most = {s: n * targets[s][1] for s, n in use.items()}
    if target_entropy is not None and use:
        x, w = weights_for_entropy(own, target_entropy)
        budget = min([int(most[s] / w[s]) for s in w] + ([budget] if budget is not None else []))
        return _plan(x, budget, targets, w, available, most)
    if budget is None:
        w = tempered(own, 1.0, share)
        budget = min((int(most[s] / w[s]) for s in w), default=0)
    budget = min(budget, sum(most.values()))
    fits = lambda x: all(w * budget <= most[s] * (1 + 1e-12) for s, w in tempered(own, x, share).items())
    x = bisect(0.0, 1.0, fits) if use and fits(0.0) else 0.0
    return _plan(x, budget, targets, tempered(own, x, share), available, most)


def _plan(x: float, budget: int, targets: dict[str, tuple[float, int]], w: dict[str, float], available: dict[str, int], most: dict[str, int]) -> Plan:
    return Plan(x, budget, {s: (targets[s][0], w.get(s, 0.0), available.get(s, 0), targets[s][1], min(most.get(s, 0), int(w.get(s, 0.0) * budget))) for s in targets})


def token_table(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, n_tokens) of the documents with tokens whose source has a target; written once."""
    named = documents.sparkSession.createDataFrame([(s,) for s in wanted_shares(targets)], "source string")
    docs = documents.select(key, "source", text).where(f"{text} is not null and source is not null").join(F.broadcast(named), "source", "left_semi")
    return written(with_token_counts(docs, text, tokenizer=tokenizer).where("n_tokens > 0"), "document-tokens")


def wanted_shares(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Target share and most repeats by source; of a source named twice, the larger of either."""
    rows = targets.where("source is not null").limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    wanted: dict[str, tuple[float, int]] = {}
    for r in rows:
        share, repeats = wanted.get(r["source"], (0.0, 0))
        wanted[r["source"]] = (max(share, r["target_share"] or 0.0), max(repeats, r["max_repeats"] or 0))
    return wanted


def planned(tokens: DataFrame, targets: DataFrame, budget: int | None = None, target_entropy: float | None = None) -> Plan:
    """The plan for the token table `tokens` under (source, target_share, max_repeats)."""
    available = {r[0]: r[1] for r in tokens.groupBy("source").agg(F.sum("n_tokens")).collect()}
    return plan(available, wanted_shares(targets), budget, target_entropy)


def _place(epoch: Column, key: str, seed: int) -> Column:
    """Where a document stands in the permutation of an epoch, from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col(key)), 11) / float(1 << 53)


def mixed(tokens: DataFrame, made: Plan, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """(key, source, epoch, n_tokens, at): every use of a document; a document's epochs begin at 0 and differ. `at`, from 0 to 1, is
    the place in the mix."""
    spark = tokens.sparkSession
    rows = [(s, q // n, q % n, q / n) for s, (_, _, n, _, q) in made.sources.items() if n > 0 and q > 0]
    quotas = F.broadcast(spark.createDataFrame(rows, "source string, whole long, rest long, epochs double"))
    drawn = tokens.join(quotas, "source")
    full = drawn.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("u", _place(F.col("epoch"), key, seed))
    placed = drawn.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("u", _place(F.col("epoch"), key, seed)).withColumn("block", F.floor(F.col("u") * BLOCKS))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    running = sums.withColumn("upto", F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block"))).join(quotas, "source").where("upto > rest")
    edges = running.groupBy("source").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("block_tokens")).alias("before")), "block").alias("e"))
    found = placed.join(F.broadcast(edges), "source", "left").withColumns({"edge": F.coalesce("e.block", F.lit(BLOCKS).cast("long")), "before": F.col("e.before")})
    edge = found.where("block = edge").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("u", key).rowsBetween(Window.unboundedPreceding, 0)))
    parts = (full, found.where("block < edge"), edge.where("2 * (before + upto) - n_tokens <= 2 * rest"))
    at = F.least((F.col("epoch") + F.col("u")) / F.col("epochs"), F.lit(1.0)).alias("at")
    uses = [x.select(key, "source", "epoch", "n_tokens", at) for x in parts]
    return uses[0].unionByName(uses[1]).unionByName(uses[2])


def reached_shares(mix: DataFrame, made: Plan) -> DataFrame:
    """(source, target_share, exponent, weight, available_tokens, max_repeats, mixed_tokens, actual_share, most_uses), a row per
    target."""
    spark = mix.sparkSession
    rows = [(s, t, round(made.exponent, 9), round(w, 9), n, m) for s, (t, w, n, m, _) in made.sources.items()]
    wanted = spark.createDataFrame(rows, "source string, target_share double, exponent double, weight double, available_tokens long, max_repeats int")
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("epoch") + 1).alias("most_uses"))
    out = wanted.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_uses"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("mixed_tokens"), total), 9))


def target_entropy(targets: DataFrame) -> float:
    """The entropy of the target shares."""
    return entropy({s: t for s, (t, _) in wanted_shares(targets).items()})

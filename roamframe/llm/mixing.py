"""Temperature mixing of sources, in DataFrame operations only.

Source token shares p are raised to an exponent a and normalised, q ~ p**a.  The exponent
is bisected until the weights meet a target: a repetition limit (no source is read more
often than so many times) or an entropy.  The weights then become token budgets, and each
budget is realised as whole epochs plus a part of one more.  A source's rows are dealt to
blocks of bounded size by hash; every epoch permutes the blocks and the rows inside them,
and the part-epoch takes blocks in permuted order, and rows of the last block, up to the
budget.  The cut is found by prefix sums over coarse ranges, then blocks, then the rows
of one block, so a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roamframe.plans.scratch import cut

#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 20
#: Coarse ranges of a source's permutation.
RANGES = 1024
#: The table of sources is broadcast up to this many rows of less than 200 bytes; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 50_000
#: Levels of the bisection tree that one job evaluates, and jobs: 2**-24 of the interval.
_LEVELS, _JOBS = 4, 6


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space, plus one for the end of the text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _figures(alpha: float) -> list[Column]:
    """Per exponent: normaliser, sum of p**a ln p, and the largest and smallest q/p up to the normaliser."""
    p = F.col("share")
    power = F.pow(p, F.lit(alpha))
    return [F.sum(power), F.sum(power * F.log(p)), F.max(power / p), F.min(power / p)]


def _met(z: float, zl: float, top: float, low: float, alpha: float, budget: float | None, repeat_limit: float | None, entropy: float | None) -> bool:
    """Whether the weights at this exponent keep to the target; the answer turns once between 0 and 1."""
    if repeat_limit is not None:
        # without a budget the source that gains least is read exactly once
        return (top / low if budget is None else budget * top / z) <= repeat_limit
    return math.log(z) - alpha * zl / z <= entropy * math.log(2)


def temperature(shares: DataFrame, repeat_limit: float | None = None, entropy_bits: float | None = None, budget_epochs: float | None = None) -> float:
    """The smallest exponent in [0, 1] that meets the target, by bisection on shares(share)."""
    if (repeat_limit is None) == (entropy_bits is None):
        raise ValueError("give either repeat_limit or entropy_bits")
    low, high = 0.0, 1.0
    for job in range(_JOBS):
        steps = 2**_LEVELS
        points = [low + (high - low) * k / steps for k in range(0 if job == 0 else 1, steps)]
        row = shares.agg(*[c.alias(f"f{i}_{j}") for i, a in enumerate(points) for j, c in enumerate(_figures(a))]).first()
        if row["f0_0"] is None:
            return 1.0
        met = [_met(*(row[f"f{i}_{j}"] for j in range(4)), a, budget_epochs, repeat_limit, entropy_bits) for i, a in enumerate(points)]
        if met[0] and job == 0:
            return 0.0
        at = next((i for i, ok in enumerate(met) if ok), None)
        low, high = (points[-1], high) if at is None else (points[at - 1] if at else low, points[at])
    return high


def _order(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _cuts(thin: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per source where its part-epoch ends: everything before (block key, row key) is taken."""
    keyed = thin.withColumn("bk", _order(seed, F.lit("block"), "epochs", "src", "block")).withColumn("rk", _order(seed, F.lit("row"), "epochs", "doc_id"))
    blocks = cut(keyed.groupBy("src", "bk").agg(F.sum("tokens").alias("t")))
    coarse = F.shiftright("bk", 64 - int(math.log2(RANGES)))
    ranges = blocks.groupBy("src", coarse.alias("r")).agg(F.sum("t").alias("t"))
    part = plan.select("src", "part")

    def first_over(rows: DataFrame, key: str) -> DataFrame:
        """The row of each source at which the running sum passes ``part``, with what is left for it."""
        upto = F.sum("t").over(W.partitionBy("src").orderBy(key)) - F.col("t")
        over = rows.withColumn("before", upto).filter("before < part")
        return over.groupBy("src").agg(F.max(F.struct(key, "before", "part")).alias("q")).select("src", f"q.{key}", (F.col("q.part") - F.col("q.before")).alias("part"))

    at_range = first_over(ranges.join(part, "src"), "r")
    inside = blocks.withColumn("r", coarse).join(at_range, ["src", "r"]).drop("r")
    at_block = cut(first_over(inside, "bk"))
    rows = keyed.join(at_block, ["src", "bk"]).groupBy("src", "bk", "rk", "part").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy("src").orderBy("rk"))
    taken = rows.withColumn("upto", upto).filter("upto <= part").groupBy("src").agg(F.max("rk").alias("row_cut"))
    return at_block.select("src", F.col("bk").alias("block_cut")).join(taken, "src", "left")


def mix_sources(
    docs: DataFrame,
    repeat_limit: float | None = 2.0,
    entropy_bits: float | None = None,
    budget_epochs: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
) -> DataFrame:
    """``docs`` repeated or thinned to temperature weights, with the columns of the realised mix.

    ``budget_epochs`` is the token budget in units of the whole corpus; without it the budget
    is the smallest at which every source is read at least once, so no row is lost.  With a
    smaller budget, rows of sources whose budget is below one epoch are left out: that is
    the mix.  Added columns: ``__tokens, __weight, __epoch`` (0 upwards), ``__block``,
    ``__block_order, __row_order``: reading epochs in order, blocks by ``__block_order`` and
    rows by ``__row_order`` gives the permutation.  A null source is a source of its own; null
    and empty texts weigh one token; an empty table gives an empty one.  Rows that repeat a
    doc_id share their place in the permutation.
    """
    base = docs.select(F.struct("*").alias("__doc"), F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("src"), word_tokens(F.col("text")).alias("tokens"))
    thin = cut(base.select("doc_id", "src", "tokens"))
    totals = cut(thin.groupBy("src").agg(F.sum("tokens").alias("total")))
    whole, n_sources = totals.agg(F.sum("total"), F.count("*")).first()
    shares = totals.withColumn("share", F.col("total") / F.lit(float(whole or 1)))
    alpha = temperature(shares.select("share"), repeat_limit, entropy_bits, budget_epochs)
    z, least = shares.agg(F.sum(F.pow("share", F.lit(alpha))), F.min(F.pow("share", F.lit(alpha)) / F.col("share"))).first()
    z, least = z or 1.0, least or 1.0
    budget = z / least if budget_epochs is None else budget_epochs
    plan = shares.select(
        "src", (F.pow("share", F.lit(alpha)) / z).alias("weight"), F.ceil(F.col("total") / block_tokens).alias("blocks"), "total",
        # a hair over one epoch is one epoch
        F.round(F.pow("share", F.lit(alpha)) / z * budget / F.col("share"), 9).alias("times"),
    )
    plan = cut(plan.select("src", "weight", "blocks", F.floor("times").alias("epochs"), ((F.col("times") - F.floor("times")) * F.col("total")).alias("part")))
    small = n_sources <= BROADCAST_SOURCES
    sized = F.broadcast(plan) if small else plan
    block = F.pmod(_order(seed, F.lit("deal"), "doc_id"), F.col("blocks"))
    dealt = thin.join(sized.filter("part > 0"), "src").select("doc_id", "src", "tokens", "epochs", block.alias("block"))
    cuts = _cuts(dealt, plan.filter("part > 0"), seed)
    full = cut(plan.join(cuts, "src", "left"))
    rows = base.join(F.broadcast(full) if small else full, "src").withColumn("block", block)
    bk = _order(seed, F.lit("block"), "epochs", "src", "block")
    rk = _order(seed, F.lit("row"), "epochs", "doc_id")
    extra = F.coalesce((bk < F.col("block_cut")) | ((bk == F.col("block_cut")) & (rk <= F.col("row_cut"))), F.lit(False))
    times = F.col("epochs") + extra.cast("long")
    copies = rows.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return copies.select(
        "__doc.*", F.col("tokens").alias("__tokens"), F.col("weight").alias("__weight"), F.col("epoch").alias("__epoch"), F.col("block").alias("__block"),
        _order(seed, F.lit("block"), "epoch", "src", "block").alias("__block_order"), _order(seed, F.lit("row"), "epoch", "doc_id").alias("__row_order"),
    )

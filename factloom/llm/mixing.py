"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed per cell of (source, language, topic). Cells are raked: for each margin in turn, weights
are scaled so that the margin's shares meet their targets, until all margins do. A document of a cell is then
kept with probability min(1, scale x weight), where the scale spends the token budget. The draw is a hash of seed and id,
the same on every run. Only sums per cell and margin are shuffled; documents stay where they are until the
join with their cell.

Targets: one (value, share) table per margin; shares are taken among the values that occur, and a value without a
target keeps weight zero. Without a table, a margin's target is its own share of tokens to the power `alpha`.
Margins that contradict each other on cells without documents do not converge; fitting ends when a round brings no margin nearer,
and every row says by its `gap` how far the worst margin is from its target.

Edge cases: a null source, language or topic is a value of its own. A null text has no tokens, and such rows follow their
cell's probability. Rows that share an id share its draw; a null id draws as the empty string. An empty table gives
an empty result. Further columns are kept; their names may clash with those used here.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import forget, written

_NULL = "\0null"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _shares(cells: DataFrame, margin: str, target: DataFrame | None, alpha: float) -> DataFrame:
    """(margin, `share`) over the values that occur; shares sum to one."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t"))
    if target is None:
        found = own.select(margin, F.pow("t", F.lit(alpha)).alias("share"))
    else:
        wanted = target.select(F.coalesce(F.col("value"), F.lit(_NULL)).alias(margin), F.col("share").cast("double"))
        found = own.where("t > 0").join(wanted, margin).select(margin, "share")
    total = found.agg(F.sum("share").alias("total"))
    total = total.first()[0] or 1.0
    return found.select(margin, (F.col("share") / F.lit(total)).alias("share"))


def fit(
    cells: DataFrame,
    margins: list[str],
    targets: dict[str, DataFrame] | None = None,
    alpha: float = 0.7,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Cells (margins, `tokens`) with a `weight` per token; raked tokens sum to one.

    Rounds go on until no margin is further than `tolerance` from its target, or until a round brings none of them nearer: targets
    that contradict each other cannot all be met. `gap` is the largest distance that is left.
    """
    targets = targets or {}
    shares = {m: written(_shares(cells, m, targets.get(m), alpha), "shares") for m in margins}
    now = written(cells.withColumn("weight", F.lit(1.0)), "cells")
    gap = before = float("inf")
    while gap >= tolerance:
        raked = now
        for margin in margins:
            have = raked.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            by = F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) / F.col("have")).otherwise(0.0)
            factor = have.join(shares[margin], margin, "left").select(margin, by.alias("by"))
            raked = raked.join(factor, margin).withColumn("weight", F.col("weight") * F.col("by")).drop("by")
        after = written(raked, "cells")
        forget(now)
        now = after
        # Raking one margin moves the others, so the largest gap of all of them says when to stop.
        gaps = []
        for margin in margins:
            have = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("have"))
            off = F.max(F.abs(F.col("have") - F.col("share")))
            gaps.append(have.join(shares[margin], margin).agg(off).first()[0])
        before, gap = gap, max((g for g in gaps if g is not None), default=0.0)
        if gap >= before * 0.999:
            break
    return now.withColumn("gap", F.lit(gap))


def scale_for(cells: DataFrame, budget: float, steps: int = 64, passes: int = 3) -> float:
    """The scale at which min(1, scale x weight) keeps the share `budget` of all tokens.

    Kept tokens are piecewise linear in the scale; each pass is one aggregate over a grid of scales, the next one over
    the gap that holds the answer, and the last gap is interpolated.
    """
    weighted = F.col("weight") > 0
    bounds = cells.agg(
        F.min(F.when(weighted, F.col("weight"))).alias("low"),
        F.max("weight").alias("high"),
        F.sum("tokens").alias("n"),
    ).first()
    if not bounds["n"] or not bounds["low"]:
        return 0.0
    want, low, high = budget * bounds["n"], 0.0, 1 / bounds["low"]
    for _ in range(passes):
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        kept = cells.agg(
            *(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(g))).alias(f"k{i}") for i, g in enumerate(grid))
        ).first()
        if kept[steps] <= want:
            return high
        at = next(i for i in range(steps + 1) if kept[i] > want)
        if at == 0:
            return low
        low, high = grid[at - 1], grid[at]
        a, b = kept[at - 1], kept[at]
    return low + (high - low) * (want - a) / (b - a)


def mix(
    docs: DataFrame,
    margins: dict[str, Column],
    targets: dict[str, DataFrame] | None = None,
    budget: float = 0.5,
    alpha: float = 0.7,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of `docs`, each with a struct `mix`: tokens, weight, probability, kept, and the `gap` the fit leaves.

    `margins` names columns of values; a document's weight is that of its cell.
    """
    tag = uuid.uuid4().hex[:8]
    names = {m: f"m{i}_{tag}" for i, m in enumerate(margins)}
    row = docs.withColumns(
        {names[m]: F.coalesce(c.cast("string"), F.lit(_NULL)) for m, c in margins.items()}
        | {f"n_{tag}": token_count(docs[text_col])}
    )
    keys = list(names.values())
    cells = written(row.groupBy(*keys).agg(F.sum(f"n_{tag}").alias("tokens")), "cells")
    fitted = fit(cells, keys, {names[m]: t for m, t in (targets or {}).items()}, alpha)
    scale = scale_for(fitted, budget)
    weights = fitted.select(*keys, F.col("weight").alias(f"w_{tag}"), F.col("gap").alias(f"gap_{tag}"))
    probability = F.least(F.lit(1.0), F.col(f"w_{tag}") * F.lit(scale))
    told = F.struct(
        F.col(f"n_{tag}").alias("tokens"),
        F.col(f"w_{tag}").alias("weight"),
        probability.alias("probability"),
        (draw(docs[id_col], seed) < probability).alias("kept"),
        F.col(f"gap_{tag}").alias("gap"),
    )
    return row.join(weights, keys).select(*docs.columns, told.alias("mix"))

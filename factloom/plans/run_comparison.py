"""Comparison of two runs as one plan: metrics, winners, recommendation, diff, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsontext, text
from factloom.operators import compare as C
from factloom.operators.ledger import PRICE, call_cost
from factloom.plans.page_flow import PageFlow, Stage
from factloom.schemas import ITEMS
from factloom.sources.prices import prices_of

RUNS = (C.RUN_A, C.RUN_B)


@dataclass(frozen=True)
class RunComparison:
    """Two extractions of the same pages, side by side in one row per page.

    `rows` hold `key` and, for each run r, r_found (items), r_shape, r_in_tok, r_seconds and r_there; every result is
    made of expressions over that row, without another join. `rates` are the (input, output) prices of both models.
    """

    rows: DataFrame
    key: str
    models: tuple[str, str]
    rates: tuple[tuple, tuple]

    @classmethod
    def of_runs(cls, a: DataFrame, b: DataFrame, key: str, models: tuple[str, str], prices: DataFrame) -> RunComparison:
        """Two stored runs (key, clean_html, items, shape): they meet once, by page; a page that one run lacks keeps its row."""
        sides = [side(rows, run, key) for rows, run in zip((a, b), RUNS)]
        return cls(sides[0].join(sides[1], key, "full_outer"), key, models, prices_of(prices, models))

    @classmethod
    def of_stages(
        cls, pages: DataFrame, flow: PageFlow, stages: tuple[Stage, Stage], key: str, models: tuple[str, str], prices: DataFrame
    ) -> RunComparison:
        """Two extraction stages over the same pages: a page is read, cleaned and profiled once, and never leaves its row."""
        rows = flow.hypotheses(pages).where("reason IS NULL")
        for run, stage in zip(RUNS, stages):
            found = stage(rows, flow.cfg)
            seconds = F.col("time_seconds") if "time_seconds" in found.columns else F.lit(0.0)
            new = {"found": F.col("items"), "shape": F.col("shape"), "in_tok": text.tokens(F.col("clean_html")), "seconds": seconds}
            kept = [c for c in rows.columns if c in found.columns]
            rows = flow.once(found.select(*kept, *(c.alias(f"{run}_{n}") for n, c in new.items())), f"{run}_found")
        return cls(rows.withColumns({f"{r}_there": F.lit(True) for r in RUNS}), key, models, prices_of(prices, models))

    def _measures(self, run: str) -> dict[str, Column]:
        """Counts and usage of one run, zero where it lacks the page."""
        items, there = F.col(f"{run}_found"), F.coalesce(F.col(f"{run}_there"), F.lit(False))
        rates = [F.lit(str(r)).cast(PRICE) for r in self.rates[RUNS.index(run)]]
        written = text.tokens(jsontext.items_json(items, F.col(f"{run}_shape")))
        usage = {
            "tokens_in": F.col(f"{run}_in_tok"),
            "tokens_out": written,
            "time_seconds": F.col(f"{run}_seconds").cast("double"),
            "cost": call_cost(F.col(f"{run}_in_tok"), written, *rates),
        }
        zero = {"avg_fields_per_item": F.lit(0.0), "time_seconds": F.lit(0.0)}
        found = {**C.item_counts(items), **usage}
        return {m: F.when(there, c).otherwise(zero.get(m, F.lit(0))) for m, c in found.items()}

    def metrics(self) -> DataFrame:
        """Per page and run: item and field counts, tokens, time and cost."""
        runs = [
            F.struct(F.lit(r).alias("run"), F.col(f"{r}_there").alias("there"), *(c.alias(m) for m, c in self._measures(r).items()))
            for r in RUNS
        ]
        return self.rows.select(self.key, F.inline(F.array(*runs))).where("there").drop("there")

    def verdicts(self) -> DataFrame:
        """Per page: both runs side by side, the winner per metric, and what to use."""
        measures = {f"{r}_{m}": c for r in RUNS for m, c in self._measures(r).items()}
        firsts = {f"{r}__first": F.get(f"{r}_found", F.lit(0)) for r in RUNS}
        return C.recommendation(C.winners(self.rows.withColumns({**measures, **firsts})))

    def diff(self) -> DataFrame:
        """Every field of every item of either run."""
        return C.field_diff(self.rows, F.col("a_found"), F.col("b_found"), [self.key])

    def field_names(self) -> DataFrame:
        """Union of the field names the two runs use for a page."""
        names = F.array_union(*(C.field_names(F.col(f"{r}_found")) for r in RUNS))
        return self.rows.select(self.key, F.explode(names).alias("field"))

    def reports(self, originals: DataFrame | None = None) -> DataFrame:
        """Markdown report per page, showing the diff of its first items; names of pages come from their rows or from `originals`."""
        done = self.verdicts().withColumn("sample", C.item_diff(F.col("a__first"), F.col("b__first")))
        if originals is not None:
            done = done.join(originals, self.key, "left")
        data = {f"{r}_data": jsontext.items_json(F.col(f"{r}_found"), F.col(f"{r}_shape")) for r in RUNS}
        return C.comparison_markdown(done.withColumns(data), *self.models, F.col("original_file"))


def side(rows: DataFrame, run: str, key: str) -> DataFrame:
    """One run's columns of a comparison. Tokens read are estimated from `clean_html`, seconds come from `time_seconds`."""
    seconds = F.col("time_seconds") if "time_seconds" in rows.columns else F.lit(0.0)
    new = {
        "found": F.col("items").cast(ITEMS),
        "shape": F.col("shape"),
        "in_tok": text.tokens(F.col("clean_html")),
        "seconds": seconds,
        "there": F.lit(True),
    }
    return rows.select(key, *(c.alias(f"{run}_{n}") for n, c in new.items()))

"""The flow of a page: admit, clean, profile, extract, render, validate, name, report.

With the built-in rules the whole flow is one narrow plan: each page stays in its row, nothing is
shuffled, and a lost task is redone from its input split alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.config import EngineConfig
from factloom.operators.clean import clean_pages, computed_once
from factloom.operators.extract import extract_items
from factloom.operators.naming import name_reports
from factloom.operators.profile import profile_pages
from factloom.operators.render import render_items
from factloom.operators.report import make_reports
from factloom.operators.structured import read_structured
from factloom.operators.validate import validate_pages

Stage = Callable[[DataFrame, EngineConfig], DataFrame]


@dataclass(frozen=True)
class PageFlow:
    """Runs pages through the stages. Any stage may be swapped for another DataFrame function that
    adds the same columns (and `<stage>_in_tok` / `<stage>_out_tok` where it knows its usage)."""

    cfg: EngineConfig = field(default_factory=EngineConfig)
    profile: Stage = profile_pages
    extract: Stage = extract_items
    render: Stage = render_items
    validate: Stage = validate_pages

    def clean(self, pages: DataFrame) -> DataFrame:
        return clean_pages(pages, self.cfg)

    def profiled(self, pages: DataFrame) -> DataFrame:
        """Clean pages with their hypothesis; the pass that cleans a page also finds its blocks."""
        return self.profile(read_structured(clean_pages(pages, self.cfg, mined=True)), self.cfg)

    def once(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The same rows, with these columns computed once however often they are read."""
        return computed_once(rows, {c: F.col(c) for c in columns})

    def hypotheses(self, pages: DataFrame) -> DataFrame:
        """Profiled pages, as extraction stages take them."""
        return self.once(self.profiled(pages), "hypothesis")

    def extracted(self, pages: DataFrame) -> DataFrame:
        """Pages with hypothesis, items and shape, each computed once however often it is read."""
        found = self.extract(self.hypotheses(pages), self.cfg)
        return self.once(found.drop("structured", "blocks"), "items", "shape")

    def validated(self, pages: DataFrame) -> DataFrame:
        done = self.validate(self.render(self.extracted(pages), self.cfg), self.cfg)
        return computed_once(done, {"status": F.col("status"), "validation": F.col("validation")})

    def named(self, pages: DataFrame, processed_at: Column) -> DataFrame:
        """Validated pages with the names and the destination of their reports."""
        done = self.validated(pages).withColumn("processed_at", processed_at)
        named = name_reports(done, self.cfg)
        return computed_once(named, {"base_name": F.col("base_name")})

    def reports(self, pages: DataFrame, processed_at: Column) -> DataFrame:
        """The finished page rows. `processed_at` is the time that reports and ledger carry."""
        return make_reports(self.named(pages, processed_at), self.cfg)


def partition_stage(
    run: Callable[[pd.DataFrame], pd.DataFrame], added: str, reads: tuple[str, ...]
) -> Stage:
    """A stage made of a pandas function that runs on Arrow batches inside the tasks.

    `run` gets a batch of the `reads` columns and returns the `added` columns (a DDL string) row by
    row in the same order; a client for a hosted model is opened there, once per batch. Only the
    columns it reads are sent to Python; the page's other columns stay in the JVM row.
    """
    schema = T._parse_datatype_string(added)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield run(part)

    udf = F.pandas_udf(batches, schema)  # struct of columns in, struct of columns out

    def stage(df: DataFrame, cfg: EngineConfig) -> DataFrame:
        result = computed_once(df.withColumn("_in", F.struct(*reads)), {"_out": udf(F.col("_in"))})
        new = {f.name: F.col("_out")[f.name] for f in schema.fields}
        return result.withColumns(new).drop("_in", "_out")

    batches.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return stage

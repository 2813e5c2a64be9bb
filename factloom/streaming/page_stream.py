"""Pages as they arrive: run through the flow, written to all tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.ledger import price_usage, stage_usage
from factloom.plans.page_flow import PageFlow
from factloom.session import shared_dir
from factloom.sinks import tables
from factloom.sources.prices import price_list

PAGE_COLUMNS = ("page_id", "path", "original_file", "url", "size_bytes", "html")


def process_batch(pages: DataFrame, batch_id: int | str, root: str, flow: PageFlow) -> None:
    """Run one batch and write it.

    The finished rows are written once and read back: the other tables neither repeat the flow nor
    depend on cached blocks that a lost executor would take along.
    """
    spark = pages.sparkSession
    reports = flow.reports(pages, F.col("arrived_at"))
    kept = reports.select(*[c for c in reports.columns if c not in ("arrived_at", "dominance")])
    finished = spark.read.schema(kept.schema).parquet(tables.write_finished(kept, root, batch_id))
    tables.write_reports(finished, root, batch_id)
    tables.write_debug(finished, root, batch_id)
    tables.write_log(finished, root, batch_id)
    priced = price_usage(stage_usage(finished, flow.cfg), price_list(spark, flow.cfg))
    tables.write_ledger(priced, root, batch_id)


def start_page_stream(
    pages: DataFrame,
    root: str,
    flow: PageFlow = PageFlow(),
    checkpoint: str | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
    name: str = "page_stream",
) -> StreamingQuery:
    """Start the stream. A file source yields each path once, whatever its time stamp, so nothing is shuffled or
    dropped on the way. Errors of a page are data (`reason`, status), so no page stops it.

    The checkpoint goes below the folder named in `spark.checkpoint.dir`, or below `root`; it belongs
    to this name and this output, so another output starts afresh.
    """
    shared = shared_dir(pages.sparkSession)
    output = hashlib.sha256(root.encode()).hexdigest()[:16]
    location = checkpoint or os.path.join(shared or root, f"_{name}_{output}")
    writer = (
        pages.writeStream.queryName(name)
        .option("checkpointLocation", location)
        .foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, root, flow))
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()

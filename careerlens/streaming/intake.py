"""Page intake as a stream: the batch scan inside ``foreachBatch``."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from careerlens.lexicon import LinkPolicy
from careerlens.operators import store
from careerlens.operators.dedup import dedup_by_url
from careerlens.plans import keyword_scan, scored_flow
from careerlens.session import checkpoint_root

# A scan turns a batch of pages into rows with company, title, url,
# matched_keywords and an order (page_id, pos).
Scan = Callable[[DataFrame], DataFrame]


def keyword_scan_of(targets: DataFrame, policy: LinkPolicy = LinkPolicy(), context: bool = True) -> Scan:
    """Keyword scan of pages(page_id, site, url, html) for targets(site, company, keywords)."""

    def run(pages: DataFrame) -> DataFrame:
        mine = keyword_scan.pages_of_targets(pages.withColumnRenamed("url", "page_url"), targets)
        matcher = keyword_scan.context_matches if context else keyword_scan.native_matches
        return matcher(mine, policy)

    return run


def process_batch(pages: DataFrame, run_id: str, root: str, scan: Scan, found: Column,
                  targets: DataFrame | None = None, missing: str | None = "no page landed") -> None:
    """Scan one batch, insert what is new, write alerts and run log.

    Everything is written under ``run_id``; repeating the call with the same
    batch and id replaces its own output and nothing else. ``targets(site, company)``
    names the companies of the log; without it a site is its own company. Companies without a page in the batch get an
    error row with the text ``missing``, or none where a batch is but a part of a run (``missing=None``).
    """
    spark = pages.sparkSession
    matches = scan(pages)
    unique = dedup_by_url(matches, ["page_id", "pos"])
    rows = store.as_postings(unique, found, matched=F.col("matched_keywords"))
    inserted = store.insert_run(spark, root, rows, run_id)
    store.write_alerts(store.alert_messages(inserted, F.col("date_found")), root, run_id)
    outcomes = keyword_scan.fetch_outcomes(pages)
    if targets is None:
        targets = outcomes.select("site", F.col("site").alias("company"))
    store.log_runs(keyword_scan.run_rows(targets, outcomes, inserted, found, missing), root, run_id)


def start_intake(pages: DataFrame, root: str, scan: Scan, name: str = "intake",
                 found: Column | None = None, checkpoint: str | None = None,
                 targets: DataFrame | None = None) -> StreamingQuery:
    """Process every landed page once and stop (run it from a scheduler).

    The checkpoint lies in the folder the cluster names in
    ``spark.checkpoint.dir`` unless one is given.
    """
    stamp = F.current_timestamp() if found is None else found
    where = checkpoint or f"{checkpoint_root(pages.sparkSession)}/{name}"

    def step(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, f"{name}-{batch_id:08d}", root, scan, stamp, targets, missing=None)

    return (pages.writeStream.queryName(name).foreachBatch(step)
            .option("checkpointLocation", where).trigger(availableNow=True).start())


# ------------------------------------------------------------- scored intake

def process_scored_batch(pages: DataFrame, run_id: str, root: str, details: DataFrame, profile: DataFrame, found: Column,
                         policy: scored_flow.FlowPolicy = scored_flow.FlowPolicy(),
                         extract: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Scan one batch of landed pages of all kinds and store its matches; returns the counts of the insert.

    ``pages`` has kind, page_id, company, source_no, url and html: pages of kind ``sites`` go through ``extract`` (records
    with company, title, url, text, source_no, ord), those of the kinds of ``policy.listings`` are searched for links
    whose detail pages are in ``details(url, html, embedding)``. Repeating the call replaces its own output.
    """
    spark = pages.sparkSession
    number = itertools.count()
    unseen = lambda rows: store.drop_stored(spark, root, rows, run_id, f"phase-{next(number)}")
    records = None if extract is None else extract(pages.where("kind = 'sites'"))
    listings = {kind: pages.where(F.col("kind") == kind).withColumnRenamed("url", "page_url") for kind in policy.listings}
    matches = scored_flow.scan_matches(records, listings, details, unseen, profile, policy)
    inserted, counts = scored_flow.save_scan(matches, root, run_id, found)
    alerts = inserted.withColumn("matched_keywords", F.array(F.format_string("Semantic Match: %.2f", "match_score")))
    store.write_alerts(store.alert_messages(alerts, F.col("date_found")), root, run_id)
    return counts


def start_scored_intake(sources: Mapping[str, DataFrame], root: str, details: DataFrame, profile: DataFrame,
                        name: str = "scored", found: Column | None = None, checkpoint: str | None = None,
                        policy: scored_flow.FlowPolicy = scored_flow.FlowPolicy(),
                        extract: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """One query over the landed pages of several sources (by kind), stored batch by batch; stops when all is read."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in sources.items()]
    pages = functools.reduce(DataFrame.unionByName, parts)
    stamp = F.current_timestamp() if found is None else found
    where = checkpoint or f"{checkpoint_root(pages.sparkSession)}/{name}"

    def step(batch: DataFrame, batch_id: int) -> None:
        process_scored_batch(batch, f"{name}-{batch_id:08d}", root, details, profile, stamp, policy, extract)

    return (pages.writeStream.queryName(name).foreachBatch(step)
            .option("checkpointLocation", where).trigger(availableNow=True).start())

"""The control table of asynchronous copies: status, claims under a lease, recovery of stalled ones, aborting.

One row a copy: id, revision_id, table_id, status, copied_rows, total_rows, owner, heartbeat_at and created_at in
milliseconds, error. Functions give the table after a step, so that a writer can swap it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.streaming.copy import ACTIVE, MOVES

SCHEMA = "id string, revision_id string, table_id string, status string, copied_rows long, total_rows long, owner string, heartbeat_at long, created_at long, error string"


def progress() -> Column:
    return F.when(F.col("total_rows") > 0, F.col("copied_rows") * 100 / F.col("total_rows")).otherwise(F.lit(0.0)).cast("double")


def status_of(control: DataFrame, revision_id: str, table_id: str) -> DataFrame:
    """The copy of a table in a revision with its progress in percent; no row if there is none."""
    return control.filter((F.col("revision_id") == revision_id) & (F.col("table_id") == table_id)).withColumn("percentage", progress())


def active(control: DataFrame, revision_id: str) -> DataFrame:
    """Copies of a revision that haven't ended."""
    return control.filter((F.col("revision_id") == revision_id) & F.col("status").isin(*ACTIVE)).withColumn("percentage", progress())


def stalled(now: int, lease: int) -> Column:
    """Whether an active copy's owner has let its lease run out."""
    return F.col("status").isin(*ACTIVE) & F.col("owner").isNotNull() & (F.coalesce("heartbeat_at", F.lit(0)) + lease < now)


def recover(control: DataFrame, now: int, lease: int) -> DataFrame:
    """Stalled copies are cancelled while they copy; a stalled swap is never undone but left for another worker."""
    late = F.coalesce(stalled(now, lease), F.lit(False))
    swapping = F.col("status") == "SWAPPING"
    return control.withColumns({
        "owner": F.when(late, None).otherwise(F.col("owner")), "error": F.when(late & ~swapping, "stalled").otherwise(F.col("error")), "status": F.when(late & ~swapping, "CANCELLED").otherwise(F.col("status")),
    })


def claim(control: DataFrame, worker: str, now: int) -> DataFrame:
    """The oldest active copy without an owner, as the worker's; a worker that has one gets no other."""
    if not control.filter(F.col("status").isin(*ACTIVE) & (F.col("owner") == worker)).isEmpty():
        return control
    free = control.filter(F.col("status").isin(*ACTIVE) & F.col("owner").isNull()).orderBy("created_at", "id").select("id").first()
    mine = F.col("id") == F.lit(free[0] if free else None)
    mine = F.coalesce(mine, F.lit(False))
    return control.withColumns({
        "owner": F.when(mine, worker).otherwise(F.col("owner")), "heartbeat_at": F.when(mine, F.lit(now).cast("long")).otherwise(F.col("heartbeat_at")),
        "status": F.when(mine & (F.col("status") == "PENDING"), "COPYING").otherwise(F.col("status")),
    })


def beat(control: DataFrame, worker: str, now: int, copied: int | None = None) -> DataFrame:
    """The worker's lease prolonged, and its progress."""
    mine = F.coalesce(F.col("owner") == worker, F.lit(False))
    rows = F.col("copied_rows") if copied is None else F.when(mine, F.lit(copied).cast("long")).otherwise(F.col("copied_rows"))
    return control.withColumns({"heartbeat_at": F.when(mine, F.lit(now).cast("long")).otherwise(F.col("heartbeat_at")), "copied_rows": rows})


def can_abort() -> Column:
    """Whether a copy may be given up: not while it swaps, nor when it has ended."""
    return F.col("status").isin(*[s for s, to in MOVES.items() if "CANCELLED" in to])


def abort(control: DataFrame, copy_id: str) -> DataFrame:
    here = F.col("id") == copy_id
    if control.filter(here & can_abort()).isEmpty():
        raise ValueError(f"{copy_id} can't be given up")
    return control.withColumn("status", F.when(here, "CANCELLED").otherwise(F.col("status")))

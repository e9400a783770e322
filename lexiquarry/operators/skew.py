"""Per-key results over tables in which a few keys hold most rows.

Rows are range partitioned on the composite (key, record, position) by sampled
quantiles, so a heavy key is cut into as many partitions as its share of the rows
asks for; no task ever holds a whole heavy key. A counter behind the position lets
even one row that is repeated without end be cut. Each partition is sorted and
reduced in one pass to

* one *partial state* per key of the partition, made of the runs (key, record)
  that lie inside it, and
* the first and the last run of the partition, the only ones that a cut can have
  split; these *boundary runs* carry their first and last position and are stitched:
  positions inside are summed, those at the ends counted once.

Partial states and stitched runs are then merged per key. What is shuffled after
the range partitioning is one row per key and partition, plus two per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.workspace import size_of

_PARTIAL = "k string, r long, occurrences long, records long, max_in_record long, first long, last long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce one sorted partition; ``r``, ``first`` and ``last`` are set only on the two boundary runs."""
    schema = pa.schema([("k", pa.string()), *((name, pa.int64()) for name in ("r", "occurrences", "records", "max_in_record", "first", "last"))])
    last: tuple | None = None  # the last row seen
    run, opened = 0, 0  # distinct positions in the open run, and its first one
    state: list | None = None  # of the open key: [occurrences, records, max]
    first_done = False

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*((*x, None, None)[:7] for x in rows)), schema)], schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k, r, p = (batch.column(i) for i in range(3))
        r_np, p_np = r.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False)
        new_key, new_run, new_row = (np.ones(n, bool) for _ in range(3))
        if n > 1:
            new_key[1:] = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_run[1:] = new_key[1:] | (r_np[1:] != r_np[:-1])
            new_row[1:] = new_run[1:] | (p_np[1:] != p_np[:-1])
        head = (k[0].as_py(), int(r_np[0]), int(p_np[0]))
        if last is not None:
            new_key[0] = head[0] != last[0]
            new_run[0] = new_key[0] or head[1] != last[1]
            new_row[0] = new_run[0] or head[2] != last[2]
        starts = np.flatnonzero(new_run)
        edges = np.append(starts, n)
        before = int(new_row[: edges[0]].sum())  # continues the open run
        counts = np.add.reduceat(new_row.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        run += before
        rows: list[tuple] = []
        if len(starts):
            # Close the open run, then all runs but the last of this batch.
            if last is not None:
                if not first_done:
                    rows.append((last[0], last[1], run, 1, run, opened, int(p_np[starts[0] - 1]) if starts[0] else last[2]))
                    first_done = True
                else:
                    state = state or [0, 0, 0]
                    state = [state[0] + run, state[1] + 1, max(state[2], run)]
            inner = slice(0, len(starts) - 1)
            in_counts, in_starts = counts[inner], starts[inner]
            if last is None and len(in_starts):  # the partition's first run is closed within this batch
                rows.append((head[0], head[1], int(in_counts[0]), 1, int(in_counts[0]), head[2], int(p_np[starts[1] - 1])))
                first_done = True
                in_counts, in_starts = in_counts[1:], in_starts[1:]
            # The key of each closed run: groups of equal keys are contiguous.
            key_no = np.cumsum(new_key) - 1 + (0 if new_key[0] else 1)  # 0: the key that was open before, if it goes on
            if last is not None and new_key[0] and state:
                rows.append((last[0], None, *state))
                state = None
            open_no = int(key_no[-1])
            if len(in_starts):
                run_key = key_no[in_starts]
                cut = np.flatnonzero(np.append(True, run_key[1:] != run_key[:-1]))
                occ, rec, most = np.add.reduceat(in_counts, cut), np.diff(np.append(cut, len(run_key))), np.maximum.reduceat(in_counts, cut)
                for j, c in enumerate(cut):
                    own = [int(occ[j]), int(rec[j]), int(most[j])]
                    no = int(run_key[c])
                    if state and no == 0 and not new_key[0]:
                        own = [state[0] + own[0], state[1] + own[1], max(state[2], own[2])]
                        state = None
                    elif state and not new_key[0]:
                        rows.append((last[0], None, *state))
                        state = None
                    if no == open_no:
                        state = own
                    else:
                        rows.append((k[int(in_starts[c])].as_py(), None, *own))
            if state and last is not None and open_no != 0 and not new_key[0] and not len(in_starts):
                rows.append((last[0], None, *state))
                state = None
            run, opened = int(counts[-1]), int(p_np[starts[-1]])
        last = (k[n - 1].as_py(), int(r_np[-1]), int(p_np[-1]))
        if rows:
            yield emit(rows)
    if last is not None:
        rows = [(last[0], last[1], run, 1, run, opened, last[2])]
        if state:
            rows.append((last[0], None, *state))
        yield emit(rows)


#: Parts that a single row repeated without end can be cut into.
CUTS = 1024
#: Bytes of the table for each range partition, where that asks for more partitions than the session's setting.
PARTITION_BYTES = 32 << 20


def _range_partitions(df: DataFrame) -> int | None:
    """How many range partitions the size of a table asks for; None if the session's setting is enough."""
    wanted = -(-(size_of(df) or 0) // PARTITION_BYTES)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def key_states(df: DataFrame, key: str, record: str, position: str, partitions: int | None = None) -> DataFrame:
    """Per key: distinct (record, position) pairs, distinct records, and the most positions of one record.

    Returns (key STRING, occurrences LONG, records LONG, max_in_record LONG), one row per key.
    Rows with a null in any of the three columns don't count; repeated rows count once; an
    empty table gives no rows. Other columns of ``df`` are ignored, whatever their names.
    ``partitions``: of the range partitioning; if not given, Spark's shuffle setting
    (coalesced at run time), or more where the size of the table asks for it.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(record).cast("long").alias("r"), F.col(position).cast("long").alias("p")).dropna()
    partitions = partitions or _range_partitions(rows)
    numbered = rows.withColumn("c", (F.shiftright(F.monotonically_increasing_id(), 8) % CUTS).cast("short"))  # the same for neighbours, so it packs well
    order = ("k", "r", "p", "c")
    ranged = numbered.repartitionByRange(partitions, *order) if partitions else numbered.repartitionByRange(*order)
    partial = ranged.select("k", "r", "p").sortWithinPartitions("k", "r", "p").mapInArrow(_runs, _PARTIAL)
    # Runs with r are stitched across partitions: a run's inner positions are its own, those at its ends may be another's too.
    # A run has as many rows as partitions hold a part of it. The rest has r null and is summed as it is.
    boundary = F.col("r").isNotNull()
    inner = F.col("occurrences") - F.when(boundary, F.when(F.col("first") == F.col("last"), 1).otherwise(2)).otherwise(0)
    ends = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(boundary, F.array("first", "last"))))))
    sums = partial.groupBy("k", "r").agg((F.sum(inner) + ends).alias("occurrences"), F.sum("records").alias("records"), F.max("max_in_record").alias("max_in_record"))
    stitched = sums.select(
        "k", "occurrences", F.when(boundary, F.lit(1)).otherwise(F.col("records")).alias("records"), F.when(boundary, F.col("occurrences")).otherwise(F.col("max_in_record")).alias("max_in_record")
    )
    return stitched.groupBy(F.col("k").alias(key)).agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("max_in_record").alias("max_in_record")
    )


def heavy_keys(states: DataFrame, key: str, one_in: int) -> DataFrame:
    """Keys that hold at least one in ``one_in`` of all occurrences. ``states`` should be materialized: it is read twice."""
    total = states.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n")).first()["n"]
    return states.filter(F.col("occurrences") * F.lit(one_in) >= F.lit(total)).select(key)

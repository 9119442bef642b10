"""Helpers shared by the operators of this subpackage.

Conventions: an operator selects the columns it needs under its own names
before doing anything else, so extra or clashing input columns are harmless.
Intermediate tables that are read more than once are written to the shared
checkpoint folder, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.session import checkpoint_dir

# Words are maximal runs of anything but space and the control characters 9..13.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small tables and loop state (cleaned up by Spark itself)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold_bucket(*cols: Column, buckets: int) -> Column:
    """CRC-32 of the id as text, modulo ``buckets``: the hold-out rule of the contracts."""
    return F.crc32(F.encode(cols[0].cast("string"), "UTF-8")) % F.lit(buckets)


def held_out(id_col: Column, buckets: int) -> Column:
    """Remainder 0 is held out; a null id belongs to no fold and is never trained on."""
    return F.coalesce(fold_bucket(id_col, buckets=buckets) == 0, F.lit(True))


def left_join_salted(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join on a key that may hold a third of the rows of ``left``.

    ``right`` has one row per key and holds only the keys that matter, so
    repeating it ``salts`` times is cheap; ``left`` is dealt by (key, salt).
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def text_slices(batches: Iterable[pa.RecordBatch], column: str, max_chars: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded text (a single longer text is a slice of its own)."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def of_texts(kind: str, fn, max_chars: int = 500_000, rows: int = 1 << 30):
    """Column function of a text column: ``fn`` turns a list of texts into a numpy array of values.

    Only the text goes to Python and only the value comes back; the other columns stay where they are.
    """
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            got = []
            for part in text_slices([pa.RecordBatch.from_arrays([column], ["t"])], "t", max_chars):
                for s in range(0, part.num_rows, rows):
                    got.append(np.asarray(fn(part.slice(s, rows).column("t").to_pylist())))
            yield pa.array(np.concatenate(got)) if got else pa.array([], pa.null())

    return F.arrow_udf(run, kind)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Re-cut a key-sorted stream of batches so that no key is divided between two chunks.

    Yields dicts of numpy columns plus ``_group`` (0, 1, 2, ... within the chunk).
    Binary columns come as Arrow arrays.
    """
    tail: pa.Table | None = None

    def columns(table: pa.Table) -> dict:
        out = {}
        for name in table.column_names:
            col = table.column(name).combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
            out[name] = col if pa.types.is_binary(col.type) or pa.types.is_list(col.type) else col.to_numpy(zero_copy_only=False)
        return out

    def change(cols: dict, n: int) -> np.ndarray:
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        return new

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if tail is not None:
            table = pa.concat_tables([tail, table])
        cols = columns(table.select(keys))
        new = change(cols, table.num_rows)
        last = int(np.flatnonzero(new)[-1])
        if last:
            done = columns(table.slice(0, last))
            done["_group"] = np.cumsum(new[:last]) - 1
            yield done
        tail = table.slice(last)
    if tail is not None:
        done = columns(tail)
        done["_group"] = np.zeros(tail.num_rows, np.int64)
        yield done


def pairs_in_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs (i, j), i < j, of equal group, in slabs; nothing is held but one slab."""
    n = len(group)
    if n == 0:
        return
    end = np.searchsorted(group, group, side="right")
    live = np.flatnonzero(end - np.arange(n) > 1)
    k = 1
    while len(live):
        yield live, live + k
        k += 1
        live = live[live + k < end[live]]


class Forest:
    """Minimum-label union of positions 0..n-1, fed with arrays of linked positions."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            live = a != b
            if not live.any():
                break
            i, j, a, b = i[live], j[live], a[live], b[live]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:  # point every position at its root
                root = label[label]
                if (root == label).all():
                    break
                label[:] = root

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, root) of every position that is not its own root."""
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]

"""SNK-01 / SNK-02: writing model snapshots and appending the outbox.

The reference's B-tree indexes become file layout.

* district, department, status: complaints are partitioned by year and
  clustered by the interleaved bits of the three (a space-filling curve), so a
  filter on any of them, not only on the first, finds its rows in few files and
  row groups and skips the others by their min/max statistics.
* complaint number, citizen phone: point lookups in columns that no sort serves;
  parquet Bloom filters let the scan skip the row groups without the value.
* timeline by complaint: range-partitioned and sorted by complaint, so lookups
  by complaint read few files.

Range (not hash) partitioning samples the key distribution, so one hot year or
complaint is split over several files instead of landing in one task.

On disk at once are the files and the shuffle files of one write: those of a
table go when it is written, and the descriptions of a large table move and are
written in turns, each with the texts of its own share of the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.functions.expr import status_ordinal
from civiccases.session import freed_shuffles
from civiccases.sources.model import SCHEMAS, STATUSES, TABLES, Model
from civiccases.sources.scratch import CODEC, Scratch

#: bits of each clustered column
CLUSTER_BITS = 10
#: point lookups: table -> columns with a Bloom filter
LOOKUP_COLUMNS = {"complaints": ["complaint_no"], "citizens": ["phone"]}
#: sizes of filter that a row group chooses from by its distinct values: 1 MB, halved each time
LOOKUP_SIZES = 10
#: complaints whose descriptions move at once; those of more go in so many turns
TURN_ROWS, TURNS = 1_000_000, 16
#: of the compression: written once, kept and read for long
CODEC_LEVEL = 6


def interleaved(*numbers: Column, bits: int = CLUSTER_BITS) -> Column:
    """The bits of numbers below 2^bits, taken in turn from the highest down; NULL counts as 0, more as the largest."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for number in numbers:
            capped = F.least(F.coalesce(number.cast("long"), F.lit(0)), F.lit((1 << bits) - 1))
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(capped, bit).bitwiseAND(F.lit(1).cast("long")))
    return out


def cluster_key(m: Model) -> Column:
    """District, department and status interleaved, each spread over all bits so that the first ones halve its domain."""
    def spread(number: Column, dimension: DataFrame | None, most: int = 0) -> Column:
        top = most if dimension is None else dimension.agg(F.max("id")).first()[0] or 0  # one number of a dimension
        return F.floor(number * F.lit(1 << CLUSTER_BITS) / F.lit(top + 1))

    return interleaved(spread(F.col("district_id"), m.districts), spread(F.col("department_id"), m.departments),
                       spread(status_ordinal(), None, len(STATUSES) - 1))


def _turns(m: Model, scratch: Scratch) -> Iterator[DataFrame]:
    """The complaints, in parts that are all of them together: by the key of the texts, where these are a table of their own.

    A part joins its share of the texts only, whatever the number of complaints of each: the filter on the complaints'
    key holds for the texts' as well, below their exchange.
    """
    key = m.extra.get("described_by")
    if key is None or m.rows("complaints") <= TURN_ROWS:
        yield m.complaints
        return
    rows, described = m.brief()
    turn = F.pmod(F.xxhash64(key), F.lit(TURNS)).cast("int")
    rows = scratch.keep(rows, _turn=turn)  # numbered once
    for i in range(TURNS):
        yield described(rows.where((F.col("_turn") == i) & (turn == i)).drop("_turn"))


def write_snapshot(m: Model, out_dir: str, files_hint: int | None = None) -> str:
    """Write every table of the snapshot under ``out_dir``; what an earlier snapshot left there is replaced."""
    # Without a file count the range exchange is left to AQE, which coalesces
    # neighbouring ranges up to the advisory partition size: few files for a
    # small table, many evenly sized ones for a large one.
    def by_range(df, *cols):
        return df.repartitionByRange(files_hint, *cols) if files_hint else df.repartitionByRange(*cols)

    def write(name: str, df: DataFrame, mode: str = "overwrite", last: bool = True) -> None:
        # static: a rewrite leaves no year of an earlier snapshot, whatever the session's mode
        out = df.write.mode(mode).option("partitionOverwriteMode", "static").option("compression", CODEC)
        out = out.option("parquet.compression.codec.zstd.level", str(CODEC_LEVEL))
        for column in LOOKUP_COLUMNS.get(name, []):
            out = (out.option(f"parquet.bloom.filter.enabled#{column}", "true")
                   .option("parquet.bloom.filter.adaptive.enabled", "true")
                   .option("parquet.bloom.filter.candidates.number", str(LOOKUP_SIZES)))
        if not last:  # the table is marked complete by its last part
            out = out.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        (out.partitionBy("created_year") if name == "complaints" else out).parquet(f"{out_dir}/{name}")

    spark = m.complaints.sparkSession
    with freed_shuffles(spark):
        for name in TABLES:
            if name == "complaints":  # the largest, when the others' shuffle files are gone
                continue
            scratch = Scratch(spark, name)
            df = m.made(name, scratch.keep).select(*[f.name for f in SCHEMAS[name]])
            if name == "citizens":
                df = by_range(df, "id").sortWithinPartitions("id")
            elif name in ("timeline", "attachments", "notifications"):
                df = by_range(df, "complaint_id", "id").sortWithinPartitions("complaint_id", "id")
            write(name, df)
            scratch.drop()
        scratch, cell, before = Scratch(spark, "snapshot"), cluster_key(m), None
        for df in _turns(m, scratch):
            df = df.select(*[f.name for f in SCHEMAS["complaints"]])
            # the range exchange is the only one that moves the descriptions (``Model.brief``);
            # the year leads the sort as well, which is the order that the partitioned writer asks for
            df = df.withColumns({"created_year": F.year("created_at"), "_cell": cell})
            df = (by_range(df, "created_year", "_cell", "id")
                  .sortWithinPartitions("created_year", "_cell", "created_at").drop("_cell"))
            if before is not None:
                write("complaints", *before, last=False)
            before = df, "overwrite" if before is None else "append"
        write("complaints", *before)
        scratch.drop()
    return out_dir


def append_outbox(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append notification rows; with a batch id the write is idempotent (a replay overwrites its folder)."""
    if batch_id is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

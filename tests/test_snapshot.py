"""SNK-01's layout serves the lookups that indexes served: files and row groups without the value are skipped."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civiccases.operators import lookups
from civiccases.sources import adapter, sinks
from civiccases.sources.model import filed_between, load_model
from civiccases.streaming.streams import run_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    """A snapshot in many small files."""
    m = adapter.load_testdata_model(spark, SF)
    out = sinks.write_snapshot(m, run_dir(spark, "test-layout"), files_hint=150)
    return m, load_model(spark, out, m.as_of), out


def scanned(df, table: str) -> int:
    """Rows that the scan of one table gave to the plan."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet") and f"/{table}" in node.toString():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert found
    return sum(found)


def test_interleaved_bits(spark):
    got = spark.createDataFrame([(5, 3), (0, None), (9, 1)], "a long, b long").select(
        sinks.interleaved(F.col("a"), F.col("b"), bits=3).alias("z")).collect()
    assert [r["z"] for r in got] == [0b100111, 0, 0b101011]


def test_number_lookup_skips_row_groups(spark, stored):
    m, back, _ = stored
    total = back.complaints.count()
    number = m.complaints.orderBy("id").first()["complaint_no"]
    one = back.complaints.where(F.col("complaint_no") == number).select("id")
    assert one.count() == 1 and scanned(one, "complaints") < total / 4
    assert scanned(back.complaints.where(F.col("complaint_no") == number[:-1] + "x").select("id"), "complaints") < total / 10


def test_phone_lookup_skips_row_groups(spark, stored):
    m, back, _ = stored
    phone = m.citizens.first()["phone"]
    assert back.citizens.where(F.col("phone") == phone).count() == m.citizens.where(F.col("phone") == phone).count()
    assert scanned(back.citizens.where(F.col("phone") == phone + "0").select("id"), "citizens") == 0


@pytest.mark.parametrize("column,value", [("district_id", 3), ("department_id", 2), ("status", "resolved")])
def test_each_clustered_column_skips_rows(spark, stored, column, value):
    m, back, _ = stored
    rows = back.complaints.where(F.col(column) == value).select("id")
    assert rows.count() == m.complaints.where(F.col(column) == value).count()
    assert scanned(rows, "complaints") < 0.8 * back.complaints.count()


def test_years_are_pruned(spark, stored):
    from datetime import datetime
    m, back, out = stored
    start, end = datetime(1997, 3, 1), datetime(1998, 2, 1)
    got = filed_between(back.complaints, start, end)
    assert got.count() == filed_between(m.complaints, start, end).count() > 0
    assert "PartitionFilters: [isnotnull(created_year" in got._jdf.queryExecution().executedPlan().toString()
    # what was written comes back whole and typed, and a rewrite replaces it
    assert sorted(map(str, back.complaints.drop("created_year").collect())) == sorted(map(str, m.complaints.collect()))
    assert lookups.track_report(back).count() == lookups.track_report(m).count()
    sinks.write_snapshot(m.replace(complaints=m.complaints.where("district_id = 3")), out)
    assert load_model(spark, out, m.as_of).complaints.select("district_id").distinct().count() == 1


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    from civiccases.session import FREE_CONF
    m, before, set_to = adapter.load_testdata_model(spark, SF), shuffle_files(spark), spark.conf.get(FREE_CONF, None)
    sinks.write_snapshot(m, run_dir(spark, "test-freed"))
    assert shuffle_files(spark) <= before and spark.conf.get(FREE_CONF, None) == set_to


def test_descriptions_move_in_turns(spark, monkeypatch):
    """The same rows, repeated and empty keys included; a turn shuffles the texts of its own keys only."""
    from civiccases.sources.scratch import Scratch
    m = adapter.load_testdata_model(spark, SF)
    brief, described = m.brief()
    brief = brief.withColumn("_doc", F.when(F.col("id") % 10 != 0, F.col("_doc"))).unionByName(brief.where("id % 7 = 0"))
    rows = described(brief).select(*m.complaints.columns)
    odd = m.replace(complaints=rows)
    odd.extra |= {"described": (brief, described), "described_by": "_doc"}
    odd.extra["rows"]["complaints"] = rows.count
    monkeypatch.setattr(sinks, "TURN_ROWS", 100)
    scratch = Scratch(spark, "test-turns")
    turns = list(sinks._turns(odd, scratch))
    assert len(turns) == sinks.TURNS and min(t.count() for t in turns) > 0
    plan = turns[3]._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "doc_id" in line and "xxhash64" in line for line in plan.splitlines())
    out = sinks.write_snapshot(odd, run_dir(spark, "test-turns"), files_hint=3)
    back = load_model(spark, out, m.as_of).complaints.drop("created_year")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    few = odd.replace(complaints=m.complaints.where("district_id = 3"))  # no texts of their own: all at once, and no old rows stay
    sinks.write_snapshot(few, out)
    assert load_model(spark, out, m.as_of).complaints.select("district_id").distinct().count() == 1
    scratch.drop()


def test_filters_are_as_large_as_their_row_groups_need(spark, tmp_path):
    m = adapter.load_testdata_model(spark, SF)
    out = sinks.write_snapshot(m, str(tmp_path / "s"))
    files = [f for f in (tmp_path / "s" / "citizens").glob("*.parquet")]
    assert out and files and sum(f.stat().st_size for f in files) < 200_000

import pytest
from pyspark.sql import functions as F

from panelwise.operators import proposals
from panelwise.plans import catalog, standin
from panelwise.sources import store
from panelwise.streaming import submissions as stream

GAPS = ("school_id", "academic_year", "classroom_gap", "teacher_gap", "total_enrolment")


@pytest.fixture(scope="module")
def gap_table(spark, sf):
    return catalog.scored_of(spark, sf).select(*GAPS)


@pytest.fixture(scope="module")
def want(spark, sf, gap_table):
    valid, _ = proposals.split_valid(standin.submissions(spark, sf))
    return stream.judged(valid, gap_table)


def rows(df, like):
    return sorted(map(tuple, df.select(like.columns).collect()), key=repr)


def test_stream_equals_batch_and_quarantines(spark, sf, tmp_path, gap_table, want):
    arrivals = str(tmp_path / "in")
    subs = standin.submissions(spark, sf)
    subs.repartition(4).write.parquet(arrivals)
    source = stream.read_submissions(spark, arrivals, files_per_batch=2)
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    stream.append_judged(source, gap_table, out, str(tmp_path / "c1"), "validated_at").awaitTermination()
    stream.append_stream(stream.quarantined_stream(source), bad, str(tmp_path / "c2")).awaitTermination()
    got = store.read_version(spark, out)
    assert got.where("validated_at IS NULL").count() == 0 and got.select("batch").distinct().count() == 2
    assert rows(got, want) == rows(want, want)
    assert spark.read.parquet(bad).count() == proposals.split_valid(subs)[1].count() > 0
    # a second run over the same input adds nothing, nor does a second delivery of some submissions
    stream.append_judged(source, gap_table, out, str(tmp_path / "c1"), "validated_at").awaitTermination()
    subs.limit(200).write.mode("append").parquet(arrivals)
    stream.append_judged(source, gap_table, out, str(tmp_path / "c1"), "validated_at").awaitTermination()
    assert rows(store.read_version(spark, out), want) == rows(want, want)


def test_a_batch_that_runs_again_replaces_itself(spark, sf, tmp_path, gap_table, want):
    out = str(tmp_path / "out")
    write = stream.batch_writer(gap_table, out)
    valid, _ = proposals.split_valid(standin.submissions(spark, sf))
    halves = [valid.where(F.pmod(F.xxhash64("submission_id"), F.lit(2)) == i) for i in (0, 1)]
    for number in (0, 1, 1, 0):
        write(halves[number], number)
    assert rows(store.read_version(spark, out), want) == rows(want, want)


def test_a_batch_that_fails_in_mid_write_is_done_on_restart(spark, sf, tmp_path, gap_table, want, monkeypatch):
    arrivals, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    standin.submissions(spark, sf).repartition(3).write.parquet(arrivals)
    real, calls = store._laid_out, []

    def failing(*args):
        calls.append(1)
        writer = real(*args)
        if len(calls) == 2:  # data of the second batch is there, its list is not
            writer.parquet(out)
            raise OSError("lost in mid-write")
        return writer

    monkeypatch.setattr(store, "_laid_out", failing)
    source = lambda: stream.read_submissions(spark, arrivals, files_per_batch=1)
    with pytest.raises(Exception, match="lost in mid-write"):
        stream.append_judged(source(), gap_table, out, state).awaitTermination()
    between = store.read_version(spark, out)
    assert between.select("batch").distinct().count() == 1
    stream.append_judged(source(), gap_table, out, state).awaitTermination()
    assert rows(store.read_version(spark, out), want) == rows(want, want)


def test_gap_table_is_cut_to_the_years_of_the_batch(spark, gap_table):
    batch = spark.createDataFrame([("1", "1995-96"), ("2", "1995-96"), ("3", "no year"), ("4", None)], "school_id string, academic_year string")
    plan = stream.in_years_of(batch, gap_table)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(academic_year" in plan.replace("(academic_year#", "(academic_year#") and "1995-96" in plan
    assert "no year" not in plan

import hashlib
import os
from pathlib import Path

import pytest

from helpers import rows
from parcelwise import session
from parcelwise.sources import records
from workload import queries
from workload.queries import derived, expectation_report, study_metrics
from workload.study import BuiltStudy, ReportedStudy, Study


def folders(spark):
    return set(os.listdir(session.shared_folder(spark).removeprefix("file:")))


def test_tables_of_a_scope_go_with_it(spark, frame):
    before = folders(spark)
    with session.scope(spark):
        first = session.shared("numbers", lambda: frame("a int", (1,), (2,)))
        again = session.shared("numbers", lambda: pytest.fail("built twice"))
        assert first is again and len(folders(spark) - before) == 1
        with session.scope(spark):
            assert session.shared("numbers", lambda: None) is first
            session.materialised(first)
            assert len(folders(spark) - before) == 2
        assert len(folders(spark) - before) == 1
        result = session.kept(first.where("a = 2"))
    assert rows(result) == [(2,)] and len(folders(spark) - before) == 1
    assert not session.in_scope()
    with pytest.raises(ZeroDivisionError), session.scope(spark):
        session.materialised(frame("a int", (1,)))
        1 / 0
    assert len(folders(spark) - before) == 1
    session.remove_written(spark)


def test_without_a_scope_every_call_writes_its_own(spark, frame):
    one, two = (session.shared("numbers", lambda: frame("a int", (1,))) for _ in range(2))
    assert one.inputFiles() != two.inputFiles()


def test_results_share_one_fact(spark):
    folder, before = "/root/testdata/sf0.001", folders(spark)
    with session.scope(spark) as opened:
        reported, built = ReportedStudy(spark, folder), BuiltStudy(spark, folder)
        assert study_metrics(reported).count() > 0 and derived(ReportedStudy(spark, folder)).count() == 1
        assert expectation_report(built).count() == 40
        facts = {tuple(s.routed.inputFiles()) for s in (reported, built)}
        assert len(facts) == 1 and {name for _, name in opened.tables} == {"paid fact", "seller excess", "orders", "reviews"}
    assert folders(spark) <= before


def test_reports_and_checks_share_what_the_fact_is_made_of(spark):
    folder = "/root/testdata/sf0.001"
    with session.scope(spark):
        reported, built = ReportedStudy(spark, folder), BuiltStudy(spark, folder)
        assert reported.orders.inputFiles() == built.orders.inputFiles()
        assert reported.reviews.inputFiles() == built.reviews.inputFiles()
    # The published fact is the written one with its ranks: lines and payments are not summed up again.
    assert not [path for path in BuiltStudy(spark, folder).fct_orders.inputFiles() if path.startswith(f"file://{folder}")]
    session.remove_written(spark)


def test_packed_files_do_not_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_PER_PACKED_FILE", 100)
    study = Study(spark, "/root/testdata/sf0.001")
    path = queries._csv_files(study, packed=True)["order_reviews"]
    found = records.read_csv_records(spark, path, "file")
    assert path.endswith("*.csv.gz") and found.count() == study.raw("order_reviews").count()
    assert max(n for _, n in rows(found.groupBy("file").count())) <= 100
    session.remove_written(spark)


def test_a_manifest_is_made_of_packed_files(spark, monkeypatch):
    """The text that is loaded and digested lies on disk packed, in files of bounded size."""
    monkeypatch.setattr(queries, "ROWS_PER_PACKED_FILE", 100)
    places = {}
    monkeypatch.setattr(queries, "new_place", lambda s, name: places.setdefault(name, session.new_place(s, name)))
    study = Study(spark, "/root/testdata/sf0.001")
    found = dict(rows(queries.load_manifest(study)))
    assert found == {name: study.raw(name).count() for name in study.raw_names}
    listed = rows(spark.read.parquet(f"{places['landed']}/manifest"), "file", "sha256", "rows")
    files = [path for path in Path(places["csv"].removeprefix("file:")).glob("*/part-*") if path.is_file()]
    digests = {path.name: hashlib.sha256(path.read_bytes()).hexdigest() for path in files}
    assert len(listed) > 50 and {name: digest for name, digest, _ in listed} == digests
    assert all(name.endswith(".csv.gz") and n <= 100 for name, _, n in listed)
    session.remove_written(spark)

import datetime as dt
import gzip
import hashlib
import os

import pytest

from helpers import rows
from parcelwise import session
from parcelwise.sources import calendar, manifest, tables
from parcelwise.sources.raw import ContractError, load_raw

SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01000,campinas,SP\ns2,02000,rio,RJ\n"
TRANSLATION = "product_category_name,product_category_name_english\nbeleza,beauty\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sellers.csv").write_text(SELLERS)
    (tmp_path / "translation.csv").write_text(TRANSLATION)
    return tmp_path


def files(folder):
    return {"sellers": f"{folder}/sellers.csv", "category_translation": f"{folder}/translation.csv"}


def test_load_lands_tables_and_appends_to_the_manifest(spark, folder):
    target = f"{folder}/landed"
    for _ in range(2):
        landed = load_raw(spark, files(folder), target)
    assert sorted(rows(landed["sellers"], "seller_id", "seller_state")) == [("s1", "SP"), ("s2", "RJ")]
    written = spark.read.parquet(f"{target}/manifest")
    digest = hashlib.sha256(SELLERS.encode()).hexdigest()
    assert rows(written.where("source = 'sellers'"), "file", "sha256", "rows") == [("sellers.csv", digest, 2)] * 2
    assert written.count() == 4


def test_unexpected_digest_or_missing_column_stops_before_any_write(spark, folder):
    target = folder / "landed"
    wrong = spark.createDataFrame([("sellers.csv", "0" * 64)], "file string, sha256 string")
    with pytest.raises(ContractError, match="digest"):
        load_raw(spark, files(folder), str(target), expected_digests=wrong)
    (folder / "translation.csv").write_text("product_category_name\nbeleza\n")
    with pytest.raises(ContractError, match="product_category_name_english"):
        load_raw(spark, files(folder), str(target))
    assert not target.exists()


def test_expected_digests_pass(spark, folder):
    expected = manifest.file_digests(spark, f"{folder}/*.csv").select("file", "sha256")
    load_raw(spark, files(folder), f"{folder}/landed", expected_digests=expected)


def test_digests_of_any_bytes(spark, tmp_path):
    contents = {
        "closed.csv": b"a,b\n1,2\n",
        "open.csv": b"a,b\n1,2",
        "returns.csv": b"a\r\n\r\n\n\n",
        "feed.csv": b"\n",
        "two feeds.csv": b"\n\n",
        "empty.csv": b"",
        "mark.csv": b"\xef\xbb\xbf",
        "mark feed.csv": b"\xef\xbb\xbf\n",
        "marked.csv": b"\xef\xbb\xbfa,b\n1,2",
        "marked closed.csv": b"\xef\xbb\xbfa,b\n1,2\n",
        "not text%20.csv": bytes(range(256)) * 300,
        "long.csv": b"".join(b"%d,x\n" % i for i in range(50_000)),
        "one line.csv": b"x" * 3_000_000,
        "packed.csv.gz": gzip.compress(b"a,b\n1,2\n"),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = rows(manifest.file_digests(spark, str(tmp_path)), "file", "sha256", "bytes")
    assert sorted(found) == sorted((n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items() if c)


def test_digests_hold_no_whole_file(spark, tmp_path):
    """A file is read in one task as lines, however small the splits are, and never as one row."""
    (tmp_path / "large.csv").write_bytes(content := b"".join(b"%d,x\n" % i for i in range(100_000)))
    names = {"spark.sql.files.maxPartitionBytes": "10kb", "spark.sql.files.openCostInBytes": "1b", "spark.sql.sources.binaryFile.maxLength": "1000"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        found = rows(manifest.file_digests(spark, str(tmp_path)), "sha256")
        assert found == [(hashlib.sha256(content).hexdigest(),)]
        assert {name: spark.conf.get(name) for name in names} == names
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_line_breaks_only_where_declared(spark, tmp_path):
    header = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp"
    (tmp_path / "reviews.csv").write_text(f'{header}\nr1,o1,5,,"two\nlines",2018-01-01,2018-01-02\n')
    landed = load_raw(spark, {"order_reviews": f"{tmp_path}/reviews.csv"}, f"{tmp_path}/landed")
    assert rows(landed["order_reviews"], "review_id", "review_comment_message") == [("r1", "two\nlines")]
    assert landed["order_reviews"].columns == header.split(",")


def test_views_and_saved_tables(spark, frame, tmp_path):
    df = frame("seller_id string, state string", ("s1", "SP"), ("s2", "RJ"))
    tables.register_views({"known_sellers": df})
    assert spark.sql("SELECT count(*) FROM known_sellers WHERE state = 'SP'").first()[0] == 1
    tables.save_tables({"sellers": df}, str(tmp_path))
    saved = tables.save_tables({"sellers": df}, str(tmp_path), partition_by={"sellers": ["state"]})
    assert saved["sellers"].count() == 2
    more = tables.save_tables({"sellers": df}, str(tmp_path), mode="append", partition_by={"sellers": ["state"]})
    assert more["sellers"].count() == 4
    assert tables.open_tables(spark, str(tmp_path), ["sellers"])["sellers"].count() == 4


def test_day_series_excludes_its_end(spark):
    found = rows(calendar.day_series(spark, dt.date(2018, 2, 27), dt.date(2018, 3, 2)))
    assert found == [(dt.date(2018, 2, 27),), (dt.date(2018, 2, 28),), (dt.date(2018, 3, 1),)]
    assert rows(calendar.day_series(spark, dt.date(2018, 1, 1), dt.date(2018, 1, 1))) == []


def test_written_tables_go_to_the_shared_folder_and_can_be_removed(spark, frame):
    shared = session.shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared == named
    written = session.materialised(frame("a int", (1,), (2,)))
    files = written.inputFiles()
    assert files and all(shared.removeprefix("file:") in path for path in files)
    assert sorted(rows(written)) == [(1,), (2,)]
    session.remove_written(spark)
    assert not any(os.path.exists(path.removeprefix("file://")) for path in files)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())

"""Files of months, and records that come back broken."""

import datetime as dt
from decimal import Decimal

import pytest

from docledger.sources import files

DAYS = [dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 3, 5), None]


@pytest.fixture
def base(spark, tmp_path):
    rows = [(i, day, f"text {i}\nsecond line é") for i, day in enumerate(DAYS)] + [(9, dt.date(2024, 1, 7), None)]
    folder = str(tmp_path / "incoming")
    files.write_attachments(spark.createDataFrame(rows, "id INT, day DATE, text STRING"), folder, "day")
    return folder


def test_each_text_is_a_file_of_its_month(spark, base):
    found = files.scan_months(spark, base, (2023, 12), (2024, 3)).collect()
    assert sorted(r.month for r in found) == ["2023.12", "2024.01", "2024.01", "2024.01", "2024.03"]
    assert {r.ext for r in found} == {"txt"}
    assert sorted(bytes(r.content).decode() for r in found if r.month == "2024.01") == ["\n", "text 1\nsecond line é\n", "text 2\nsecond line é\n"]
    assert files.scan_files(spark, base, [".TXT"], recursive=True).count() == 6 and files.scan_files(spark, base, ["pdf"], recursive=True).count() == 0


def test_only_folders_of_the_months_are_read(spark, base):
    one = files.scan_months(spark, base, (2024, 1), (2024, 2))
    assert all("/2024.01/attachments/" in f for f in one.inputFiles()) and one.count() == 3
    assert files.scan_months(spark, base, (1999, 1), (1999, 12)).count() == 0
    assert files.scan_month(spark, base, 2024, 3).count() == 1


def test_tasks_share_no_folder(spark, tmp_path):
    """A folder of two tasks would be committed file by file in the driver; checksum files would double what is made."""
    folder = tmp_path / "many"
    docs = spark.range(0, 40, 1, 4).selectExpr("DATE'2024-01-05' AS day", "'text ' || id AS text")
    files.write_attachments(docs, str(folder), "day")
    found = [p for p in folder.rglob("*") if p.is_file() and "part-" in p.name]
    assert sorted(p.read_text() for p in found) == sorted(f"text {i}\n" for i in range(40))
    tasks = {}
    for p in found:
        tasks.setdefault(p.parent, set()).add(p.name.split("-")[1])
    assert len(tasks) == 4 and all(len(t) == 1 for t in tasks.values())


def test_texts_keep_their_lines(spark, base):
    docs = files.read_text_docs(spark, base).collect()
    assert sorted(d.text for d in docs)[-1] == "text 4\nsecond line é\n" and len({d.doc_id for d in docs}) == 6
    assert all(d.metadata["filename"].endswith(".txt") for d in docs)


def test_broken_json_lines_are_rows_with_an_error(spark, tmp_path):
    texts = ['{"doc_id":1,"document_number":"A","totals":{"total":12.5}}', '{"doc_id":2,"document_number":"B"', "no json", '{"doc_id":4,"totals":{"total":"x"}}', "{}", '{"doc_id":12345678901234567890123}']
    spark.createDataFrame([(t,) for t in texts], "value STRING").write.text(str(tmp_path / "j"))
    rows = files.with_error(files.read_invoice_json(spark, str(tmp_path / "j"))).select("doc_id", "document_number", "totals.total", "error").collect()
    bad = "malformed record"
    want = [(1, "A", Decimal("12.5000"), None), (2, None, None, bad), (None, None, None, bad), (4, None, None, bad), (None, None, None, None), (None, None, None, bad)]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    # A narrow query sees the same records as malformed.
    assert files.with_error(files.read_invoice_json(spark, str(tmp_path / "j"))).filter("error is not null").select("doc_id").count() == 4


def test_broken_csv_lines_are_rows_with_an_error(spark, tmp_path):
    lines = ["1,A,2024-01-02,,EUR,S,B,1.00,0.10,1.10", "2,B,2024-01-02", "3,C,someday,,EUR,S,B,1,1,2", '4,"D, E",2024-01-02,,EUR,S,B,1,1,2,more', '5,"F, G",,,,,,,,']
    spark.createDataFrame([(x,) for x in lines], "value STRING").write.text(str(tmp_path / "c"))
    read = files.with_error(files.read_flat_csv(spark, str(tmp_path / "c"), header=False))
    got = {r.doc_id: (r.document_number, r.total, r.error) for r in read.select("doc_id", "document_number", "total", "error").collect()}
    bad = (None, None, "malformed record")
    assert got == {1: ("A", Decimal("1.1000"), None), 2: bad, 3: bad, 4: bad, 5: ("F, G", None, None)}
    # A narrow query sees the same rows as malformed.
    assert read.filter("error is not null").select("doc_id").count() == 3

import gzip
import hashlib
import io
import re

import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from civictopics.llm import warc

LONG = "<p>é" * 400
PAGES = [
    (1, "http://a/1", LONG, "x"), (2, "http://a/2", LONG, "x"), (7, "http://a/7", LONG, "x"), (3, "http://b/3", "short", "x"),
    (4, "http://b/4", "short", "x"), (5, None, None, "x"), (6, "http://b/\r\n6", "", "x"), (8, "http://c", "y" * 300_000, "x"),
    (None, "http://d", LONG, "x"), (9, "http://e", "a\r\n\r\nb" * 300, "x"), (9, "http://e", "a\r\n\r\nb" * 300, "x"),
]
SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows):
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        top = max(same, default=None)
        revisit = len(data) >= 1000 and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_by_brute_force(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    assert sorted((tuple(r) for r in warc.archived_pages(df.repartition(3)).collect()), key=repr) == brute(PAGES)
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_predicates_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.write_archive(warc.page_records(spark.createDataFrame(PAGES, SCHEMA)), path)
    back = warc.read_archive(spark, path)
    revisits = back.filter("record_type = 'revisit' and target_uri like 'http://a/%'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    assert sorted(r.target_uri for r in revisits.collect()) == ["http://a/1", "http://a/2"]
    assert back.filter("payload_length > 100000").count() == 1
    assert warc.read_archive(spark, path, payload=False).filter("payload is not null").count() == 0
    # A second write adds to the first; files that no commit lists are passed over.
    (tmp_path / "archive" / "part-lost.warc.gz").write_bytes(b"left by a lost task")
    warc.write_archive(warc.page_records(spark.createDataFrame(PAGES[3:4], SCHEMA)), path)
    assert warc.read_archive(spark, path).count() == len(PAGES) + 1


class Counted(io.BytesIO):
    """Counts the bytes read."""

    def __init__(self, data):
        super().__init__(data)
        self.taken = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def row(kind, payload, name="urn:x:1"):
    return {"record_id": name, "record_type": kind, "target_uri": "http://a", "refers_to": None, "payload_digest": hashlib.sha1(payload).hexdigest(),
            "payload_length": len(payload), "payload": payload}


def test_unwanted_payloads_are_not_read():
    import os

    big = os.urandom(2_000_000)
    data = b"".join(warc.member(warc.record(row(k, p), "2000-01-01T00:00:00Z")) for k, p in [("response", big), ("metadata", b"m"), ("response", big)])
    file = Counted(data)
    got = list(warc.records(file, lambda r: r["record_type"] == "metadata"))
    assert [r["payload"] for r in got] == [b"m"] and file.taken < 300_000
    assert gzip.decompress(data).count(b"WARC/1.1") == 3


@pytest.mark.parametrize("pack", [lambda d: d, gzip.compress])
def test_archives_of_other_writers(pack):
    rows = [row("response", b"x" * 70_000, "urn:x:1"), row("revisit", b"y" * 10, "urn:x:2"), row("response", b"", "urn:x:3")]
    data = b"".join(pack(warc.record(r, "2000-01-01T00:00:00Z")) for r in rows)
    got = list(warc.records(Counted(data), lambda r: r["record_id"] != "urn:x:3"))
    assert [(r["record_id"], r["payload_length"], r["payload"]) for r in got] == [
        ("urn:x:1", 70_000, b"x" * 70_000), ("urn:x:2", 10, None)]


def test_filters_that_are_pushed():
    reader = warc.WarcReader({"path": "file:///nowhere"}, None)
    tests = [EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), StringStartsWith(("record_id",), "u"),
             GreaterThan(("payload_length",), 3)]
    assert list(reader.pushFilters(tests)) == tests[3:]
    assert reader.wanted(row("response", b"") | {"target_uri": "a"})
    assert not reader.wanted(row("revisit", b"") | {"target_uri": "a"}) and not reader.wanted(row("response", b""))


def test_pages_come_through_pushed_record_types(spark, capsys):
    df = spark.createDataFrame(PAGES, SCHEMA)
    warc.archived_pages(df).explain("formatted")
    plan = capsys.readouterr().out
    pushed = re.findall(r"PushedFilters: (\[.*record_type.*\])", plan)
    assert len(pushed) == 2 and any("response" in p for p in pushed) and any("revisit" in p for p in pushed)
    assert not re.search(r"Condition : .*record_type", plan)

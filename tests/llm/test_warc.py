import hashlib

import pytest

from tessera.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload string, bytes int"
LONG = "é" * 80


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/", LONG), (3, None, LONG), (9, "http://c/\r\nX: y", LONG), (9, "http://c/2", LONG), (1, "http://d/", "short"), (2, "http://e/", "short"), (4, "", None), (6, "u", ""), (7, "u", "x" * 100), (8, "u", "x" * 99), (10, "u", "x" * 99), (None, "n", LONG), (None, "n", "y" * 200)]
    return spark.createDataFrame([(*r, "d", "p", 0) for r in rows], PAGES)


def test_each_record(spark, pages):
    got = warc.read_archive(spark, warc.write_archive(pages)).collect()
    rows = pages.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        again = len(data) >= 100 and r.page_id != first.get(r.html)
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first.get(r.html) if again else None, data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert {r.url for r in got if r.page_id == 3} == {None} and {r.url for r in got if r.page_id == 4} == {""}
    assert {r.url for r in got if r.page_id == 9} == {"http://c/%0D%0AX: y", "http://c/2"}


def test_payloads_are_stored_once(spark, pages):
    path = warc.write_archive(pages)
    stored = [r.digest for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert len(stored) == len(set(stored)) == len({(r.html or "") for r in pages.collect()})


def records(data):
    """A plain reader of a WARC file: the version, named fields and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = {}
        for line in lines:
            name, value = line.split(": ", 1)
            assert name not in fields
            fields[name] = value
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        assert len(block) == n and data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        yield version, fields, block
        at = end + 8 + n


def test_a_plain_reader_reads_the_records(spark, pages):
    path = warc.write_archive(pages, date="2024-05-06T07:08:09Z")
    whole = b"".join(bytes(r.record) for r in warc.reconstruct(spark, path).collect())
    read = list(records(whole))
    names = {f["WARC-Record-ID"]: f for _, f, _ in read}
    assert len(names) == len(read) == pages.count()
    payloads = []
    for version, fields, block in read:
        assert version == "WARC/1.1" and {"WARC-Type", "WARC-Date", "Content-Type"} <= set(fields)
        assert fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        if fields["WARC-Type"] == "response":
            head, _, payload = block.partition(b"\r\n\r\n")
            assert head.startswith(b"HTTP/1.1 200 OK\r\n") and head.endswith(b"Content-Length: %d" % len(payload))
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            payloads.append(payload)
        else:
            first = names[fields["WARC-Refers-To"]]
            assert not block and first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
    assert {p.decode() for p in payloads} == {r.html or "" for r in pages.collect()}


def test_damage_is_noticed(spark, pages):
    path = warc.write_archive(pages)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="stored payload"):
        warc.read_payloads(spark, path).collect()


def test_empty(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_archive(spark, warc.write_archive(empty)).collect() == []

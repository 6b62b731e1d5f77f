"""WARC archives: round trips and revisits against a loop."""

import hashlib

from typeflow.llm import warc
from typeflow.llm.common import saved

PAGES = "page_id bigint, url string, html string, payload string"
LONG = "<p>" + "x" * 200


def through(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    folder = warc.write_archive(warc.resolved(pages), file_records=3)
    return warc.joined(saved(warc.read_archive(spark, folder), "records")).collect()


def test_revisits_name_the_first_page_of_a_payload(spark):
    rows = [(9, "http://a", LONG), (3, "http://b", LONG), (5, None, LONG), (4, "u", "short"), (6, "u", "short"),
            (7, "v", None), (8, "w", ""), (10, "x", LONG + "é日"), (11, "y y\r\nz", "WARC/1.1\r\n\r\n" + LONG)]
    found = {r.page_id: r for r in through(spark, rows)}
    assert len(found) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = html == LONG and page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
    assert found[11].url == "y%20y%20%20z" and found[5].url is None


def test_a_revisit_is_stored_without_its_payload(spark):
    pages = spark.createDataFrame([(i, "u", LONG, "") for i in range(200)], PAGES)
    folder = warc.write_archive(warc.resolved(pages))
    content = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect())
    raw = [block for fields, block in warc.records_of(content)]
    assert sum(LONG.encode() in block for block in raw) == 1 and len(raw) == 200


def test_repeated_pages_null_ids_and_empty_tables(spark):
    assert through(spark, []) == []
    found = through(spark, [(1, "u", LONG), (1, "u", LONG), (None, "u", LONG), (2, "u", LONG)])
    assert sorted((r.page_id or 0, r.record_type) for r in found) == [
        (0, "revisit"), (1, "response"), (1, "response"), (2, "revisit"),
    ]
    only = through(spark, [(None, "u", LONG), (None, "v", LONG)])
    assert [r.record_type for r in only] == ["response", "response"]
    assert all(r.payload_bytes == len(LONG) for r in found + only)


def test_a_page_with_two_payloads_and_revisits_of_both(spark):
    a, b = "a" * 150, "b" * 200
    found = through(spark, [(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b)])
    rows = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    digests = {n: hashlib.sha256(text.encode()).hexdigest() for n, text in ((150, a), (200, b))}
    assert rows == [
        (1, 150, digests[150], "response", None), (1, 200, digests[200], "response", None),
        (2, 150, digests[150], "revisit", 1), (3, 200, digests[200], "revisit", 1),
    ]
    assert len({r.record_id for r in found}) == 4

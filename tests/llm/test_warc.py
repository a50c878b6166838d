import base64
import hashlib

import pytest

from slimctx.llm import warc as A

HTML = ["<p>one</p>", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "", None, "é 漢 🙂\r\n\r\n", "x" * 300_000, "<p>one</p>",
        "<p>one</p>", "a\n", "a\r\n"]


def brute(rows, min_bytes=0):
    top = {}
    for page, _, html in rows:
        b = (html or "").encode()
        if page is not None:
            top[b] = max(top.get(b, page), page)
    out = []
    for page, url, html in rows:
        b = (html or "").encode()
        first = top.get(b)
        again = len(b) >= min_bytes and first is not None and (page is None or page < first)
        out.append((page, url or None, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if again else "response", first if again else None))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows],
                                 "page_id long, url string, html string, original int, n int")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, tmp_path, min_bytes):
    rows = [(i, f"http://h.x/{i}?a=b c&é#f" if i % 3 else None, h) for i, h in enumerate(HTML)]
    rows += [rows[0], (None, "u", "<p>one</p>"), (None, "v", "alone"), (7, "again", "<p>one</p>"),
             (20, "two payloads", "a\n"), (20, "two payloads", "b\n")]
    path = str(tmp_path / "w")
    A.write_archives(table(spark, rows), path, min_bytes, archive_bytes=100_000)
    got = A.read_archives(spark, path).collect()
    assert all(r.intact for r in got)
    assert order([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in got]) == order(brute(rows, min_bytes))
    assert all(r.block_bytes == (r.payload_bytes if r.record_type == "response" else 0) for r in got)


def test_archives_parse_without_spark(spark, tmp_path):
    import gzip
    path = tmp_path / "w"
    A.write_archives(table(spark, [(1, "u", "p"), (2, "u", "p")]), str(path))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in path.glob("part-*"))
    found = {h["WARC-Record-ID"]: (h, b) for h, b in A.parse_archive(data)}
    h, b = found["<urn:x-page:1>"]
    assert h["WARC-Refers-To"] == "<urn:x-page:2>" and h["WARC-Profile"] == A.PROFILE
    assert b.endswith(b"\r\n\r\n") and found["<urn:x-page:2>"][1].endswith(b"\r\n\r\np")
    with pytest.raises(ValueError):
        list(A.parse_archive(data[:-6]))


def test_empty_table(spark):
    assert A.op9_query(table(spark, [])).count() == 0


def test_query_on_a_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = A.op9_query(pages).collect()
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert order([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in got]) == order([(a, c, d, e, f) for a, _, c, d, e, f in want])


def test_page_ids_of_any_size_and_session_settings(spark, tmp_path):
    ids = [2 ** 63 - 1, -2 ** 63, -1, 10 ** 13, 253_402_300_800, 2 ** 62]
    rows = [(i, "u", f"<p>{i % 3}</p>") for i in ids]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    path = str(tmp_path / "w")
    A.write_archives(table(spark, rows), path)
    got = A.read_archives(spark, path).collect()
    assert order([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in got]) == order(brute(rows))
    dates = spark.read.option("lineSep", "\r\n").text(path).filter("value like 'WARC-Date%'")
    assert dates.filter(r"value rlike '^WARC-Date: \\d{4}-'").count() == dates.count() == len(ids)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

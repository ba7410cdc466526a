import gzip
import hashlib
from collections import Counter
from pathlib import Path

from plumbline.llm import warc


def test_records_round_trip():
    for refers, revisit, payload in ((None, False, "é<p>".encode()), (3, True, b""), (None, True, b"")):
        data = warc.record(None if payload else 7, "http://x/a b\n", 5, "ab" * 32, payload, refers, revisit)
        headers, body = warc.parse_record(data)
        assert body == payload and headers["warc-type"] == ("revisit" if revisit else "response")
        assert headers["http-content-length"] == "5" and headers["warc-target-uri"] == "http://x/a%20b%0A"


def test_keys_reverse_hosts_and_sort_like_their_parts():
    assert warc.surt("http://www.Example.net/a?b=C") == "net,example,www)/a?b=C"
    assert warc.surt(None) == "-" and " " not in warc.surt("no scheme here")
    ids = [-(2**63), -5, 0, 7, 2**63 - 1, None]
    keys = [warc._line_key("k", i) for i in ids]
    assert keys == sorted(keys)


def test_index_over_many_blocks_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i // 2, f"http://h{i % 5}.net/{'same' if i % 3 else i}", "x" * (50 + i % 4 * 40)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive, captures = warc.write_archive(pages, f"file://{tmp_path}/archive")
    assert len(archive.shards) >= 2
    found = warc.lookup(archive, captures).collect()
    assert len(found) == 300 and sorted(r["page_id"] for r in found) == sorted(r[0] for r in rows)
    reader = warc.Reader(archive, kept=2)
    for r in captures.limit(40).collect():
        mine = [h["warc-record-id"] for h, _ in reader.records(warc._line_key(r["key"], r["page_id"]))]
        assert f"<urn:page:{r['page_id']}>" in mine
    assert list(reader.records("zz no such key")) == []
    # the files are gzip members that any WARC reader can walk through
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/archive").glob("*.warc.gz"))
    files = len(list(Path(f"{tmp_path}/archive").glob("*.warc.gz")))
    assert whole.count(b"WARC/1.1\r\n") == 300 + files and whole.count(b"WARC-Type: warcinfo") == files


def test_repeated_rows_have_one_response_and_payloads_stay_where_they_are(spark, tmp_path):
    """A third of all rows are one page, a third share a payload and have no id, and one payload is too short to revisit."""
    rows = [(5, "http://a/", "p" * 300)] * 40 + [(None, f"http://b/{i % 2}", "q" * 300) for i in range(40)] + [(i, f"http://c/{i}", "r" * (i % 7 * 30)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    archive, captures = warc.write_archive(pages, f"file://{tmp_path}/archive")
    found = warc.lookup(archive, captures).collect()
    kinds = Counter((r["page_id"], r["payload_digest"], r["record_type"]) for r in found)
    digest = lambda c, n: hashlib.sha256((c * n).encode()).hexdigest()
    assert len(found) == 120 and kinds[5, digest("p", 300), "response"] == 1 and kinds[5, digest("p", 300), "revisit"] == 39
    assert kinds[None, digest("q", 300), "response"] == 1 and kinds[None, digest("q", 300), "revisit"] == 39
    for n in range(7):
        mine = [r for r in found if r["payload_digest"] == digest("r", 30 * n)]
        firsts = {r["page_id"] for r in mine if r["record_type"] == "response"}
        assert firsts == ({r["page_id"] for r in mine} if 30 * n < 100 else {min(r["page_id"] for r in mine)})
        assert all(r["refers_to"] in firsts for r in mine if r["record_type"] == "revisit")
    # rows that repeat nothing pass through no exchange
    plain = warc.classified(spark.createDataFrame([(i, "u", "x" * 200 + str(i // 2)) for i in range(20)], "page_id long, url string, html string"))
    assert "Exchange hashpartitioning" not in plain._jdf.queryExecution().executedPlan().toString()

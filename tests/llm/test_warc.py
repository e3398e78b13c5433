import gzip
import hashlib
import heapq
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeframe.functions.stored import scratch
from lodeframe.llm import warc

SCHEMA = "page_id long, url string, html string, run string, Payload string"


def table():
    rng = random.Random(4)
    rows = [(i, f"https://www.h{rng.randrange(5)}.example.org/p/{rng.randrange(40)}?q=Ü#top", "page " * rng.randrange(10, 60)) for i in range(200)]
    rows += [(1000 + i, "http://hot.example.com:80", "copy " * 30) for i in range(150)]  # a hot payload on a hot URL
    rows += [(900, None, "copy " * 30), (901, "", "copy " * 30), (902, "a b\r\nX: y", "copy " * 30), (-5, "http://u@Neg.example/x", "copy " * 30)]
    rows += [(2000, "http://e/", None), (2001, "http://e/", ""), (2002, "http://e/", "x" * 99), (2003, "http://e/", "x" * 99)]
    rows += [(2004, "http://e/", "é" * 50), (2005, "http://e/1", "é" * 50), (2**62, "http://big/", "WARC/1.1\r\n\r\n" * 20), (2006, "http://e/", "\0\r\n\r\n" * 90)]
    rows += [(3000, "http://e/r", "again " * 30), (3000, "http://e/r", "again " * 30), (3001, "http://e/r", "again " * 30)]
    rows += [(None, "http://n/", "copy " * 30), (None, "http://n/", "alone " * 30), (None, "http://n/2", "alone " * 30), (4000, "http://long/", "z" * 300_000)]
    return [(*r, "x", "y") for r in rows]


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and i != first.get(html or "")
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(map(repr, out))


CONTRACT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize(("records", "sent"), [(4_000, 32 << 20), (7, 0)])
def test_query(spark, tmp_path, monkeypatch, records, sent):
    monkeypatch.setattr(warc, "RECORDS", records)
    monkeypatch.setattr(warc, "SENT_BYTES", sent)
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    out = warc.op11_warc(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r[c] for c in CONTRACT)) for r in out) == brute(rows)
    out.sort(key=lambda r: r["history_position"])
    assert [r["history_position"] for r in out] == list(range(len(rows)))
    order = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0, r["payload_digest"]) for r in out]
    assert order == sorted(order)
    seen = {}
    for r in out:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture"] == seen[r["url_key"]]
    assert seen["com,example,hot)/"] == 150 and seen["example,neg)/x"] == 1


def test_sql(spark, tmp_path):
    rows = [r for r in table() if r[0] not in (3000, 902, None)]  # no repeated ids, no odd characters in URLs
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = db.execute(warc.OP11_SQL).fetchall()
    out = warc.op11_warc(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(wanted, key=repr)


def test_archives_hold_standard_records(spark):
    folder = scratch(spark, "test-archives")
    pages = spark.createDataFrame([(2, "http://a/b c", "copy " * 30), (1, "http://a/", "copy " * 30), (3, None, None)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), folder, F.lit(0))
    (content,) = (bytes(r[0]) for r in spark.read.format("binaryFile").load(folder).select("content").collect())
    whole = gzip.decompress(content)
    assert whole.count(b"WARC/1.1\r\n") == 3 and whole.endswith(b"\r\n\r\n")
    found = list(warc.records(content))
    for r in found:  # each record can be taken by its place alone
        assert gzip.decompress(content[r.offset : r.offset + r.length]).startswith(b"WARC/1.1\r\n")
    by = {warc.capture_of(r.head["warc-record-id"]): r for r in found}
    assert by[2].head["warc-type"] == "revisit" and by[2].head["warc-profile"] == warc.REVISIT_PROFILE
    assert by[2].head["warc-refers-to"] == by[1].head["warc-record-id"] and by[2].head["warc-refers-to-date"] == "1970-01-01T00:00:00Z"
    assert by[2].head["warc-target-uri"] == "http://a/b%20c" and "warc-target-uri" not in by[3].head
    assert by[1].block == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 150\r\n\r\n" + b"copy " * 30
    read = {r["capture_id"]: r for r in warc.read_archives(spark, folder, payloads=True).collect()}
    assert read[1]["payload"] == b"copy " * 30 and read[2]["payload"] is None and read[3]["payload"] == b""


def foreign(kind, body, **head):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:12345678-1234-4123-8123-123456789abc>", "WARC-Date": "2020-01-02T03:04:05.678Z"}
    lines |= {k.replace("_", "-"): v for k, v in head.items()} | {"Content-Length": str(len(body))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
    parts = [
        foreign("warcinfo", b"software: x\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http"),
        foreign("response", http, Content_Type="application/http; msgtype=response", WARC_Target_URI="<http://x/>", WARC_Payload_Digest="sha1:ABC"),
        foreign("resource", b"plain", WARC_Target_URI="http://y/"),
        foreign("revisit", b"", WARC_Target_URI="http://z/", WARC_Payload_Digest="sha1:ABC"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.captured_runs(spark, str(tmp_path)).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["capture_id"] is None and r["captured"] == 1577934245
        body = {"http://x/": b"hello\r\n\r\nWARC/1.0\r\n", "http://y/": b"plain"}.get(r["url"])
        assert r["payload_digest"] == (hashlib.sha256(body).hexdigest() if body else "sha1:ABC")
        if r["run"].endswith("plain.warc"):
            assert (tmp_path / "plain.warc").read_bytes()[r["offset"] :].startswith(b"WARC/1.0\r\n")


@pytest.mark.parametrize("damage", [lambda b: b[:-20], lambda b: b[:-30] + b"x" * 30, lambda b: b"junk" + b])
def test_damage_is_told(damage):
    content = warc.member(warc.record({"capture_id": 1, "url": "http://a", "captured": 0, "payload": b"abc" * 50, "size": 150, "digest": "0" * 64, "refers": None})) + b"\0"
    (found,) = warc.records(content)
    with pytest.raises(ValueError, match="has digest"):
        warc.capture(found)
    with pytest.raises((ValueError, warc.zlib.error)):
        list(warc.records(damage(content)))


def test_members_of_any_size():
    rng = random.Random(1)
    for n in (0, 1, 1000, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        content = rng.randbytes(min(n, 1000)) * (n // 1000 + 1)
        assert gzip.decompress(warc.member(content[:n]) + b"\0") == content[:n]


@pytest.mark.parametrize("i", [0, 1, -1, 2**63 - 1, -(2**63), 15, 16, 2**16, 123456789012345, None])
def test_names_hold_ids(i):
    name = warc.record_id(i, "http://x", 7)
    assert warc.capture_of(name) == i and name != warc.record_id(i, "http://x", 8)
    assert warc.capture_of("<urn:uuid:12345678-1234-4123-8123-123456789abc>") is None


def test_tree_of_losers():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted((rng.randrange(20), r) for _ in range(rng.randrange(9))) for r in range(k)]
        assert list(warc.merged(runs)) == list(heapq.merge(*runs))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11_warc(spark, str(tmp_path)).collect() == []

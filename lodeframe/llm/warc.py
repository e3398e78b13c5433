"""WARC archives of pages: written, read back, and their index merged into capture histories.

Writing: each record is a gzip member of its own. Spark's text writer puts them down, so that any file system that Spark
knows will do and a lost task leaves nothing; a member's last byte, the highest of its size, is zero below 16 MiB, and that
byte is what the writer puts behind each row. Of equal payloads one is stored, as response; the others revisit it.

Reading: each archive is gone through record by record, and its captures, sorted by URL key and time, are a run. Ranges of
keys are dealt out to tasks, and each merges the parts of all runs that it gets by a tree of losers.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import scratch
from .common import partitions, quoted, written

#: Records in an archive at most.
RECORDS = 4_000
#: Bytes of what is sent to all tasks at most; beyond, Spark joins by shuffle.
SENT_BYTES = 32 << 20
#: Bytes of payloads that a task holds back before it passes them on.
HELD_BYTES = 16 << 20

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that are captures of a page.
CAPTURES = ("response", "resource", "revisit")
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


# --- records -------------------------------------------------------------------------------------------------------


def record_id(capture_id: int | None, url: str | None, captured: int) -> str:
    """A UUID of version 8 that holds the capture's id: 64 bits of it, whether there is one, and 57 of a hash of the rest."""
    rest = hashlib.sha256(f"{captured} {url or ''}".encode()).digest()
    n = (capture_id or 0) & (2**64 - 1)
    low = (n & 15) << 58 | (capture_id is None) << 57 | int.from_bytes(rest[:8]) >> 7
    bits = (n >> 16) << 80 | 8 << 76 | ((n >> 4) & 0xFFF) << 64 | 2 << 62 | low
    h = f"{bits:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def capture_of(name: str) -> int | None:
    """The id that record_id() has put into a name; of other names none."""
    h = re.sub(r"^<?urn:uuid:|[->]", "", name.strip())
    if not re.fullmatch(r"[0-9a-f]{12}8[0-9a-f]{3}[89ab][0-9a-f]{15}", h):
        return None
    bits = int(h, 16)
    n = (bits >> 80) << 16 | ((bits >> 64) & 0xFFF) << 4 | (bits >> 58) & 15
    return None if bits >> 57 & 1 else n - (n >> 63 << 64)


def _date(seconds: int) -> str:
    seconds = min(max(seconds, -62_135_596_800), 253_402_300_799)  # the years 1 to 9999
    return datetime.fromtimestamp(seconds, UTC).isoformat().replace("+00:00", "Z")


def _seconds(date: str) -> int:
    return int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp())


def _uri(url: str) -> str:
    """The URL on one line: control characters, spaces and angle brackets are percent-encoded."""
    return re.sub(r"[\x00-\x20<>\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(row: dict) -> bytes:
    """A whole record: capture_id, url, captured (seconds), payload, digest; refers (capture_id, captured, url) in revisits."""
    refers = row["refers"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    block = http if refers else http + row["payload"]
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(row["capture_id"], row["url"], row["captured"]))]
    head.append(("WARC-Date", _date(row["captured"])))
    if row["url"] is not None:
        head.append(("WARC-Target-URI", _uri(row["url"])))
    head.append(("WARC-Payload-Digest", f"sha256:{row['digest']}"))
    if refers:
        head.append(("WARC-Profile", REVISIT_PROFILE))
        head.append(("WARC-Refers-To", record_id(refers["capture_id"], refers["url"], refers["captured"])))
        if refers["url"] is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(refers["url"])))
        head.append(("WARC-Refers-To-Date", _date(refers["captured"])))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


def member(content: bytes) -> bytes:
    """The content as a gzip member, without its last byte, which is zero."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packed.compress(content) + packed.flush()
    return out[:-1] if not out[-1] else out + EMPTY_MEMBER[:-1]


@dataclass
class Record:
    offset: int
    length: int
    head: dict[str, str]
    block: bytes


def _members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Where each gzip member begins, how long it is and what it holds; a plain file is one."""
    if content[:2] != b"\x1f\x8b":
        yield 0, len(content), content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        unpacker = zlib.decompressobj(31)
        out, step, fed = [], 1 << 20, at
        while not unpacker.eof and fed < len(content):
            out.append(unpacker.decompress(view[fed : fed + step]))
            fed = min(fed + step, len(content))
        if not unpacker.eof:
            raise ValueError(f"a gzip member from byte {at} on has no end")
        end = fed - len(unpacker.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def records(content: bytes) -> Iterator[Record]:
    """The records of an archive, plain or in gzip members of one or more records each."""
    for at, length, held in _members(content):
        first = 0
        while True:
            while held[first : first + 2] == b"\r\n":
                first += 2
            if first >= len(held):
                break
            end = held.find(b"\r\n\r\n", first)
            if not held.startswith(b"WARC/", first) or end < 0:
                raise ValueError(f"no record from byte {at + first} on")
            lines = held[first:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines)}
            size = int(head.get("content-length", "0"))
            block = held[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError(f"the record from byte {at + first} on ends {size - len(block)} bytes too soon")
            plain = content is held
            yield Record(at + first if plain else at, end + 4 + size - first if plain else length, head, block)
            first = end + 4 + size


def capture(found: Record) -> dict | None:
    """What a record tells of its capture; None for records of other kinds. A wrong payload digest raises."""
    kind = found.head.get("warc-type")
    if kind not in CAPTURES:
        return None
    payload, size = found.block, None
    if found.head.get("content-type", "").startswith("application/http"):
        http, _, payload = found.block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(told[1]) if told else None
    digest = found.head.get("warc-payload-digest", "")
    own = digest.removeprefix("sha256:").lower()
    if kind == "revisit":
        own = own if digest.startswith("sha256:") else digest
    else:
        size, real = len(payload), hashlib.sha256(payload).hexdigest()
        if digest.startswith("sha256:") and own != real:
            raise ValueError(f"the payload of the record at byte {found.offset} has digest {real}, not {own}")
        own = real
    return {
        "capture_id": capture_of(found.head.get("warc-record-id", "")),
        "url": found.head.get("warc-target-uri", "").strip("<>") or None,
        "captured": _seconds(found.head["warc-date"]),
        "record_type": "revisit" if kind == "revisit" else "response",
        "refers_to": capture_of(found.head.get("warc-refers-to", "")) if kind == "revisit" else None,
        "payload_bytes": size,
        "payload_digest": own,
        "offset": found.offset,
        "length": found.length,
        "payload": None if kind == "revisit" else payload,
    }


# --- writing -------------------------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, id_column: str, url: str, payload: str, captured: Column, least: int) -> DataFrame:
    """capture_id, url, captured, payload, digest, size and refers, which is null in rows that become responses."""
    bytes_ = F.coalesce(quoted(payload).cast("binary"), F.lit(b""))
    keyed = pages.select(
        quoted(id_column).cast("long").alias("capture_id"),
        quoted(url).cast("string").alias("url"),
        F.coalesce(captured.cast("long"), F.lit(0)).alias("captured"),
        bytes_.alias("payload"),
        F.sha2(bytes_, 256).alias("digest"),
        F.octet_length(bytes_).cast("long").alias("size"),
    )
    first = F.min(F.struct(F.col("capture_id").isNull().alias("none"), "capture_id", "captured", "url"))
    repeated = keyed.where(F.col("size") >= least).groupBy("digest").agg(first.alias("refers"), F.count(F.lit(1)).alias("rows"))
    repeated = written(repeated.where("rows > 1").select("digest", "refers"), "repeated-payloads")
    size = repeated.agg(F.sum(120 + F.coalesce(F.octet_length("refers.url"), F.lit(0))).alias("bytes")).first()["bytes"] or 0
    dealt = keyed.join(F.broadcast(repeated) if size <= SENT_BYTES else repeated, "digest", "left")
    other = ~F.col("refers.capture_id").eqNullSafe(F.col("capture_id"))
    return dealt.withColumn("refers", F.when(F.col("refers").isNotNull() & other, F.col("refers")))


def write_archives(
    pages: DataFrame, folder: str, captured: Column, id_column: str = "page_id", url: str = "url", payload: str = "html", least: int = 100
) -> None:
    """Writes a record for each row of ``pages`` into new archives (gzip, RECORDS records at most each) in ``folder``.

    ``captured`` gives the time in seconds since 1970; null is 0, and years beyond 1 to 9999 become the nearest of these.
    Payloads are text in UTF-8 or bytes; null is empty. Of equal payloads of at least ``least`` bytes the row with the smallest
    id is a response, the others revisit it; rows that share that id, and smaller payloads, are all responses. Null ids come
    after all others. Control characters, spaces and angle brackets of a URL are percent-encoded; a null URL is left out. Other columns are
    not read, whatever their names; an empty table makes no records. A payload has to fit into a row (2 GiB).
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch)))
            yield from _in_parts(({"value": member(record(r))} for r in rows), pa.schema([("value", pa.binary())]), "value")

    rows = with_roles(pages, id_column, url, payload, captured, least)
    lines = rows.mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
    lines.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(folder)


def _in_parts(rows: Iterable[dict], schema: pa.Schema, heavy: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get(heavy) or b"") + 200
        if size > HELD_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


# --- reading -------------------------------------------------------------------------------------------------------

FIELDS = {
    "run": "string",
    "offset": "bigint",
    "length": "bigint",
    "capture_id": "bigint",
    "url": "string",
    "captured": "bigint",
    "record_type": "string",
    "refers_to": "bigint",
    "payload_bytes": "bigint",
    "payload_digest": "string",
}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each capture in the archives of ``folder``: FIELDS (run is the archive's path, offset and length are where its
    gzip member is, or in plain archives the record) and with ``payloads`` the payload, null in revisits.

    Archives of others may be read as well; records that aren't captures are passed over, and ids that write_archives()
    hasn't given are null. A damaged archive or payload raises. An archive is one row on the way (2 GiB), so that whoever
    writes the result should let Python have one row at a time: captured_runs() does.
    """
    fields = FIELDS | ({"payload": "binary"} if payloads else {})
    schema = pa.schema([(k, _ARROW[v]) for k, v in fields.items()])

    def told(path: str, content: bytes) -> Iterator[dict]:
        try:
            for found in records(content):
                if row := capture(found):
                    yield {k: row[k] for k in fields if k != "run"} | {"run": path}
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                yield from _in_parts(told(path, content), schema, "payload")

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, ", ".join(f"{k} {v}" for k, v in fields.items()))


def url_key(url: Column) -> Column:
    """The host's names from the last to the first, without user, www. and usual ports, then ')' and the path with its query;
    all in lower case. Null and empty have the key ''."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
    host = F.regexp_replace(F.regexp_extract(url, scheme + r"(?:[^/?#@]*@)?([^/?#]*)", 1), r"^(?i:www\.)|:(?:80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(url, scheme + r"[^/?#]*", ""), r"#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url != "", F.lower(key)).otherwise("")


ORDER = ["url_key", "captured", "capture_id", "payload_digest", "run", "offset"]


def captured_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of read_archives() with url_key, stored as runs: those of an archive stand together, by ORDER."""
    found = read_archives(spark, folder).withColumn("url_key", url_key(F.col("url")))
    return written(found.sortWithinPartitions("run", *ORDER[:4], "offset"), "runs", batch=1)


# --- merging -------------------------------------------------------------------------------------------------------


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """All entries of sorted lists, in order, by a tree of losers: a node keeps who lost there, so that a winner's successor
    meets one loser on each level. Equal entries come by their runs."""
    k, at = len(runs), [0] * len(runs)
    if not k:
        return

    def beats(a: int, b: int) -> bool:
        if at[a] == len(runs[a]) or at[b] == len(runs[b]):
            return at[a] < len(runs[a])
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or (x == y and a < b)

    losers = [0] * k
    winners = [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while at[best] < len(runs[best]):
        yield runs[best][at[best]]
        at[best] += 1
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _key(row: tuple) -> tuple:
    """ORDER as Spark sorts it, nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in row)


def capture_histories(runs: DataFrame) -> DataFrame:
    """The captures of captured_runs() in one order, by URL key, time, id and digest: their columns, history_position (from 0,
    over all) and capture (from 1, within the URL key).

    Keys are dealt out by ranges of the whole order, so that a URL with any share of the captures takes several ranges;
    a task holds its range's captures without payloads. What ranges have before them is added up from a row for each range.
    """
    spark = runs.sparkSession
    names = [*runs.columns, "range", "place", "nth"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        parts: dict[str, list[tuple]] = {}
        keys = zip(*(table.column(c).to_pylist() for c in ORDER), strict=True)
        for i, key in enumerate(keys):
            parts.setdefault(key[4], []).append((_key(key), i))
        for part in parts.values():
            part.sort()  # a run's part comes in order unless a shuffle's spills have mixed it
        order = [i for _, i in merged([parts[run] for run in sorted(parts)])]
        table = table.take(pa.array(order, pa.int64()))
        nth, last, n = [], None, 0
        for key in table.column("url_key").to_pylist():
            n, last = (n + 1, key) if key == last else (1, key)
            nth.append(n)
        table = table.append_column("place", pa.array(range(len(table)), pa.int64())).append_column("nth", pa.array(nth, pa.int64()))
        yield from table.combine_chunks().to_batches(10_000)

    dealt = runs.repartitionByRange(partitions(spark), *ORDER).withColumn("range", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    held = written(dealt.mapInArrow(merge, f"{kinds}, place bigint, nth bigint").select(names), "histories")
    edge = lambda of, c: of(F.col(c), F.col("place")).alias(f"{of.__name__}_{c}")
    edges = held.groupBy("range").agg(
        F.count(F.lit(1)).alias("n"), edge(F.min_by, "url_key"), edge(F.max_by, "url_key"), edge(F.max_by, "nth")
    )
    before, carried, last, rows = 0, 0, None, []
    for e in sorted(edges.collect(), key=lambda e: e["range"]):  # a row for each range
        carried = carried if e["min_by_url_key"] == last else 0
        rows.append((e["range"], before, e["min_by_url_key"], carried))
        before, last = before + e["n"], e["max_by_url_key"]
        carried = e["max_by_nth"] + (carried if e["min_by_url_key"] == last else 0)
    starts = spark.createDataFrame(rows, "range int, before long, first string, carried long")
    joined = held.join(F.broadcast(starts), "range")
    more = F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(F.lit(0))
    return joined.select(
        *runs.columns, (F.col("before") + F.col("place")).alias("history_position"), (F.col("nth") + more).alias("capture")
    )


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """The pages have no times: a page is captured page_id seconds (modulo 10 ** 9) after the beginning of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch(spark, "archives")
    write_archives(pages, folder, 1_704_067_200 + F.pmod("page_id", F.lit(10**9)))
    return capture_histories(captured_runs(spark, folder)).select(
        F.col("capture_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "url_key",
        "captured",
        "history_position",
        "capture",
    )


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
         CASE WHEN page_id IS NULL THEN 0 ELSE 1704067200 + ((page_id % 1000000000) + 1000000000) % 1000000000 END AS captured,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), '^(?i:www\.)|:(?:80|443)$', '', 'g') AS host,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '#.*$', '') AS rest
  FROM (SELECT page_id, nullif(url, '') AS url, html FROM pages)
), k AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first,
         coalesce(lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE rest WHEN '' THEN '/' ELSE rest END), '') AS url_key
  FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to,
       url_key, captured::BIGINT AS captured,
       row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST, digest) - 1 AS history_position,
       row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST, digest) AS capture
FROM k
"""

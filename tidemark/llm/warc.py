"""WARC archives: writing captures and assembling transactions from what is read back.

A capture is a request, a response (or revisit) and a metadata record, tied by WARC-Concurrent-To. Records are written through
Spark's text writer with the record end as line separator, so archives go to any file system and are committed by task; each
file is a gzip member holding whole records. Reading parses the files by Content-Length. Assembly joins the records
that name a response in WARC-Concurrent-To (in either direction, or through one another record) and gives a nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
ANCHORS = ("response", "revisit", "resource")
RECORD = (
    "file string, offset long, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, "
    "date string, header_digest string, payload_bytes long, payload_digest string, fields map<string,string>"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: five hex digits make four letters."""
    def letters(h, i):
        v = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substr(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.get(F.transform(F.array(F.sha1(payload)), lambda h: F.concat(*[c for i in range(8) for c in letters(h, i)])), F.lit(0))


def record_id(kind: str, *parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, a, n), F.lit(sep)) for a, n, sep in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, per_file: int = 2000, most_small: int = 500_000) -> None:
    """Writes a capture per distinct row of ``(page_id, url, html)``; a null html is an empty payload.

    Of captures with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id is a response and the
    others revisit it. A row without a page_id is always a response. An empty table writes an archive without records.
    """
    df = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    df = df.withColumns({"n": F.octet_length("body"), "digest": base32_sha1(F.col("body"))})
    again = df.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count_distinct("page_id").alias("c")).where("c > 1").drop("c")
    df = df.join(F.broadcast(again) if again.count() <= most_small else again, "digest", "left")
    rid = record_id("response", F.col("page_id"), F.col("digest"))
    revisit = (F.col("first") < F.col("page_id")) & (F.col("n") >= least_bytes)
    head = lambda kind, own: [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {date}\r\nWARC-Record-ID: ", own, "\r\nWARC-Target-URI: ", F.col("url")]

    def record(parts: list, block: Column) -> Column:
        parts = [*parts, "\r\nContent-Length: ", F.octet_length(block).cast("string"), END, block]
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    get = F.concat(F.lit("GET "), F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", ""), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]*)", 1), F.lit(END))
    request = record([*head("request", record_id("request", F.col("page_id"), F.col("digest"))), "\r\nWARC-Concurrent-To: ", rid, "\r\nContent-Type: application/http;msgtype=request"], get)
    digest = ["\r\nWARC-Payload-Digest: sha1:", F.col("digest"), "\r\nContent-Type: application/http;msgtype=response"]
    response = record([*head("response", rid), *digest], F.concat(http, F.col("body")))
    refers = record([*head("revisit", rid), "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: ", record_id("response", F.col("first"), F.col("digest")), *digest], http)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = record([*head("metadata", record_id("metadata", F.col("page_id"), F.col("digest"))), "\r\nWARC-Concurrent-To: ", rid, "\r\nContent-Type: application/warc-fields"], fields)
    rows = df.select(F.concat(request, F.lit(END), F.when(revisit, refers).otherwise(response), F.lit(END), metadata).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(raw: bytes):
    """``(offset, headers, block)`` of every record; headers are lower-cased names with lists of values."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        stop = raw.index(b"\r\n\r\n", at)
        headers: dict[str, list[str]] = {}
        for line in raw[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode(), []).append(value.strip().decode("utf-8", "replace"))
        n = int(headers["content-length"][0])
        yield at, headers, raw[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def _inflate(raw: bytes) -> bytes:
    """All gzip members of a file, or the bytes themselves."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join(out)


def _records(frames):
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            for at, h, block in parse(_inflate(content)):
                kind, one = h["warc-type"][0], lambda name, h=h: h.get(name, [None])[0]
                payload = fields = None
                if kind in ("response", "resource"):
                    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in (one("content-type") or "") else block
                elif kind == "metadata":
                    fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                rows.append((path, at, kind, one("warc-record-id"), h.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None, None if payload is None else len(payload), digest, fields))
            frame = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in RECORD.replace("map<string,string>", "map").split(",")])
            frame["payload_bytes"] = frame["payload_bytes"].astype("Int64")
            yield frame


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``, with the length and digest of response payloads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInPandas(_records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """``(capture_id, response, requests, metadata, others)``, one row per response, revisit or resource record.

    Another record belongs to the capture that it names in WARC-Concurrent-To, that names it there, or that a record
    it names belongs to. Records that reach no capture are left out; repeated records count once.
    """
    # read several times below, so parsed once
    records = cut(records, "records").withColumn("anchor", F.col("type").isin(*ANCHORS))
    named = records.select("record_id", "anchor", F.explode("concurrent_to").alias("other"))
    anchors = records.where("anchor").select(F.col("record_id").alias("capture_id")).distinct()
    forward = named.where("not anchor").select("record_id", F.col("other"))
    direct = forward.join(anchors, F.col("other") == F.col("capture_id")).select("record_id", "capture_id")
    back = named.where("anchor").select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id"))
    direct = direct.union(back).distinct()
    hop = forward.join(anchors, F.col("other") == F.col("capture_id"), "left_anti")
    through = hop.join(direct.select(F.col("record_id").alias("other"), "capture_id"), "other").select("record_id", "capture_id")
    member = direct.union(through).distinct()
    body = [c for c in records.columns if c != "anchor"]
    rest = records.where("not anchor").join(member, "record_id").select("capture_id", F.struct(*body).alias("r"))
    own = records.where("anchor").select(F.col("record_id").alias("capture_id"), F.struct(*[c for c in body if c != "fields"], "fields").alias("r"))
    pick = lambda *kinds: F.filter("all", lambda r: r["type"].isin(*kinds))
    part = F.struct(*[F.col(f"r.{c}").alias(c) for c in body if c != "fields"], F.map_entries("r.fields").alias("fields"))
    rows = own.union(rest.select("capture_id", F.struct(*[F.col(f"r.{c}").alias(c) for c in body if c != "fields"], F.col("r.fields").alias("fields")).alias("r")))
    found = rows.select("capture_id", part.alias("r")).groupBy("capture_id").agg(F.array_sort(F.collect_set("r")).alias("all"))
    return found.select("capture_id", F.get(pick(*ANCHORS), F.lit(0)).alias("response"), pick("request").alias("requests"), pick("metadata").alias("metadata"), F.filter("all", lambda r: ~r["type"].isin(*ANCHORS, "request", "metadata")).alias("others"))


def captures(records: DataFrame) -> DataFrame:
    """Per capture: page_id (from its metadata), payload length and digest (for revisits those of the record they refer to)."""
    page = F.get(F.filter(F.flatten(F.transform("metadata", lambda m: m["fields"])), lambda e: e["key"] == "page-id"), F.lit(0))["value"]
    flat = assemble(records).select("capture_id", page.alias("p"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("response.payload_bytes").alias("b"), F.col("response.payload_digest").alias("d"), F.size("requests").alias("n_requests"))
    flat = flat.withColumn("page_id", F.expr("try_cast(p as bigint)"))
    sources = flat.where("record_type <> 'revisit'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("b").alias("sb"), F.col("d").alias("sd"))
    joined = flat.join(sources, "to", "left")
    return joined.select("page_id", F.coalesce("b", "sb").alias("payload_bytes"), F.coalesce("d", "sd").alias("payload_digest"), "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL of the captures."""
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS f FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f < page_id THEN f END AS refers_to FROM f"""

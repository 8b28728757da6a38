"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record; request and metadata name the response in
WARC-Concurrent-To. Archives are written by Spark's text writer and read by
its binary reader, so they can lie in any store that Spark reaches; each is
closed at ``ARCHIVE_BYTES``, and a reader inflates it piece by piece and
holds one record at a time.

Which capture is a revisit follows from ids and digests alone; payloads are
never dealt out by digest where the repeated digests fit a broadcast, and
beyond that only those of digests that are no heavy hitters.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import map_arrow
from gridloom.plans.durable import cut, scratch

#: An archive is closed when it holds so many bytes before compression.
ARCHIVE_BYTES = 16 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: Rows of 32-byte keys with an id and a count that are broadcast: some 20 MB. Of more, those with the highest counts are.
BROADCAST_ROWS = 200_000
#: Bytes that are inflated at a time.
CHUNK = 1 << 20
#: Pages carry no time of capture.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)")


def _record(kind: str, record_id: str, block: str, content_type: str, **fields: str) -> str:
    """A record without its last line end, which the text writer adds."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block.encode())}", "", block, ""]
    return "\r\n".join(lines)


def _header_safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_name(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def capture_records(name: str, page_id: str | None, url: str | None, payload: str, digest: str, original: str | None, revisit: bool) -> list[str]:
    """The three records of one capture; ``name`` makes their ids.

    ``original`` is the record id of the one response with this payload: a
    revisit refers to it, the response itself bears it.
    """
    ids = {part: record_name(f"{name}/{part}") for part in ("request", "response", "metadata")}
    uri = _header_safe(url or "")
    match = _URL.match(uri)
    host, path = match.groups() if match else ("", uri)
    size = len(payload.encode())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}"}
    about = f"page-id: {page_id}\r\n" if page_id is not None else "page-id-missing: true\r\n"
    http = "application/http; msgtype="
    if revisit:
        fields |= {"WARC_Profile": PROFILE, "WARC_Refers_To": original or "", "WARC_Refers_To_Date": DATE}
        main = _record("revisit", ids["response"], head, f"{http}response", **fields)
    else:
        ids["response"] = original or ids["response"]
        main = _record("response", ids["response"], head + payload, f"{http}response", **fields)
    return [
        _record("request", ids["request"], f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n", f"{http}request", WARC_Target_URI=uri, WARC_Concurrent_To=ids["response"]),
        main,
        _record("metadata", ids["metadata"], about, "application/warc-fields", WARC_Target_URI=uri, WARC_Concurrent_To=ids["response"]),
    ]


def spread_join(rows: DataFrame, facts: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``facts``, whose ``key`` is unique and whose ``n`` says how many rows have it.

    At most ``broadcast_rows`` facts, the most frequent ones, go to the rows;
    only rows that none of them concerns are dealt out by key, of which each
    then has no large share.
    """
    if facts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(facts.drop("n")), key, "left")
    heavy = cut(facts.orderBy(F.desc("n"), key).limit(broadcast_rows))
    light = facts.join(F.broadcast(heavy.select(key)), key, "left_anti")
    near = rows.join(F.broadcast(heavy.drop("n")), key)
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light.drop("n"), key, "left")
    return near.unionByName(far)


def repeated_payloads(rows: DataFrame) -> DataFrame:
    """``digest, first, alone, n`` of ``id, digest``: the smallest id of each repeated digest and whether one row has it."""
    per_id = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("c"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("least")
    found = per_id.groupBy("digest").agg(least, F.sum("c").alias("n")).where("n > 1 AND least IS NOT NULL")
    return found.select("digest", F.col("least.id").alias("first"), (F.col("least.c") == 1).alias("alone"), "n")


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", broadcast_rows: int = BROADCAST_ROWS
) -> None:
    """Write gzip archives of one capture per row below ``folder``.

    Of rows with equal payloads of at least REVISIT_BYTES the one with the
    smallest id is a response, all others are revisits that refer to it; rows
    that repeat the smallest id are responses too, of which none is referred
    to by its record id, and without any id all are. A null payload is
    empty, a null url has no target.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digest = F.unhex(F.sha2(payload.cast("binary"), 256))
    large = F.octet_length(payload) >= REVISIT_BYTES
    repeated = cut(repeated_payloads(pages.where(large).select(F.col(id_col).alias("id"), digest.alias("digest"))))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), digest.alias("digest"))
    # small payloads are never among the repeated ones
    marked = spread_join(rows, repeated, "digest", broadcast_rows).select(
        F.col("id").cast("string").alias("id"), "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        F.coalesce((F.col("id") == F.col("first")) | F.col("first").isNull(), F.lit(False)).alias("response"),
        F.coalesce("alone", F.lit(False)).alias("alone"),
    )
    run_name = uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, archive, filled = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            numbers, values = [], []
            for page, url, body, digest, response, alone in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                original = record_name(f"{run_name}/{digest}") if alone else None
                records = capture_records(f"{run_name}/{task}/{done}", page, url, body, digest, original, not response)
                done += 1
                numbers += [archive] * len(records)
                values += records
                filled += sum(map(len, records))
                if filled >= ARCHIVE_BYTES:
                    archive, filled = archive + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.string())], ["archive", "value"])

    records = map_arrow(marked, build, "archive int, value string")
    records.write.partitionBy("archive").option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces, all gzip members inflated; it ends where a member is damaged."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + CHUNK] for at in range(0, len(content), CHUNK))
        return
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                piece = member.decompress(content, CHUNK)
                content = member.unconsumed_tail
                if not piece and not content and not member.eof:
                    return  # cut off
                yield piece
        except zlib.error:
            return
        content = member.unused_data


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case, the first of each) and block of each record.

    Content-Length alone says where a block ends. A header without a valid
    one is passed over, as is what does not start like a record at the
    beginning of a line; a record that the end of the file cuts off is left
    out.
    """
    data, rest = bytearray(b"\n"), iter(pieces)

    def more() -> bool:
        piece = next(rest, None)
        data.extend(piece or b"")
        return piece is not None

    while True:
        start = data.find(b"\nWARC/")
        if start < 0:
            del data[: max(0, len(data) - 5)]
            if not more():
                return
            continue
        del data[: start + 1]
        end, seen = data.find(b"\r\n\r\n"), len(data)
        while end < 0:
            if not more():
                return
            end, seen = data.find(b"\r\n\r\n", max(0, seen - 3)), len(data)
        fields: dict[str, str] = {}
        for line in bytes(data[: max(end, 0)]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            continue  # the search goes on behind the first letter
        size = int(length)
        while len(data) < end + 4 + size:
            if not more():
                return
        block = bytes(data[end + 4 : end + 4 + size])
        del data[: end + 4 + size]
        yield fields, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below ``folder``; payloads are left out on request, their size and digest not.

    ``capture`` is the record that this one is concurrent to, or its own id.
    Records without either, and damaged ones, are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")

    def row_of(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields.get("warc-type")
        http = "application/http" in fields.get("content-type", "")
        body = block.partition(b"\r\n\r\n")[2] if http else block
        claimed = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        own = hashlib.sha256(body).hexdigest() if kind == "response" else claimed
        about = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x) if kind == "metadata" else None
        return (
            fields.get("warc-concurrent-to") or fields.get("warc-record-id"), kind, fields.get("warc-record-id"),
            fields.get("warc-target-uri"), fields.get("warc-date"), own, own == claimed, len(body), fields.get("warc-refers-to"),
            body if payloads and kind in ("request", "response") else None, list(about.items()) if about is not None else None,
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_records(inflated(content.as_py())):
                    row = row_of(fields, block)
                    if row[0]:
                        rows.append(row)
                        held += len(row[9] or b"") + 512
                    if held >= CHUNK:
                        yield as_batch(rows)
                        rows, held = [], 0
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    text = pa.string()
    names = ["capture", "kind", "record_id", "uri", "date", "digest", "intact", "size", "refers", "payload", "about"]
    kinds = [text, text, text, text, text, text, pa.bool_(), pa.int64(), text, pa.binary(), pa.map_(text, text)]
    schema = "capture string, kind string, record_id string, uri string, date string, digest string, intact boolean, size long, refers string, payload binary, about map<string,string>"
    return map_arrow(files, parse, schema)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, request, response, metadata``.

    The three are joined through the concurrent-to identifiers: each record
    belongs to the capture of the record it names, or to its own. ``response``
    is the response or revisit record; parts that no record gives are null.
    """

    def part(name: str, *kinds: str):
        there = F.col("kind").isin(*kinds)
        return F.first(F.when(there, F.struct("record_id", "kind", "uri", "date", "digest", "intact", "size", "refers", "payload", "about")), ignorenulls=True).alias(name)

    return records.groupBy("capture").agg(part("request", "request"), part("response", "response", "revisit"), part("metadata", "metadata"))


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Write all rows as WARC archives, read them back and describe each capture.

    Returns ``<id_col>, payload_bytes, payload_digest, record_type,
    refers_to``; sizes and digests of responses are those of the payloads
    read, revisits have those of the response that they refer to by its
    record id (by the payload's digest where several rows have the smallest
    id). Null payloads are empty, a null id stays null, repeated rows are
    captures of their own, further columns are ignored, an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    with scratch(spark) as folder:
        write_warc(pages, folder, id_col, url_col, payload_col, broadcast_rows)
        captures = assemble_captures(read_warc(spark, folder, payloads=False)).select(
            F.col("metadata.about")["page-id"].cast(kind).alias("id"),
            F.col("response.kind").alias("record_type"),
            F.col("response.size").alias("size"),
            F.col("response.digest").alias("digest"),
            F.col("response.record_id").alias("record"),
            F.coalesce("response.refers", F.concat(F.lit("sha256:"), "response.digest")).alias("key"),
        )
        captures = cut(captures)
    responses = captures.where(F.col("record_type") == "response")
    revisits = captures.where(F.col("record_type") == "revisit").select("id", "record_type", "digest", "key")
    wanted = revisits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    named = responses.select(F.col("record").alias("key"), F.col("id").alias("refers_to"), "size")
    by_digest = responses.groupBy("key").agg(F.min("id").alias("refers_to"), F.max("size").alias("size"))
    facts = cut(wanted.join(named.unionByName(by_digest), "key"))
    out = [F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return (
        responses.withColumn("refers_to", F.lit(None).cast(kind)).select(*out)
        .unionByName(spread_join(revisits, facts, "key", broadcast_rows).select(*out))
    )

"""WARC archives through Spark's own text files: bounded chunks as segments, digests carried from chunk to chunk."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: digits of base 32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digits: Column) -> Column:
    """Upper-case base 32 of a SHA-1 given as its 40 hexadecimal digits; 15 of them are 12 digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 15 * g, n), 16, 32), n * 4 // 5, "0") for g, n in enumerate((15, 15, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_record_types(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` to rows (``id``, ``payload_digest``, ``payload_bytes``, ...).

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the
    largest id is the response, the others revisit it; repeated rows of the
    largest id are all responses.  The largest id is a map-side combined
    maximum, so a payload that a third of all rows share is no hot task.
    """
    same = ["payload_digest", "payload_bytes"]
    holders = pages.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.max("id").alias("holder"))
    revisit = F.col("holder").isNotNull() & ~F.coalesce(F.col("id") == F.col("holder"), F.lit(False))
    return pages.join(holders, same, "left").select(
        *pages.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to")
    )


def write_warc(records: DataFrame, path: str, chunk_bytes: int = 1 << 16, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write gzip archives of (``id``, ``uri``, ``payload`` binary, ``payload_digest``, ``record_type``, ``refers_to``) to a new folder.

    Each row becomes one record, or several segments (``continuation`` records) of at most
    ``chunk_bytes`` payload bytes; a row of the written table is one segment and
    the two line ends that close a record are the line separator of the text
    files, so Spark's commit protocol covers the archives.  Revisits carry no payload.
    """
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(0)
    last = F.greatest(F.ceil(size / chunk_bytes).cast("int") - 1, F.lit(0))
    cut = records.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    here, many, first = F.col("record_type") == "response", F.col("last") > 0, F.col("chunk") == 0
    data = F.when(here, F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    block = F.concat(F.when(here & first, F.lit(_HTTP.encode())).otherwise(F.lit(b"")), data)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    own = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.when(first, "").otherwise(F.concat(F.lit(":segment:"), F.col("chunk") + 1)), F.lit(">"))
    none = F.lit("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.col("uri"), r"[\x00-\x20\x7f]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(none),
        F.when(many, line("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"))).otherwise(none),
        F.when(~first, line("WARC-Segment-Origin-ID", urn(F.col("id")))).otherwise(none),
        F.when(many & (F.col("chunk") == F.col("last")), line("WARC-Segment-Total-Length", (F.octet_length("payload") + len(_HTTP)).cast("string"))).otherwise(none),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    lines = cut.withColumn("block", block).select(F.concat(F.encode(head, "utf-8"), F.col("block")).cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class ArchiveReader:
    """Turns the lines of archives into chunk rows; holds one chunk and one running digest at a time."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.head: list[bytes] = []
        self.block: list[bytes] = []
        self.missing = -1  # bytes of the block and its end still to come; -1: within a head
        self.fields: dict[str, str] = {}
        self.record: dict = {}

    def feed(self, lines: list[bytes]) -> list[tuple]:
        """Chunk rows that these lines complete."""
        rows = []
        for line in lines:
            if self.missing < 0:
                if line != b"\r":
                    self.head.append(line)
                    continue
                version, *fields = (x.decode("utf-8").rstrip("\r") for x in self.head)
                if not version.startswith("WARC/1."):
                    raise ValueError(f"no archive record begins here: {version[:80]!r}")
                self.fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in fields)}
                self.head, self.block, self.missing = [], [], int(self.fields["content-length"]) + 4
                continue
            self.block.append(line)
            self.missing -= len(line) + 1
            if self.missing < 0:
                raise ValueError(f"record {self.fields['warc-record-id']} is longer than it tells")
            if not self.missing:
                data = b"\n".join(self.block) + b"\n"
                if not data.endswith(b"\r\n\r\n"):
                    raise ValueError(f"record {self.fields['warc-record-id']} isn't closed")
                rows.append(self._chunk(data[:-4]))
                self.block, self.missing = [], -1
        return rows

    def end(self) -> None:
        if self.head or self.missing >= 0 or self.record.get("open"):
            raise ValueError("the archive ends within a record")

    def _chunk(self, data: bytes) -> tuple:
        f, number = self.fields, int(self.fields.get("warc-segment-number", 1))
        if f["warc-type"] != "continuation":
            if self.record.get("open"):
                raise ValueError(f"a segment is missing before {f['warc-record-id']}")
            self.record = {"type": f["warc-type"], "id": _page(f["warc-record-id"]), "digest": hashlib.sha1(), "bytes": 0, "blocks": 0, "refers": _page(f.get("warc-refers-to")), "next": 1}
            self.record["blocks"] += len(data)
            if f["warc-type"] == "response":
                data = data.partition(b"\r\n\r\n")[2]
        else:
            self.record["blocks"] += len(data)
        r = self.record
        if number != r["next"] or number > 1 and _page(f["warc-segment-origin-id"]) != r["id"]:
            raise ValueError(f"segment {number} of {f['warc-record-id']} is out of order")
        r["digest"].update(data)
        r["bytes"] += len(data)
        r["next"] += 1
        total = f.get("warc-segment-total-length")
        last = total is not None or "warc-segment-number" not in f
        r["open"] = not last
        digest, told = base64.b32encode(r["digest"].digest()).decode(), f["warc-payload-digest"].removeprefix("sha1:")
        if last and r["type"] == "response" and (digest != told or total is not None and int(total) != r["blocks"]):
            raise ValueError(f"payload of {f['warc-record-id']} differs from its digest or length")
        return r["id"], number - 1, last, r["type"], r["bytes"], digest if r["type"] == "response" else told, r["refers"], data if self.with_data else None


def _page(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", urn or "")
    return int(m[1]) if m else None


CHUNKS = "id long, chunk int, last boolean, record_type string, payload_bytes long, payload_digest string, refers_to long, data binary"


def read_warc(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives under ``path``: (``id``, ``chunk``, ``last``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``, ``data``).

    ``payload_bytes`` and ``payload_digest`` of a response cover its payload up to
    and with the chunk, so the row with ``last`` has those of the whole; a
    revisit's digest is the one it tells and it has no bytes.  A task streams the
    lines of its archives and holds one chunk at a time.  Damaged, cut or
    disordered archives end the job with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ArchiveReader(with_data)
        for batch in batches:
            rows = reader.feed(batch.column(0).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
            yield pa.record_batch([pa.array(c, type=t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
        reader.end()

    arrow = pa.schema([("id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("data", pa.binary())])
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(run, CHUNKS)


def page_records(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, chunk_bytes: int = 1 << 16) -> None:
    """Write one record per row of ``pages`` under ``path``; a null payload is empty, a null address is made from the id."""
    payload = F.coalesce(F.encode(F.col(html_col), "utf-8"), F.lit(b""))
    uri = F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), uri.alias("uri"), payload.alias("payload"))
    # Rows meet by hexadecimal digits, which are never null: base 32 before the join would be worked out again, each time from new SHA-1s, in the filter of keys that Spark adds.
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    typed = with_record_types(rows, least_bytes).withColumn("payload_digest", base32(F.col("payload_digest")))
    write_warc(typed, path, chunk_bytes)


def resolved_records(chunks: DataFrame) -> DataFrame:
    """One row per record: (``id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``), a revisit with the bytes of its response.

    ``chunks`` is read twice; pass a written table.
    """
    records = chunks.where("last").select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses = records.where("record_type = 'response'")
    holders = responses.groupBy(F.col("id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(holders, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits)

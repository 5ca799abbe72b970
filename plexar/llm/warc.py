"""WARC records as a chunked record table, written, read back and exported.

An archive is a table of (archive, record_id, chunk, last, data, digest): a record's bytes in WARC/1.1 form, header and
block, cut into rows of at most CHUNK payload bytes. Payloads are cut before they leave the JVM, so that no Python
process ever holds more than one chunk of a payload; each row carries the SHA-256 of the payload so far. Records that
need more than one chunk are put together by (record_id, chunk) when they are read. The table is written and read by
Spark's own reader and writer, so that it works on any store; ``export`` writes ordinary .warc.gz files.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of

CHUNK = 1 << 18
#: Payloads below this many bytes are always responses.
LEAST_REVISIT = 100
RECORD_SCHEMA = "record_id string, chunk int, last boolean, data binary, digest string"


def payload_chunks(payload: Column, chunk: int = CHUNK) -> Column:
    """Rows (no, last, data) of a binary column; an empty payload has one empty row."""
    n = F.greatest(F.ceil(F.octet_length(payload) / chunk), F.lit(1)).cast("int")
    part = lambda i: F.struct(i.alias("no"), (i == n - 1).alias("last"), F.substring(payload, i * chunk + 1, F.lit(chunk)).alias("data"))
    return F.explode(F.transform(F.sequence(F.lit(0), n - 1), part))


def digests(pages: DataFrame, id_col: str, html_col: str, chunk: int = CHUNK) -> DataFrame:
    """(id, bytes, digest) of each row's payload, found chunk by chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, size = hashlib.sha256(), 0
        for b in batches:
            out = []
            for i, no, last, data in zip(b["id"], b["no"], b["last"], b["data"]):
                if no == 0:
                    state, size = hashlib.sha256(), 0
                state.update(data)
                size += len(data)
                if last:
                    out.append((i, size, state.hexdigest()))
            yield pd.DataFrame(out, columns=["id", "bytes", "digest"])

    payload = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), payload_chunks(payload, chunk).alias("x"))
    out = rows.select("id", "x.no", "x.last", "x.data").mapInPandas(run, "id string, bytes long, digest string")
    return out.withColumn("id", F.col("id").cast(pages.schema[id_col].dataType))


def record_types(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, bytes, digest, refers_to) by digest: refers_to is the least id of equal payloads of at least LEAST_REVISIT
    bytes, null for that id itself and for smaller payloads."""
    least = found.where((F.col("bytes") >= LEAST_REVISIT) & F.col("id").isNotNull()).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"))
    least = scratch.save(least, "first")
    joined = found.join(least, F.col("digest") == F.col("d"), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))
    return joined.select("id", "bytes", "digest", refers.alias("refers_to"))


def urn(kind: str, value: object) -> str:
    return f"<urn:{kind}:{value}>"


def header(kind: str, record: str, url: str | None, digest: str, size: int, refers: str | None) -> bytes:
    """A record's header block; size is of the full payload, which a revisit does not hold."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn('page', record)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn('page', refers)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if kind == 'response' else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The archive's rows, RECORD_SCHEMA. A record per row of pages, its payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least LEAST_REVISIT bytes, those of the least id are responses, the others
    revisits of it; smaller payloads and payloads of which no id is known are responses. Rows that repeat an id and a
    payload are told apart by a counter in the record id, which no result shows.
    """
    scratch = Scratch(pages.sparkSession)
    found = scratch.save(digests(pages, id_col, html_col, chunk), "digests")
    types = record_types(found, scratch).select(F.col("digest").alias("d"), F.col("id").alias("i"), "bytes", F.col("refers_to").alias("refers"))
    types = scratch.save(types.groupBy("i", "d").agg(F.first("bytes").alias("bytes"), F.first("refers").alias("refers")), "types")
    html = text_of(html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    rows = rows.join(types, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("d")))
    body = F.encode(F.when(F.col("refers").isNull(), F.col("html")).otherwise(F.lit("")), "UTF-8")
    rows = rows.select(F.col("id").cast("string").alias("name"), "url", "bytes", "d", F.col("refers").cast("string").alias("ref"),
                       body.alias("body"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select("name", "url", "bytes", "d", "ref", "n", payload_chunks(F.col("body"), chunk).alias("x"))
    rows = rows.select("name", "url", "bytes", "d", "ref", "n", "x.no", "x.last", "x.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = hashlib.sha256()
        for b in batches:
            out = []
            for i, url, size, full, refers, n, no, last, data in b.itertuples(index=False):
                kind = "response" if refers is None else "revisit"
                state = hashlib.sha256() if no == 0 else state
                state.update(data)
                head = header(kind, "" if i is None else str(i), url, full, int(size), refers) if no == 0 else b""
                # the counter keeps records of one id apart; it follows a slash, which no id's text needs to avoid
                out.append((f"{'' if i is None else i}/{n}", no, last, head + data + (b"\r\n\r\n" if last else b""), state.hexdigest()))
            yield pd.DataFrame(out, columns=["record_id", "chunk", "last", "data", "digest"])

    return rows.mapInPandas(run, RECORD_SCHEMA)


class Parser:
    """Reads one record from its chunks in order, keeping its header and a running digest, never the payload."""

    def __init__(self) -> None:
        self.head = b""
        self.fields: dict[str, str] | None = None
        self.left = self.size = 0
        self.sha = hashlib.sha256()
        self.tail = b""

    def feed(self, data: bytes) -> bytes:
        """Takes bytes of the record; gives the payload bytes among them."""
        if self.fields is None:
            self.head += data
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return b""
            first, *lines = self.head[:at].decode().split("\r\n")
            if first != "WARC/1.1":
                raise ValueError(f"not a WARC/1.1 record: {first[:40]!r}")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            self.left = int(self.fields["content-length"])
            data = self.head[at + 4 :]
        body, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(body)
        self.size += len(body)
        self.sha.update(body)
        return body

    def result(self) -> tuple[str, int, str, str, str | None]:
        """(record id, full length, full digest, type, refers to), checked against what was read."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        f = self.fields
        bare = lambda v: v.removeprefix("<urn:page:").removesuffix(">")
        digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(f["x-payload-length"])
        if f["warc-type"] == "response" and (digest, size) != (self.sha.hexdigest(), self.size):
            raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
        return bare(f["warc-record-id"]), size, digest, f["warc-type"], bare(f["warc-refers-to"]) if "warc-refers-to" in f else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parser, cols = Parser(), ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        out = []
        for no, last, data in zip(b["chunk"], b["last"], b["data"]):
            parser = Parser() if no == 0 else parser
            parser.feed(data)
            if last:
                out.append(parser.result())
        yield pd.DataFrame(out, columns=cols)


def read_records(archive: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of an archive table's records, ids as text.

    Records of one chunk are read where they lie; others are first brought together and ordered by chunk. A payload
    that does not match its digest, or a record cut short, raises."""
    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    whole = archive.where((F.col("chunk") == 0) & F.col("last"))
    parts = archive.where(~((F.col("chunk") == 0) & F.col("last")))
    n = int(archive.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(n, "record_id").sortWithinPartitions("record_id", "chunk")
    return whole.select("chunk", "last", "data").mapInPandas(_read, schema).unionByName(parts.select("chunk", "last", "data").mapInPandas(_read, schema))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archive to the shared folder and reads it back: (id, payload_bytes, payload_digest, record_type,
    refers_to) per row of pages. Null ids come back null, and so do empty ones, as the archive has no other form for
    them; other columns play no part; null urls have no header line; null html is an empty
    payload. An empty table gives an empty archive. Corner cases as in ``record_chunks``."""
    scratch = Scratch(pages.sparkSession)
    kind = pages.schema[id_col].dataType
    records = read_records(scratch.save(record_chunks(pages, id_col, url_col, html_col), "archive"))
    text = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return records.select(text("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", text("refers_to").alias("refers_to"))


def export(archive: DataFrame, folder: str) -> DataFrame:
    """Writes an archive table as .warc.gz files, a gzip member for each record, and returns (path, records, bytes).

    folder is one that all machines mount. A task writes under a name of its own and renames when it is done, so that a
    lost and repeated task leaves one file. Chunks are compressed as they come."""
    n = int(archive.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = Path(folder) / f"part-{task.partitionId():05d}.warc.gz"
        own = path.with_suffix(f".{task.taskAttemptId()}")
        Path(folder).mkdir(parents=True, exist_ok=True)
        records, member = 0, None
        with own.open("wb") as f:
            for b in batches:
                for no, last, data in zip(b["chunk"], b["last"], b["data"]):
                    if no == 0:
                        member = gzip.GzipFile(fileobj=f, mode="wb", mtime=0, filename="")
                        records += 1
                    member.write(data)
                    if last:
                        member.close()
        size = own.stat().st_size
        own.replace(path)
        yield pd.DataFrame({"path": [str(path)], "records": [records], "bytes": [size]})

    rows = archive.repartition(n, "record_id").sortWithinPartitions("record_id", "chunk")
    return rows.select("chunk", "last", "data").mapInPandas(run, "path string, records long, bytes long")


def records_in(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, payload chunks) of each record of a .warc or .warc.gz file, read as a stream."""
    with (gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: not a WARC/1.1 record: {line[:40]!r}")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                fields[k.strip().lower()] = v.strip()
            left = int(fields["content-length"])

            def body() -> Iterator[bytes]:
                nonlocal left
                while left:
                    data = f.read(min(chunk, left))
                    if not data:
                        raise ValueError(f"{path}: truncated record")
                    left -= len(data)
                    yield data

            yield fields, (rest := body())
            for _ in rest:
                pass
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: record does not end")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the .warc and .warc.gz files of a folder that all machines mount, as ``read_records`` gives
    them; a file is read by one task, as a stream."""
    paths = sorted(str(p) for p in Path(folder).iterdir() if p.name.endswith((".warc", ".warc.gz")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                out = []
                for fields, body in records_in(path):
                    p = Parser()
                    p.fields, p.left, p.tail = fields, int(fields["content-length"]), b"\r\n\r\n"
                    for data in body:
                        p.left -= len(data)
                        p.size += len(data)
                        p.sha.update(data)
                    out.append(p.result())
                yield pd.DataFrame(out, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    return table.mapInPandas(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")

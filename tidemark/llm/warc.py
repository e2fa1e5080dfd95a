"""WARC archives as a Python data source, and web pages written to them with repeated payloads as revisits.

`spark.read.format("warc").load(path)` plans its partitions from the files (small ones share a partition), takes filters on the
record type and on headers, parses a record's headers first, and passes over the payloads of records that it doesn't
want, or of all with the option payload=false, without reading them where the file can be sought in. Files that end in .gz
are read through gzip. Filters reach the source if spark.sql.python.filterPushdown.enabled is set (`read` does so); else Spark
applies them.

`df.write.format("warc").mode("append").save(path)` gives a file a task under a name of its own; the driver lists the files of the
tasks that count in a manifest, so what lost or repeated tasks left is never read.

Defined cases: null payloads are empty; a null url has no WARC-Target-URI and is read as null; control characters in a url
are percent-encoded in the header and decoded on reading; a null page_id is written without X-Page-Id and is read as null;
rows that share a page_id are records each (of one id where their payloads are equal too); an empty table gives an archive without records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from tidemark.llm.common import checkpointed, shared_dir, table

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to string, refers_to_page long, payload_digest string, payload_length long, content_length long, payload binary"
#: Column by header; these can be filtered on before a payload is read.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "warc-refers-to", "refers_to_page": "x-refers-to-page", "payload_digest": "warc-payload-digest"}
#: Files are put together into partitions of about this many bytes; rows are sent to Spark in batches of about that many.
PARTITION, BATCH = 128 << 20, 4 << 20
MANIFEST = "_manifest"
#: Payloads shorter than this are stored each time; digests (about 100 bytes each) are broadcast up to so many.
LEAST, MAX_BROADCAST = 100, 500_000
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("refers_to_page", pa.int64()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary())])


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark's configuration gives it, which no worker need know then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def records(stream: io.BufferedReader, wanted, payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers by lower-case name, content length, payload or None) of the records that `wanted` accepts by their headers."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", "0"))
        body = None
        if not wanted(headers):
            skip(stream, length)
            continue
        if payload:
            body = stream.read(length)
            if len(body) < length:
                raise ValueError("a record ends before its length")
        else:
            skip(stream, length)
        yield headers, length, body


def skip(stream: io.BufferedReader, n: int) -> None:
    if stream.seekable() and not isinstance(stream, gzip.GzipFile):
        stream.seek(n, io.SEEK_CUR)
    else:
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got


def column(headers: dict[str, str], name: str):
    value = headers.get(HEADERS[name])
    if value is None:
        return None
    if name in ("page_id", "refers_to_page"):
        return int(value)
    if name == "target_uri":
        return unquote(value, errors="replace") if "%0" in value or "%1" in value or "%25" in value else value
    if name == "payload_digest":
        return value.removeprefix("sha256:")
    return value.strip("<>") if name in ("record_id", "refers_to") else value


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(column(headers, name) is not None and (values is None or column(headers, name) in values) for name, values in self.tests)

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        listed = fs.get_file_info(pafs.FileSelector(root)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        names = {x.base_name for x in listed}
        if manifests := sorted(x for x in names if x.startswith(MANIFEST)):
            names = set()
            for m in manifests:
                with fs.open_input_stream(f"{root}/{m}") as f:
                    names |= set(json.loads(f.read()))
        files = sorted((x for x in listed if x.base_name in names and re.search(r"\.warc(\.gz)?$", x.base_name)), key=lambda x: x.path)
        out, size = [], PARTITION
        for x in files:
            if size + x.size > PARTITION:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                rows, held = [], 0
                for headers, length, body in records(stream, self.wanted, self.payload):
                    full = headers.get("x-payload-length")
                    rows.append((*(column(headers, c) for c in HEADERS), int(full) if full is not None else length, length, body))
                    held += 500 + len(body or b"")
                    if held > BATCH:
                        yield self._batch(rows)
                        rows, held = [], 0
                if rows:
                    yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def header(name: str, value: str) -> bytes:
    return f"{name}: {value}\r\n".encode()


def record_id(page: int | None, digest: str) -> str:
    """The record of a page's payload; the same for a response and the revisits that refer to it. Without a page, any."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def encoded(url: str) -> str:
    """url on one line: control characters, and percent signs where needed, as percent codes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url.replace("%", "%25")) if re.search(r"[\x00-\x1f\x7f]|%0|%1|%25", url) else url


class WarcWriter(DataSourceArrowWriter):
    """Rows of page_id, url, payload (binary), payload_digest, payload_length, refers_to (a page_id or null) as records."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.warc"
        out = None
        for batch in iterator:
            for i in range(len(batch)):
                row = {c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)}
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                out.write(self.record(row))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    @staticmethod
    def record(row: dict) -> bytes:
        page, url, refers, digest = (row[c].as_py() for c in ("page_id", "url", "refers_to", "payload_digest"))
        body = b"" if refers is not None else row["payload"].as_py() or b""
        lines = [b"WARC/1.1\r\n", header("WARC-Type", "response" if refers is None else "revisit"), header("WARC-Record-ID", record_id(page, digest)), header("WARC-Date", "2024-01-01T00:00:00Z")]
        if url is not None:
            lines.append(header("WARC-Target-URI", encoded(url)))
        if page is not None:
            lines.append(header("X-Page-Id", str(page)))
        lines.append(header("WARC-Payload-Digest", f"sha256:{digest}"))
        if refers is not None:
            lines += [header("WARC-Refers-To", record_id(refers, digest)), header("X-Refers-To-Page", str(refers)), header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), header("X-Payload-Length", str(row["payload_length"].as_py()))]
        lines += [header("Content-Type", "text/html; charset=utf-8"), header("Content-Length", str(len(body))), b"\r\n", body, b"\r\n\r\n"]
        return b"".join(lines)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m and m.name and fs.get_file_info(f"{root}/{m.name}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """A record for each row of pages. Of rows with equal payloads of `least` bytes or more, that with the smallest id is a
    response and the others revisit it. Payloads cross the network only if there are more repeated digests than can be broadcast."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_length") >= least).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"))
    if firsts.count() <= MAX_BROADCAST:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, F.col("payload_digest") == F.col("digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    out = rows.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_digest", "payload_length", refers.alias("refers_to"))
    out.write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    responses = read(spark, path).where("record_type = 'response'")
    responses = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read(spark, path, payload=False).where("record_type = 'revisit'")
    revisits = revisits.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
    return responses.unionByName(revisits)


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""

"""WARC archives: a writer over Spark's own text sink and a Python data source that reads them.

The writer turns rows into whole WARC/1.0 records in JVM expressions and writes them with Spark's
commit protocol, so any file system that Spark writes to will do and lost executors leave no
half-written archive.  Equal payloads of at least ``least`` bytes are stored once; the others
become ``revisit`` records that refer to the stored one.

The reader plans partitions from file sizes, takes over equality predicates on the record type
and on headers, parses a record's headers first, and seeks past the blocks of records that the
predicates reject or whose payload is not asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from placeloom.llm.common import materialize

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"
#: Column of the reader, and the header that it comes from.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


#: Names that Spark's file systems have for what pyarrow calls otherwise; a ``dbfs:`` path is mounted as a local one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(path: str) -> str:
    """The path as pyarrow's file systems name it; paths without a scheme are local."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return SCHEMES.get(scheme, scheme) + ":" + rest


def deduplicated(pages: DataFrame, id_col: str, payload: str, least: int = 100) -> DataFrame:
    """``pages`` with __payload (null as empty), __bytes, __sha256 and __refers (the id it repeats, or null).

    Of equal payloads of at least ``least`` bytes the row with the smallest id is stored; rows
    that share that id are stored too.  A null id is stored only if the group has no other.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    wide = pages.withColumns({"__payload": body, "__bytes": F.octet_length(body).cast("long"), "__sha256": F.sha2(body, 256)})
    groups = wide.where(F.col("__bytes") >= least).groupBy("__sha256").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
    groups = materialize(groups.where("__n > 1 AND __first IS NOT NULL").select("__sha256", "__first"), "warc-groups")
    joined = wide.join(groups, "__sha256", "left")
    return joined.withColumn("__refers", F.when(~F.col(id_col).eqNullSafe(F.col("__first")), F.col("__first"))).drop("__first")


def _clean(c: Column) -> Column:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A"), "\t", "%09"), " ", "%20")


def urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _clean(c), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` to the folder ``path``.

    The tables have no fetch time, so ``date`` is a parameter.  The HTTP head of a revisit keeps
    the length of the full payload.  An empty table gives archives without records.
    """
    rows = deduplicated(pages, id_col, payload, least)
    again = F.col("__refers").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("__bytes").cast("string"), F.lit(END + END))
    block = F.when(again, head).otherwise(F.concat(head, F.col("__payload")))
    length = F.octet_length(head) + F.when(again, 0).otherwise(F.col("__bytes"))
    record = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "),
        urn(F.col(id_col)),
        F.lit(f"{END}WARC-Date: {date}{END}WARC-Target-URI: "),
        _clean(F.col(url)),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"),
        F.col("__sha256"),
        F.when(again, F.concat(F.lit(f"{END}WARC-Refers-To: "), urn(F.col("__refers")), F.lit(f"{END}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        length.cast("string"),
        F.lit(END + END),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END + END).text(path)


@dataclass
class Files(InputPartition):
    """Archives that one task reads, in full."""

    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.tests: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality tests on header columns are taken over; Spark keeps the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and isinstance(f.value, str):
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and all(isinstance(v, str) for v in f.value):
                self.tests.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Small archives are packed together up to the target size; an archive is never split."""
        fs, root = pafs.FileSystem.from_uri(arrow_uri(self.path))
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        out: list[InputPartition] = []
        held, size = [], 0
        for path, n in files:
            if held and size + n > self.target:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, *([Files(held)] if held else [])] or [Files([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c]) in values for c, values in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "http_length", "payload"]
        kinds = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        fs, _ = pafs.FileSystem.from_uri(arrow_uri(self.path))
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = io.BufferedReader(raw, 1 << 20)
                for headers, length, payload in records(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream, self.wanted, self.payloads):
                    rows.append((*[headers.get(h) for h in HEADERS.values()], length, payload))
                    size += 500 + len(payload or b"")
                    if size >= self.batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def records(stream: io.BufferedIOBase, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, HTTP content length, payload) of the wanted records; other blocks are skipped unread."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left = int(headers.get("content-length", 0))
        if not wanted(headers):
            stream.seek(left, 1)
            continue
        length = payload = None
        if headers.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if not line.strip():
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    length = int(value)
        if payloads and headers.get("warc-type") != "revisit":
            payload = stream.read(left)
        else:
            stream.seek(left, 1)
        yield headers, length, payload


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", ...)``; option payloads=false leaves payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``; equality filters on header columns are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to of every page record, in one reading.

    Lengths and digests of responses are those of the payloads read back; revisits, whose
    payloads are elsewhere, give what their headers say.
    """
    found = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    again = F.col("record_type") == "revisit"
    full = found.withColumns(
        {
            "payload_bytes": F.when(again, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")),
            "payload_digest": F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)),
        }
    )
    return full.select("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")

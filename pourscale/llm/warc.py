"""WARC archives: a writer, and a PySpark data source that reads them.

A file is ``.warc.gz``: a warcinfo record, then a gzip member for each record. Each
member's gzip header carries its packed size (extra field ``sl``), so the reader can
step over a member without inflating it, and inflates a member's record header before
it decides on the payload. The data source

* plans partitions of whole files of about ``partition_bytes``,
* takes filters on record_type, target_uri, record_id and page_id to the files,
* inflates headers first and skips the payloads of records that the filters drop,
  and all payloads where the option ``payload`` is ``false``.

Members without the size field, as other writers leave them, are inflated through.
"""

from __future__ import annotations

import uuid
import zlib
from struct import pack, unpack_from

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from pourscale.llm.common import written

LEAST_BYTES = 1000  # smaller payloads are never revisits
PARTITION_BYTES = 64 << 20
EPOCH = "2024-01-01T00:00:00Z"
HEAD_BYTES = 4096
SCHEMA = "record_id string, record_type string, target_uri string, page_id bigint, refers_to bigint, payload_digest string, payload_length bigint, content_length bigint, payload binary"
_FILTERED = ("record_id", "record_type", "target_uri", "page_id")
_PAGE = "urn:page:"


def member(record: bytes) -> bytes:
    """One gzip member with its packed size in the extra field."""
    squeezed = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeezed.compress(record) + squeezed.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + pack("<H2sHI", 8, b"sl", 4, size) + body + pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, page_id: int, uri: str | None, digest: str, length: int, refers_to: int | None, payload: bytes) -> bytes:
    """A response record, or a revisit record without payload."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PAGE}{page_id}>", f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", f"Content-Length: {len(block)}", "Content-Type: text/html; charset=utf-8",
    ]
    if uri is not None:
        head.insert(4, f"WARC-Target-URI: {''.join(uri.splitlines())}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, length, record_type and refers_to for each row of pages.

    Null html is an empty payload. Of equal payloads of least_bytes or more the row with the largest
    page_id is the response; rows that share that id are responses too. Null ids: the row is a
    response unless an equal payload has an id.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload")).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("bigint")})
    # only payloads that occur again can be revisits: the others need not meet
    same = rows.where(F.col("length") >= least_bytes).groupBy("digest", "length").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).where("n > 1").select("digest", "length", "first")
    rows = rows.join(same, ["digest", "length"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "payload", "digest", "length", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the list of files: file, bytes, records.

    A task writes one file under a name of its own and counts once it is listed.
    """

    def save(batches):
        name, n = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
        store, where = fs.FileSystem.from_uri(name)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(where.rpartition("/")[0])
                    out = store.open_output_stream(where, compression=None)
                    info = b"software: pourscale\r\nformat: WARC File Format 1.1\r\n"
                    out.write(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {EPOCH}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                out.write(member(record(row["record_type"], row["page_id"], row["url"], row["digest"], row["length"], row["refers_to"], row["payload"])))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([n])], ["file", "bytes", "records"])

    return written(with_roles(pages, least_bytes).mapInArrow(save, "file string, bytes bigint, records bigint"), "warc-files")


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(value: str | None) -> int | None:
    value = (value or "").strip("<>").removeprefix(_PAGE)
    return int(value) if value.lstrip("-").isdigit() else None


def records(source, size: int, wanted, payload: bool):
    """(headers, block) of the wanted records of a gzip file; block is None unless payload is asked for."""
    at = 0
    while at < size:
        source.seek(at)
        chunk = source.read(min(size - at, HEAD_BYTES))
        sized = len(chunk) >= 20 and chunk[3] & 4 and unpack_from("<H2sH", chunk, 10) == (8, b"sl", 4)
        length = unpack_from("<I", chunk, 16)[0] if sized else None
        inflater = zlib.decompressobj(31)
        text = inflater.decompress(chunk, HEAD_BYTES)
        fed = len(chunk)

        def more(limit: int) -> bytes:
            nonlocal fed
            raw = inflater.unconsumed_tail
            if not raw:
                raw = source.read(min(size - at - fed, 1 << 20 if limit else HEAD_BYTES))
                fed += len(raw)
            return inflater.decompress(raw, limit) if raw else b""

        while (end := text.find(b"\r\n\r\n")) < 0 and (got := more(HEAD_BYTES)):
            text += got
        head = _headers(text[:end])
        take = wanted(head)
        if take and payload:
            need, parts = end + 4 + int(head.get("content-length", 0)), [text]
            have = len(text)
            while have < need and (got := more(need - have)):
                parts.append(got)
                have += len(got)
            yield head, b"".join(parts)[end + 4 : need]
        elif take:
            yield head, None
        if length is None:
            while not inflater.eof and more(1 << 20):
                pass
            length = fed - len(inflater.unused_data)
        at += length


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [line.rsplit("\t", 1) for line in options["files"].split("\n") if line]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if isinstance(f, (EqualTo, In)) and name in _FILTERED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[name] = self.allowed.get(name, values) & values
            elif not (isinstance(f, IsNotNull) and name == "record_type"):
                yield f

    def partitions(self):
        groups, total = [[]], 0
        for name, size in self.files:
            if groups[-1] and total + int(size) > self.partition_bytes:
                groups.append([])
                total = 0
            groups[-1].append((name, int(size)))
            total += int(size)
        return [InputPartition(g) for g in groups]

    def read(self, partition):
        def row(head):
            uri = head.get("warc-target-uri")
            own = head.get("warc-record-id", "").strip("<>")
            number = lambda k: int(head[k]) if k in head else None
            return (own, head.get("warc-type"), uri, _page(own), _page(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("x-payload-length"), number("content-length"))

        places = {"record_id": 0, "record_type": 1, "target_uri": 2, "page_id": 3}

        def wanted(head):
            found = row(head)
            return found[1] is not None and all(found[places[k]] in v for k, v in self.allowed.items())

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()]
        for name, size in partition.value:
            store, where = fs.FileSystem.from_uri(name)
            with store.open_input_file(where) as source:
                held, total = [], 0
                for head, block in records(source, size, wanted, self.payload):
                    held.append((*row(head), block))
                    total += len(block or b"")
                    if len(held) >= 1024 or total >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, total = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of listed files (file, bytes), as SCHEMA has them. The list, not the data, goes through the driver."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    listed = "\n".join(f"{r['file']}\t{r['bytes']}" for r in files.select("file", "bytes").orderBy("file").collect())
    return spark.read.format("warc").option("files", listed).option("payload", str(payload).lower()).load()

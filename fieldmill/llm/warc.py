"""Web archives: a deterministic sharded writer and a checking reader.

Pages are range-sorted by id; each becomes a record whose headers and digests are made anew, compressed as a gzip member of its own.
A record's place in the whole sorted archive, counted in compressed bytes, decides its file: file k holds the
records that begin in [k * roll, (k + 1) * roll). So the files are the same bytes however many tasks and executors make them. A
file is written under a temporary name and moved to its own when whole; a lost task's file is written again, byte for byte. The archive
counts as written when its manifest, itself written under a temporary name, takes its place; the reader opens only what that lists.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_staged, shared_folder, staged

# Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names of records are derived from page id, digest and number under this one.
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-records")
#: An archive's pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"
PAGE_TYPE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
MEMBER_TYPE = "part int, place long, start long, size long, member binary"
FILE_TYPE = "file long, name string, records long, bytes long, sha256 string"
#: Bytes of compressed input that the reader takes at a time, and of payloads that it gives out at a time.
CHUNK = 1 << 20


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _name(page_id: int | None, digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}:{number}')}>"


def _uri(url: str | None) -> str | None:
    """A URL as a header's value: bytes that would end the line or the value are percent-encoded."""
    return url and "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, number: int, url: str | None, payload: bytes, digest: str, leader: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit holds the response's header lines, which tell the payload's size, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    again = [("WARC-Profile", REVISIT), ("WARC-Refers-To", _name(leader, digest, 0)), ("Refers-To-Page-Id", leader)] if revisit else []
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id, digest, number)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        *again, ("Page-Id", page_id), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return _head(fields) + block + END


def _member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member; its header names no time, so that equal records are equal bytes."""
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def _built(least: int):
    """Members of a sorted partition. A row of kind 0 tells the leader of the rows that follow it with its id and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leader, number, place, start = None, None, 0, 0, 0
        for batch in batches:
            rows, held = [], 0
            for part, page_id, digest, kind, refers_to, url, payload in zip(*(c.to_pylist() if i < 6 else c for i, c in enumerate(batch.columns))):
                if now != (page_id, digest):
                    now, leader, number = (page_id, digest), None, 0
                if kind == 0:
                    leader = refers_to
                    continue
                raw = payload.as_py() or b""
                revisit = leader is not None or (number > 0 and len(raw) >= least)
                member = _member(record(page_id, number, url, raw, digest, page_id if leader is None else leader, revisit))
                rows.append((part, place, start, len(member), member))
                number, place, start, held = number + 1, place + 1, start + len(member), held + len(member)
                if held > 16 * CHUNK:
                    yield _members(rows)
                    rows, held = [], 0
            yield _members(rows)

    return run


def _members(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "place", "start", "size", "member"])


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, prefix: str):
    """Files of a partition whose rows come sorted by file, part and place; gives a manifest row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(f"{root}/.tmp", recursive=True)
        number, rows, out = None, [], None

        def close() -> None:
            out.close()
            name = f"{prefix}-{number:08d}.warc.gz"
            store.move(temporary, f"{root}/{name}")
            rows.append((number, name, records, size, digest.hexdigest()))

        for batch in batches:
            for file, member in zip(batch.column("file").to_pylist(), batch.column("member")):
                if file != number:
                    if out:
                        close()
                    number, temporary = file, f"{root}/.tmp/{file}-{uuid.uuid4().hex}"
                    out, digest, records, size = store.open_output_stream(temporary, compression=None), hashlib.sha256(), 0, 0
                    block = f"format: WARC File Format 1.1\r\nisPartOf: {prefix}\r\n".encode()
                    about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(file, "warcinfo", 0)), ("WARC-Date", DATE), ("WARC-Filename", f"{prefix}-{file:08d}.warc.gz"), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
                    first = _member(_head(about) + block + END)
                    out.write(first)
                    digest.update(first)
                    size += len(first)
                raw = member.as_buffer()
                out.write(raw)
                digest.update(raw)
                records, size = records + 1, size + raw.size
        if out:
            close()
        columns = zip(*rows) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "name", "records", "bytes", "sha256"])

    return run


def _store(spark: SparkSession, folder: str):
    """(Hadoop's file system, full address) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(path).toUri().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def write_archive(pages: DataFrame, folder: str, prefix: str = "pages", roll: int = 64 << 20, least: int = 100, per_part: int = 128 << 20) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files of about `roll` compressed bytes into a new folder; gives the manifest.

    Of records with equal payloads of at least `least` bytes the one of smallest page_id is a response, and the others revisit it; smaller ones are all
    responses. The payload is the html in UTF-8. The folder may be in any store that Arrow and Hadoop both open by its address (a
    shared disk, HDFS, an object store).

    Null html is an empty payload; a null url leaves its header out, as does a null page_id, which sorts and counts as larger than
    all others. Repeated ids are records of their own; of those with equal payloads one is the response. Very long pages are
    one record, however long. Other columns are ignored, whatever their names. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    store, root = _store(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if store.exists(path(f"{root}/manifest")):
        raise FileExistsError(f"{root} holds an archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # ids, digests and sizes only: what repeats is found without moving a payload
    slim = staged(base.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "payload-digests")
    large = slim.where(F.col("bytes") >= least)
    led = staged(large.groupBy("digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "payload-leaders")
    told = large.select("page_id", "digest").join(led, "digest").where(~F.col("page_id").eqNullSafe(F.col("leader"))).distinct()
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // per_part))
    none = lambda kind: F.lit(None).cast(kind)
    rows = base.select("page_id", "digest", F.lit(1).alias("kind"), none("long").alias("refers_to"), "url", "payload")
    roles = told.select("page_id", "digest", F.lit(0).alias("kind"), F.col("leader").alias("refers_to"), none("string").alias("url"), none("binary").alias("payload"))
    key = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    # one exchange sorts the payloads and brings what is known of their groups beside them
    ordered = rows.union(roles).repartitionByRange(parts, *key).sortWithinPartitions(*key, "kind", "url").select(F.spark_partition_id().alias("part"), "*")
    members = staged(ordered.mapInArrow(_built(least), MEMBER_TYPE), "members")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = members.groupBy("part").agg(F.sum("size").alias("_size")).select("part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_before"))
    placed = members.join(F.broadcast(starts), "part").select(F.expr(f"(_before + start) div {roll}").alias("file"), "part", "place", "member")
    files = -(-(members.agg(F.sum("size")).first()[0] or 1) // roll)
    written = placed.repartition(files, "file").sortWithinPartitions("file", "part", "place").mapInArrow(_writer(root, prefix), FILE_TYPE)
    temporary = f"{root}/.manifest-{uuid.uuid4().hex}"
    written.write.parquet(temporary)
    if not store.rename(path(temporary), path(f"{root}/manifest")):
        raise OSError(f"{root} could not be committed")
    store.delete(path(f"{root}/.tmp"), True)
    for table in (slim, led, members):
        drop_staged(table)
    return spark.read.schema(FILE_TYPE).parquet(f"{root}/manifest")


def records_of(stream) -> Iterator[bytes]:
    """The records of a file, one after another; holds one record and a chunk of the file."""
    raw, made, parts = stream.read(CHUNK), zlib.decompressobj(31), []
    while raw:
        parts.append(made.decompress(raw))
        raw = made.unused_data
        if made.eof:
            yield b"".join(parts)
            made, parts = zlib.decompressobj(31), []
        raw = raw or stream.read(CHUNK)
    if parts:
        raise ValueError("a file ends within a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, checked against its length and block digest."""
    head, found, rest = raw.partition(END)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not found or lines[0].encode() != VERSION or rest[len(block) :] != END or len(block) != int(fields["Content-Length"]):
        raise ValueError("no whole record")
    digest = fields.get("WARC-Block-Digest")
    if digest and digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {fields['WARC-Record-ID']} is not what was written")
    return fields, block


def _reader(folder: str, payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
    names = [*(x.split()[0] for x in PAGE_TYPE.split(", ")), *["payload"] * payloads]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for batch in batches:
            for name, count in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for fields, block in map(parsed, records_of(stream)):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(END)
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
                        page, refers_to = (None if (v := fields.get(k)) is None else int(v) for k in ("Page-Id", "Refers-To-Page-Id"))
                        rows.append((page, fields.get("WARC-Target-URI"), size, digest, kind, refers_to, *([payload if kind == "response" else None] * payloads)))
                        seen, held = seen + 1, held + len(payload) * payloads
                        if len(rows) >= 10_000 or held > 16 * CHUNK:
                            yield given(rows)
                            rows, held = [], 0
                if seen != count:
                    raise ValueError(f"{name} has {seen} records of {count}")
                yield given(rows)

    return run


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per page of an archive that write_archive has committed: page_id, url, payload_bytes, payload_digest, record_type
    (response or revisit), refers_to and, if asked for, the payload of responses. Block and payload digests are worked out anew and must agree."""
    _, root = _store(spark, folder)
    files = spark.read.schema(FILE_TYPE).parquet(f"{root}/manifest").select("name", "records")
    many = files.count()
    kind = PAGE_TYPE + ", payload binary" * payloads
    return files.repartition(max(1, min(many, 10_000))).mapInArrow(_reader(root, payloads), kind)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to a new archive in the shared folder and read back from it."""
    folder = f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder)

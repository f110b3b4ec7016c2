"""Operator 7, WARC: Zstandard archives with a dictionary in the leading skippable frame.

Writing: every row becomes one WARC record in one Zstandard frame of its own. An archive
starts with a skippable frame that holds the dictionary, trained on the archive's first
records. Of the records with equal payloads of at least ``min_payload`` bytes, that with the
largest ``page_id`` is a ``response`` and the others are ``revisit`` records without a
payload that refer to it. Archives are rolled at ``ARCHIVE_BYTES`` and listed in a manifest
table; only archives of tasks that succeeded are in it, so a lost executor leaves at most
an orphan file and never a record twice.

Reading: the manifest's archives are dealt out over the tasks. Each is streamed: the
dictionary is loaded from the skippable frame, then one frame is decoded at a time and
its headers, lengths and digest are validated. Faults come back in the column ``error``.

The equal payloads are found by SHA-1: an aggregate with map-side combine (one row a
digest and task whatever a digest's share of the rows), reduced to the digests that occur
twice or more, then an equi-join that Spark can split where a digest is hot.

Defined cases: null html is an empty payload; a null url gives an empty target; records
with a null page_id revisit the largest non-null id, or are responses where there is none;
repeated rows of the largest id are all responses. An empty table gives no archive and no
row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import bound_batches, fresh_path, table

ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on an archive's first records, up to so many bytes of them.
TRAIN_BYTES = 1 << 20
LEVEL = 3
#: Fixed by the formats: magic of a skippable frame used for dictionaries and of a trained dictionary.
SKIPPABLE = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 20

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str):
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x in ("", "none") else int(x)


def record(page_id, url: str, payload: bytes, digest: str, refers_to, is_response: bool) -> bytes:
    """One WARC record, its two closing line ends included."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if not is_response:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained on the samples; too few or too uniform ones give their own first bytes as a plain dictionary."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[: DICTIONARY_BYTES // 2] or b"WARC/1.1\r\n"


def _load(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


class _Writer:
    """Archives of one task under ``folder``."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder = folder
        self.fs.create_dir(self.root, recursive=True)
        self.waiting: list[bytes] = []
        self.held = 0
        self.out = None

    def add(self, rec: bytes):
        """A manifest row when an archive is full."""
        if self.out is None:
            self.waiting.append(rec)
            self.held += len(rec)
            if self.held < TRAIN_BYTES:
                return None
            self._open()
        else:
            self._put(rec)
        return self.close() if self.bytes >= ARCHIVE_BYTES else None

    def _open(self):
        data = _dictionary(self.waiting)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=_load(data), write_content_size=True, write_checksum=True)
        self.records = self.bytes = 0
        for rec in self.waiting:
            self._put(rec)
        self.waiting, self.held = [], 0

    def _put(self, rec: bytes):
        frame = self.zstd.compress(rec)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def close(self):
        if self.out is None:
            if not self.waiting:
                return None
            self._open()
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.name}", self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes (page_id, url, html) under ``folder``; the manifest table, already written."""
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html")
    ).withColumn("sha", F.unhex(F.sha1("html")))
    # octet_length, not length: the bound is on the UTF-8 payload
    twice = (
        rows.where(F.octet_length("html") >= min_payload)
        .groupBy("sha")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & F.col("refers_to").isNotNull())
        .select(F.col("sha").alias("_sha"), "refers_to")
    )
    joined = rows.join(twice, rows["sha"] == twice["_sha"], "left").select("page_id", "url", "html", "sha", "refers_to")

    def run(batches):
        writer = _Writer(folder)
        done = []
        for batch in batches:
            for page_id, url, html, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                is_response = refers_to is None or refers_to == page_id
                digest = base64.b32encode(sha).decode()
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                if row := writer.add(record(page_id, url, html.encode(), digest, refers_to, is_response)):
                    done.append(row)
        if row := writer.close():
            done.append(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    path = f"{folder}/manifest"
    joined.mapInArrow(run, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def _parse(data: bytes) -> tuple:
    """A row of ``RECORDS`` from one frame's bytes; faults are in the last value."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    faults = []
    if not lines[0].startswith("WARC/1."):
        faults.append("version")
    faults += [f"no {k}" for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in field]
    size = int(field["content-length"]) if field.get("content-length", "").isdigit() else -1
    block, tail = rest[: max(size, 0)], rest[max(size, 0) :]
    if len(block) != size or tail != b"\r\n\r\n":
        faults.append("record length")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    kind = field.get("warc-type", "")
    digest = field.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if told != len(payload):
            faults.append("payload length")
        if base32_sha1(payload) != digest:
            faults.append("payload digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in field:
            faults.append("revisit")
    else:
        faults.append("type")
    refers = _page_of(field["warc-refers-to"]) if "warc-refers-to" in field else None
    return (
        _page_of(field.get("warc-record-id", "")), field.get("warc-target-uri"), told, digest, kind, refers,
        payload if kind == "response" else None, ", ".join(faults) or None,
    )


def frames(stream):
    """The decoded frames of one archive, one at a time; bounded by the largest record."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("archive ends in its first header")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("archive has no dictionary frame")
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("archive ends in its dictionary")
    zstd = zstandard.ZstdDecompressor(dict_data=_load(data))
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        one, parts = zstd.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(CHUNK)
            if not rest:
                raise ValueError("archive ends in a frame")
        yield b"".join(parts)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of the manifest's archives; ``payloads=False`` leaves the payloads out once they are checked."""
    spark = manifest.sparkSession
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def batch_of(rows):
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        keep = [i for i, n in enumerate(names) if payloads or n != "payload"]
        return pa.RecordBatch.from_arrays([cols[i] for i in keep], [names[i] for i in keep])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                rows = []
                with where.open_input_stream(name, compression=None) as stream:
                    for data in frames(stream):
                        rows.append(_parse(data))
                        if len(rows) >= 512:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(tasks).mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error")

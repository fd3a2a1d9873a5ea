"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

`plan_records` decides which pages are full responses and which revisit an equal payload,
`write_archives` writes the files to the shared folder, and `read_archives` decodes them frame by
frame and validates version line, headers and lengths; a record that fails has its reason in `error`. Where an archive
breaks off or cannot be decoded, one row says so in `error`, as nothing after that place can be read.

The payload is the html in UTF-8. Nulls: a null html is an empty payload, a null url an empty target.
Of pages with equal payloads of at least `least` bytes, those with the smallest page_id are responses
(rows that repeat this page_id too) and the others revisits; smaller ones are all responses. A null
page_id counts as larger than any other. An empty table gives an empty manifest and no records.
Other columns are ignored. Files carry the task attempt in their names and only those of the
committed attempt are in the manifest, so a lost executor or a second attempt does no harm.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, new_path, smallest_hashes, written

SKIPPABLE = 0x184D2A5D
#: The dictionary is trained on at most so many pages, each of at most so many bytes.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
#: A file is closed at this payload size.
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string"
END = b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest and first_id: the smallest page_id of those with this payload, if others share it."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    big = F.octet_length("html") >= least
    shared = p.where(big).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(shared, "shared-payloads")
    if shared.count() * 100 <= BROADCAST_BYTES:
        shared = F.broadcast(shared)
    return p.join(shared, "digest", "left").withColumn("first_id", F.when(big, F.col("first_id")))


def train_dictionary(pages: DataFrame) -> bytes:
    """From a sample of at most SAMPLE_PAGES different payloads, those with the smallest hashes; empty if there is too little to learn from.

    A bound on the hash is found first, so that only the payloads of the sample come to the driver, whatever the number of pages."""
    fit = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES))
    hashes = sorted(r[0] for r in smallest_hashes(fit.select("digest").distinct(), "digest", SAMPLE_PAGES).collect())
    found = fit.where(F.col("digest").isin(hashes)).groupBy("digest").agg(F.any_value("html").alias("html")).orderBy("digest")
    samples = [r["html"].encode() for r in found.collect()] if hashes else []
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 20 else b""
    except zstd.ZstdError:
        return b""


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, first_id: int | None) -> bytes:
    revisit = first_id is not None and page_id != first_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{first_id}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def parse_record(raw: bytes) -> dict:
    """The columns of RECORD; error is null for a record whose version, headers, lengths and digest are right."""
    out = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"))
    head, sep, rest = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    out["record_type"], out["url"] = fields.get("warc-type"), fields.get("warc-target-uri")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC version line"}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return out | {"error": f"no {missing[0]} header"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + len(END) or not rest.endswith(END):
        return out | {"error": "content-length does not fit the frame"}
    ids = [re.fullmatch(r"<urn:page:(-?\d*)>", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
    out["page_id"], out["refers_to"] = (int(m[1]) if m and m[1] else None for m in ids)
    http, sep, payload = rest[: -len(END)].partition(END)
    length = re.search(rb"(?i)\r\ncontent-length: (\d+)", http)
    if not sep or not length:
        return out | {"error": "no HTTP header"}
    out["payload_bytes"], out["payload_digest"] = int(length[1]), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"]:
            out["error"] = "payload length differs"
        elif hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
            out["error"] = "payload digest differs"
    elif out["record_type"] != "revisit" or out["refers_to"] is None:
        out["error"] = "unknown record type"
    return out


def write_archives(records: DataFrame, dictionary: bytes) -> DataFrame:
    """Writes the records of plan_records and returns the manifest: path, n_records."""
    spark = records.sparkSession
    where = new_path(spark, "warc")
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task, dictionary = TaskContext.get(), shared.value
        fs, root = FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)
        out, size, n, files = None, 0, 0, []
        for batch in batches:
            for page_id, url, html, digest, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first_id"))):
                if out is None:
                    files.append([f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):04d}.warc.zst", 0])
                    out, size = fs.open_output_stream(files[-1][0]), 0
                    if dictionary:
                        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                payload = html.encode()
                out.write(packer.compress(build_record(page_id, url, payload, digest, first_id)))
                files[-1][1] += 1
                size += len(payload)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([f[0] for f in files], pa.string()), "n_records": pa.array([f[1] for f in files], pa.int64())})

    rows = records.select("page_id", "url", "html", "digest", "first_id")
    manifest = written(rows.mapInArrow(write, "path string, n_records long"), "warc-manifest")
    return manifest.withColumn("root", F.lit(where))


ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def leading_dictionary(read) -> tuple[zstd.ZstdCompressionDict | None, bytes]:
    """The dictionary in the leading skippable frame, which may be compressed itself, and the bytes read beyond it."""
    head = b""
    while len(head) < 8 and (part := read(8 - len(head))):
        head += part
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None, head
    left, parts = struct.unpack("<I", head[4:])[0], []
    while left:
        if not (part := read(left)):
            raise ValueError("the archive ends inside the dictionary")
        parts.append(part)
        left -= len(part)
    raw = b"".join(parts)
    return zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw), b""


def frames(read, size: int = 65_536) -> Iterator[bytes]:
    """Decodes one Zstandard frame after the other; read(n) gives the next bytes of the archive."""
    dictionary, data = leading_dictionary(read)
    unpack = zstd.ZstdDecompressor(dict_data=dictionary)
    while data := data or read(size):
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not (data := data or read(size)):
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def records(read, expected: int | None = None) -> Iterator[dict]:
    """The records of an archive; the last one tells in `error` where it breaks, or that records are missing."""
    n, broken = 0, None
    try:
        for raw in frames(read):
            n += 1
            yield parse_record(raw)
    except (ValueError, zstd.ZstdError) as e:
        broken = str(e)
    if broken is None and expected is not None and n != expected:
        broken = f"{expected} records expected"
    if broken is not None:
        yield parse_record(b"") | {"error": f"after {n} records: {broken}"}


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest lists, and one for each place where an archive breaks; columns of RECORD."""
    schema = pa.schema([(k, pa.int64() if t == "long" else pa.string()) for k, t in (x.split() for x in RECORD.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for file in batch.to_pylist():
                fs, _ = FileSystem.from_uri(file["root"])
                with fs.open_input_stream(file["path"]) as src:
                    rows = []
                    for row in records(src.read, file["n_records"]):
                        rows.append(row)
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.repartition(min(n, 100_000)).mapInArrow(read, RECORD)

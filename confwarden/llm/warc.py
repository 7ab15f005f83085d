"""WARC records in seekable Zstandard bundles, and reading them back by record."""

import base64
import hashlib
import os
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from confwarden.llm import words as w
from confwarden.session import land, work_folder

# Magic numbers of the Zstandard seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

BUNDLE = "bundle_id string, n_records long, content binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def payload_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url):
    """A header value: no white space or line ends inside."""
    return "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(record_id, url, payload, refers_to=None):
    """One WARC record; a revisit has the HTTP headers of the full payload and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to:
        head.append(f"WARC-Refers-To: <{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data, offset=0):
    """``(headers, block, end)`` of the record at ``offset``."""
    stop = data.index(b"\r\n\r\n", offset)
    lines = data[offset:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


class Bundle:
    """Records gathered to frames that are compressed alone, with a seek table at the end."""

    def __init__(self, frame_bytes, level):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.index, self.open, self.size = [], [], bytearray(), 0

    def add(self, record_id, data):
        self.index.append((record_id, len(self.frames), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self._close()

    def _close(self):
        if self.open:
            packed = self.pack.compress(bytes(self.open))
            self.frames.append((packed, len(self.open)))
            self.size += len(packed)
            self.open = bytearray()

    def content(self):
        self._close()
        table = b"".join(struct.pack("<II", len(p), n) for p, n in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(p for p, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def frame_places(content):
    """``[(offset, packed size, size)]`` of the frames, from the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    at, places = 0, []
    for packed, size in struct.iter_unpack("<II", content[-9 - 8 * count : -9]):
        places.append((at, packed, size))
        at += packed
    return places


def read_frame(content, place):
    offset, packed, size = place
    return zstandard.ZstdDecompressor().decompress(content[offset : offset + packed], max_output_size=size)


def read_record(content, entry):
    """One record by its index entry; unpacks a single frame."""
    data = read_frame(content, frame_places(content)[entry["frame"]])
    return parse(data, entry["offset"])[:2]


def _write(frame_bytes, bundle_bytes, level):
    def batch_of(bundle):
        content = bundle.content()
        index = [dict(zip(("record_id", "frame", "offset", "length"), x, strict=True)) for x in bundle.index]
        kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        # Named by its content, so a task that runs again writes the same bundle.
        return pa.RecordBatch.from_arrays(
            [pa.array([hashlib.sha256(content).hexdigest()]), pa.array([len(index)], pa.int64()), pa.array([content], pa.binary()), pa.array([index], kind)],
            ["bundle_id", "n_records", "content", "index"],
        )

    def run(batches):
        bundle = Bundle(frame_bytes, level)
        for batch in w.slices(batches, 2):
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers_to = None if first is None else f"urn:x-page:{first}"
                name = f"urn:x-page:{'' if page is None else page}"
                bundle.add(name, record(name, url, (html or "").encode(), refers_to))
                if bundle.size >= bundle_bytes:
                    yield batch_of(bundle)
                    bundle = Bundle(frame_bytes, level)
        if bundle.index:
            yield batch_of(bundle)

    return run


def with_revisits(spark, pages, least_bytes=0):
    """``page_id, url, html, first_id``: of equal payloads all but the least page id refer to it.

    Payloads below ``least_bytes`` are never revisits.  The table of payload digests is summed
    before it moves and landed, so the join can split a payload that a third of all pages share.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    pages = pages.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    long_enough = F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes
    firsts = land(
        pages.where(long_enough)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .select("digest", "first_id"),
        work_folder(spark, "payloads"),
    )
    others = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return pages.join(firsts, "digest", "left").select("page_id", "url", "html", others.alias("first_id"))


def write_bundles(spark, pages, frame_bytes=1 << 18, bundle_bytes=1 << 23, level=3, least_bytes=0):
    """WARC bundles of ``pages`` (page_id, url, html): ``bundle_id, n_records, content, index``.

    ``content`` is a whole file of the seekable format: independent frames of about
    ``frame_bytes``, then the seek table as a skippable frame; ``index`` maps a record id to
    its frame and the offset inside.  A task holds one bundle at a time (``bundle_bytes``
    packed).  Null html is an empty payload, a null url leaves its header out, a null page_id
    has a record id without number.  Of rows that repeat the least page id all are responses.
    """
    return with_revisits(spark, pages, least_bytes).mapInArrow(_write(frame_bytes, bundle_bytes, level), BUNDLE)


def export_files(bundles, folder):
    """Write each bundle as ``<bundle_id>.warc.zst`` into a folder that all executors share."""

    def save(rows):
        for r in rows:
            target = os.path.join(folder, f"{r.bundle_id}.warc.zst")
            part = f"{target}.{os.getpid()}"
            with open(part, "wb") as out:
                out.write(r.content)
            os.replace(part, target)

    bundles.foreachPartition(save)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(urn):
    found = urn.strip("<>").rpartition(":")[2]
    return int(found) if found else None


def _read(batches):
    """Read every record through the seek table; a response's digest is computed anew."""
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for place in frame_places(content):
                data, at = read_frame(content, place), 0
                while at < len(data):
                    headers, block, at = parse(data, at)
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit and (len(body) != size or payload_digest(body) != digest):
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    refers_to = _number(headers["WARC-Refers-To"]) if revisit else None
                    rows.append((_number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], refers_to))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                [x.split()[0] for x in RECORD.split(", ")],
            )


def read_bundles(bundles):
    """One row per record of the bundles; sizes and digests are those of the full payloads."""
    return bundles.select("content").mapInArrow(_read, RECORD)

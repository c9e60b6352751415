"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress by themselves; a skippable frame
at the end of each bundle is its seek table (sizes of all frames), in the public
seekable format. An index row for each record gives bundle, frame and the offset
inside the frame, so one record costs one ranged read and one frame.

Bundles are written by the tasks straight to the shared folder, under another
name until complete; a task that runs twice writes the same bytes again."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, prepare, scratch_folder, shuffle_partitions, written

#: Fixed values of the seekable Zstandard format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def _fs(uri: str):
    """File system and path of a folder, in a task or in the driver."""
    from pyarrow import fs
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def record_id(page_id, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{ordinal}')}>"


def make_record(page_id, url, payload: bytes, refers_to, is_revisit: bool, ordinal: int = 0) -> bytes:
    """One WARC record; a revisit has no payload but tells its digest and size."""
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "urn:none")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id, ordinal)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        head.append(("X-Page-ID", page_id))
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, 0))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-ID", refers_to))
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, header fields, block) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at offset {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} does not end where its length says")
        yield at, stop + 4 - at, head, data[end + 4:stop]
        at = stop + 4


class BundleWriter:
    """Appends records to frames of at least ``frame_bytes`` and closes with the seek table."""

    def __init__(self, out, frame_bytes: int, level: int):
        import zstandard
        self.out, self.frame_bytes = out, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frame, self.frames, self.size = io.BytesIO(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset inside it) of the record."""
        place = len(self.frames), self.frame.tell()
        self.frame.write(record)
        if self.frame.tell() >= self.frame_bytes:
            self.flush()
        return place

    def flush(self) -> None:
        raw = self.frame.getvalue()
        if raw:
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.size += len(packed)
            self.frame = io.BytesIO()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame, from the end of a bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, raw in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(f, at: int, packed: int, size: int) -> bytes:
    import zstandard
    f.seek(at)
    return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)


def payload_digest(html) -> tuple:
    """Expressions of a payload's identity: SHA-256 and length of its bytes."""
    raw = F.coalesce(html, F.lit("")).cast("binary")
    return F.sha2(raw, 256), F.octet_length(raw).cast("long")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18,
                   bundle_bytes: int = 1 << 28, level: int = 3) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record into bundles
    below ``folder``; the index, one row for each record: page_id, record_id,
    bundle, frame, offset, length.

    Of records with equal payloads of at least ``min_revisit_bytes`` that with the
    smallest page_id is the response and the others revisit it; of repeated rows
    of that page_id one is. A null page_id is above every other. A null html is an
    empty payload, a null url the target urn:none. An empty table gives no bundle
    and an empty index; other columns are not read."""
    spark = prepare(pages)
    sha, size = payload_digest(F.col("html"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), sha.alias("sha"), size.alias("size")) \
        .withColumn("k", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "sha"))
    ids = written(rows.filter(F.col("size") >= min_revisit_bytes).select("page_id", "sha", "k"))
    first = ids.groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id")).alias("f"),
                                   F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", F.col("f.page_id").alias("refers_to"))
    several = ids.join(first, "sha").select("k", "refers_to", F.col("page_id").eqNullSafe(F.col("refers_to")).alias("is_first")).distinct()
    n = shuffle_partitions(spark)
    joined = rows.repartition(n, "k").join(written(several).repartition(n, "k"), "k", "left").sortWithinPartitions("k", "url") \
        .withColumn("pid", F.spark_partition_id())
    added = {"record_id": T.StringType(), "bundle": T.StringType(), "frame": T.IntegerType(), "offset": T.LongType(), "length": T.LongType()}

    def run(batches):
        fs, base = _fs(folder)
        writer = name = draft = None
        number, ordinal, last = 0, 0, None

        def close():
            writer.close()
            fs.move(draft, f"{base}/{name}")

        for b in batches:
            made = []
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "k", "refers_to", "is_first", "pid")]
            for page, url, html, k, refers_to, is_first, pid in zip(*cols, strict=True):
                ordinal = ordinal + 1 if k == last else 0
                last = k
                revisit = is_first is not None and (not is_first or ordinal > 0)
                raw = make_record(page, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit, ordinal)
                if writer is None:
                    name = f"bundle-{pid:06d}-{number:04d}.warc.zst"
                    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                    number += 1
                    writer = BundleWriter(fs.open_output_stream(draft), frame_bytes, level)
                frame, at = writer.add(raw)
                made.append((record_id(page, ordinal), name, frame, at, len(raw)))
                if writer.size >= bundle_bytes:
                    close()
                    writer = None
            yield b, None, dict(zip(added, zip(*made, strict=True) if made else [[]] * len(added), strict=True))
        if writer:
            close()

    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    return written(map_arrow(joined, ["page_id"], added, run))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the bundles below ``folder``: page_id (string),
    record_id, bundle, frame, offset, length, record_type, target, payload_bytes,
    payload_digest (bare base32 SHA-1), refers_to (string), payload (null for
    revisits). Frames are dealt out one by one; a response's digest is recomputed."""
    fs, base = _fs(folder)
    from pyarrow.fs import FileSelector
    names = sorted(i.base_name for i in fs.get_file_info(FileSelector(base)) if i.base_name.endswith(".warc.zst"))
    bundles = spark.createDataFrame([(n,) for n in names], "bundle string")

    def tables(batches):
        fs, base = _fs(folder)
        for b in batches:
            rows, out = [], []
            for i, name in enumerate(b.column("bundle").to_pylist()):
                size = fs.get_file_info(f"{base}/{name}").size
                with fs.open_input_file(f"{base}/{name}") as f:
                    for k, entry in enumerate(seek_table(f, size)):
                        rows.append(i)
                        out.append((k, *entry))
            yield b, rows, dict(zip(places, zip(*out, strict=True) if out else [[]] * len(places), strict=True))

    places = {"frame": T.IntegerType(), "at": T.LongType(), "packed": T.LongType(), "size": T.LongType()}
    n = shuffle_partitions(spark)
    frames = map_arrow(bundles.repartition(max(1, min(n, len(names)))), ["bundle"], places, tables) \
        .repartition(n, "bundle", "frame")

    def records(batches):
        fs, base = _fs(folder)
        for b in batches:
            for i, (name, _, at, packed, size) in enumerate(zip(*[b.column(c).to_pylist() for c in ("bundle", *places)], strict=True)):
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = read_frame(f, at, packed, size)
                out = []
                for offset, length, head, block in read_records(data):
                    _, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    n_bytes = int(dict(x.split(": ", 1) for x in block.split(b"\r\n\r\n", 1)[0].decode().split("\r\n")[1:])["Content-Length"])
                    if head["WARC-Type"] == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n_bytes:
                            raise ValueError(f"{name}, frame {b.column('frame')[i]}, offset {offset}: payload and digest differ")
                    else:
                        payload = None
                    out.append((head.get("X-Page-ID"), head["WARC-Record-ID"], offset, length, head["WARC-Type"], head["WARC-Target-URI"],
                                n_bytes, digest, head.get("X-Refers-To-Page-ID"), payload))
                yield b, [i] * len(out), dict(zip(added, zip(*out, strict=True) if out else [[]] * len(added), strict=True))

    s, g = T.StringType(), T.LongType()
    added = {"page_id": s, "record_id": s, "offset": g, "length": g, "record_type": s, "target": s, "payload_bytes": g,
             "payload_digest": s, "refers_to": s, "payload": T.BinaryType()}
    return map_arrow(frames, ["bundle", "frame"], added, records)


def read_one(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its index row: one ranged read of one frame."""
    fs, base = _fs(folder)
    size = fs.get_file_info(f"{base}/{bundle}").size
    with fs.open_input_file(f"{base}/{bundle}") as f:
        return read_frame(f, *seek_table(f, size)[frame])[offset:offset + length]


def archive_folder(spark: SparkSession) -> str:
    return scratch_folder(spark)

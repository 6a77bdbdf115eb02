"""WARC archives as seekable Zstandard bundles.

An archive is a row of independent Zstandard frames, each a group of whole WARC/1.1 records, and a
last skippable frame with the seek table: the compressed and the plain size of every frame.  The index
maps a record to (archive, frame, offset inside the plain frame, length), so one frame is read and
unpacked for a record.  Archives are written by tasks into a folder that all machines share, under a
name of their own and by rename at the end; only archives that the index names count, so a task that
runs twice does no harm.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import c, join_facts
from flowloom.session import materialize, shared_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id {id}, archive string, frame int, offset bigint, length bigint, "
         "record_id string, record_type string")


def record_id(page: str | None, digest: str) -> str:
    """A repeatable name: the same page and payload give the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def record(page, url, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    """The name and the bytes of one record.  A revisit has headers only."""
    name, revisit = record_id(page, digest), refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name),
            ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to)),
                 ("WARC-Refers-To", record_id(str(refers_to), digest))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))),
             ("Content-Type", "text/html; charset=utf-8")]
    block = b"" if revisit else payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return name, b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record begins here")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The last frame of an archive, from (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Archive:
    """Reads frames of a seekable archive by number."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = self.file.read_at(n * entry, size - 9 - n * entry)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", raw, i * entry)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(
            self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


class _Writer:
    """Packs records into frames and frames into archives of bounded size."""

    def __init__(self, folder: str, frame_bytes: int, archive_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.limits = frame_bytes, archive_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.out, self.frames, self.buffer, self.size, self.pending = None, [], [], 0, []

    def add(self, meta: tuple, data: bytes) -> None:
        self.pending.append((meta, self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)

    def flush(self) -> Iterator[tuple]:
        """Close the frame; the index rows of its records."""
        if not self.buffer:
            return
        if self.out is None:
            task = TaskContext.get()
            part = task.partitionId() if task else 0
            self.name = f"{self.folder}/pages-{part:05d}-{uuid.uuid4().hex[:12]}.warc.zst"
            self.out, self.written = self.fs.open_output_stream(self.name + ".part"), 0
        packed = self.pack.compress(b"".join(self.buffer))
        self.out.write(packed)
        self.written += len(packed)
        for meta, at, n in self.pending:
            yield meta[0], self.name, len(self.frames), at, n, meta[1], meta[2]
        self.frames.append((len(packed), self.size))
        self.buffer, self.size, self.pending = [], 0, []
        if self.written >= self.limits[1]:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.fs.move(self.name + ".part", self.name)
        self.out, self.frames = None, []


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Every page with its digest and, where an equal payload has a smaller id, that id."""
    payload = F.coalesce(c(payload_col).cast("string"), F.lit(""))
    rows = pages.select(c(id_col).alias("page_id"), c(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    small = rows.select("page_id", "digest").where(F.octet_length("payload") >= least_bytes)
    first = (small.groupBy("digest").agg(F.min("page_id").alias("refers_to"),
                                         F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    revisit = (join_facts(small, first, ["digest"], "inner")
               .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
               .select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "refers_to"))
    same = rows["page_id"].eqNullSafe(revisit["_id"]) & (rows["digest"] == revisit["_d"])
    return rows.join(revisit, same, "left").drop("_id", "_d")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 100, frame_bytes: int = 1 << 18,
                   archive_bytes: int = 1 << 26, level: int = 6) -> DataFrame:
    """Write one record per row into archives below ``folder`` (a URI that all machines reach).

    Returns the index, one row per record, read from a written table.  A payload is the text in UTF-8,
    null the empty one.  Of equal payloads of at least ``least_bytes`` the row with the smallest id is
    the response, others are revisits of it; rows that repeat that id with that payload are responses
    too.  Null ids have no id header; they come after all others in that choice.  Frames close at
    ``frame_bytes`` of plain text, archives at ``archive_bytes`` of packed bytes; a longer record has
    a frame of its own.  An empty table writes nothing.
    """
    planned = plan_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col,
                            least_bytes=least_bytes)
    schema = INDEX.format(id=dict(planned.dtypes)["page_id"])
    kinds = planned.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        out, done = _Writer(folder, frame_bytes, archive_bytes, level), []

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), arrow.types)], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                page, url, text, digest, refers = (b.column(k)[i].as_py() for k in range(5))
                data = text.encode("utf-8", "surrogatepass")
                name, raw = record(page, url, data, digest, refers)
                out.add((page, name, "revisit" if refers is not None else "response"), raw)
                if out.size >= frame_bytes:
                    done += out.flush()
            if done:
                yield batch(done)
                done = []
        done += out.flush()
        out.close()
        if done:
            yield batch(done)

    return materialize(planned.mapInArrow(run, schema), "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, each checked against its digest.

    A frame is read once for all of its records in the index, so a few rows of the index read a few
    frames.  Returns page_id, url, record_type, refers_to, payload (null in revisits), payload_bytes
    and payload_digest (both of the full payload, in revisits as their headers give them).
    """
    kind = dict(index.dtypes)["page_id"]
    rows = index.repartition("archive").sortWithinPartitions("archive", "frame", "offset")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        held = at = archive = frame = None
        for b in batches:
            d, out = b.to_pydict(), []
            for page, path, number, start, n in zip(d["page_id"], d["archive"], d["frame"],
                                                    d["offset"], d["length"]):
                if path != held:
                    if archive is not None:
                        archive.close()
                    archive, held, at = Archive(fs, path), path, None
                if number != at:
                    frame, at = archive.frame(number), number
                fields, block = parse(frame[start:start + n])
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                if fields.get("X-Page-Id") != (None if page is None else str(page)):
                    raise ValueError(f"the index points to another record in {path}")
                out.append((fields.get("X-Page-Id"), fields.get("WARC-Target-URI"),
                            fields["WARC-Type"], fields.get("X-Refers-To-Page-Id"),
                            None if revisit else block.decode("utf-8", "surrogatepass"),
                            int(fields["X-Payload-Length"]) if revisit else len(block), digest))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64() if i == 5 else pa.string())
                     for i, x in enumerate(zip(*out))],
                    names=["page_id", "url", "record_type", "refers_to", "payload",
                           "payload_bytes", "payload_digest"])
        if archive is not None:
            archive.close()

    read = rows.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, "
                                "payload string, payload_bytes bigint, payload_digest string")
    return (read.withColumn("page_id", F.col("page_id").cast(kind))
            .withColumn("refers_to", F.col("refers_to").cast(kind)))


def archive_folder(spark) -> str:
    """A new folder for archives below the shared one."""
    path = shared_path(spark, "warc")
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    fs, inside = pafs.FileSystem.from_uri(uri)
    fs.create_dir(inside, recursive=True)
    return uri

"""Media columns: payloads as members of archives, read by a Spark data source in byte ranges.

An archive is a run of members (header, media) and an index of their offsets. Media are 8-bit samples:
the UTF-8 bytes of a text, padded with zeros to a positive multiple of 64, deflated behind a small
header. Each write task makes one archive under a name of its own, and each commit lists the archives
of the tasks that won in a manifest of its own, so that lost and repeated tasks leave nothing that is read, and what is
written to a path later comes beside what is there (or, with mode overwrite, in place of it).

Reading plans one partition for each byte range of about `range_bytes` of each archive; a member belongs to
the range that its first byte is in. A partition streams Arrow batches of bounded size, and reads
each member anew by its offset, up to `retries` times, if it can't be read or its checksum is
wrong; after that the row has an error and no media, and other members are not touched. A range looks its members up in
the archive's index by bisection, so no task reads a whole index. Where the index can't be used, the range looks for
members from its start on, by their marks and checksums.

Archives lie in any store that Arrow's file systems know: local and mounted folders, HDFS, S3 (`s3`, `s3a`, `s3n`), GCS.

Defined results: a null or empty text is 64 zeros; a null id stays null; equal texts have equal
media; repeated rows are members of their own; an empty table gives a manifest without archives
and an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import apart, flat, fresh_path

MEMBER = struct.Struct("<4sB3xqQQI4x")  # magic, id is null, id, payload bytes without padding, media bytes, crc32 of the media
MEDIA = struct.Struct("<4sIQ")  # magic, samples a second, samples
END = struct.Struct("<QQ4s")  # members, offset of the index, magic
UNIT, RATE, BATCH, PAGE = 64, 8000, 8 << 20, 4096
MANIFEST = "_MANIFEST"
_STORES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
SCHEMA = "doc_id long, n_bytes long, media binary, error string"


def to_media(payload: bytes) -> bytes:
    """Lossless 8-bit sample media of a payload, padded to a positive multiple of 64 bytes."""
    padded = payload + bytes(-len(payload) % UNIT if payload else UNIT)
    return MEDIA.pack(b"LM8S", RATE, len(padded)) + zlib.compress(padded, 1)


def from_media(media: bytes) -> bytes:
    magic, _, n = MEDIA.unpack_from(media)
    samples = zlib.decompress(memoryview(media)[MEDIA.size :])
    if magic != b"LM8S" or len(samples) != n:
        raise ValueError("not sample media")
    return samples


def features(samples: bytes) -> str:
    """Mean, deviation, crossings of the mid level and the commonest sample of a payload."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = np.arange(256)
    mean = float(counts @ level) / len(x)
    dev = max(0.0, float(counts @ (level * level)) / len(x) - mean * mean) ** 0.5
    high = x > 101  # the middle of a payload's letters
    return f"mean={mean:.4f};dev={dev:.4f};cross={int(np.count_nonzero(high[1:] != high[:-1]))};top={int(counts.argmax())}"


def _store(path: str):
    from pyarrow import fs

    kind, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{_STORES.get(kind, kind)}:{rest}" if rest.startswith("/") and kind else path)


def manifests(store, root: str) -> list[str]:
    """Paths of the manifests of a folder."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(MANIFEST))


def listed(store, path: str) -> list:
    """Names and sizes of a manifest's archives."""
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Made(WriterCommitMessage):
    name: str
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Made:
        store, root = _store(self.path)
        name, offsets, at, out = f"members-{uuid.uuid4().hex}.lma", [], 0, None
        for batch in iterator:
            data, ends = flat(batch.column("text"))
            raw = data.tobytes()
            for i, (a, b, k) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("doc_id").to_pylist(), strict=True)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                media = to_media(raw[a:b])
                out.write(MEMBER.pack(b"LMMB", k is None, k or 0, b - a, len(media), zlib.crc32(media)))
                out.write(media)
                offsets.append(at)
                at += MEMBER.size + len(media)
        if out is None:
            return Made("", 0)
        index = np.array(offsets, "<u8").tobytes()
        out.write(index)
        out.write(END.pack(len(offsets), at, b"LMND"))
        out.close()
        return Made(name, at + len(index) + END.size)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted([m.name, m.size] for m in messages if m is not None and m.name)).encode())
        for path in before:
            archives = listed(store, path)
            store.delete_file(path)
            for name, _ in archives:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int):
        self.path, self.range_bytes, self.retries = path, range_bytes, retries

    def partitions(self) -> list[Range]:
        store, root = _store(self.path)
        found = manifests(store, root)
        if not found:
            raise FileNotFoundError(f"{self.path} has no manifest")
        archives = sorted(x for path in found for x in listed(store, path))
        return [Range(name, i, min(i + self.range_bytes, size)) for name, size in archives for i in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    @staticmethod
    def whole_in(raw: bytes, at: int):
        """The member at a place of a read-ahead block, if all of it is there and sound."""
        if len(raw) - at < MEMBER.size:
            return None
        magic, null, k, n, size, crc = MEMBER.unpack_from(raw, at)
        media = raw[at + MEMBER.size : at + MEMBER.size + size]
        return ((None if null else k), n, media, None) if magic == b"LMMB" and len(media) == size and zlib.crc32(media) == crc else None

    def member(self, store, path: str, offset: int):
        """One member by its offset, with retries of its own."""
        known = (None, None)
        for _ in range(self.retries + 1):
            try:
                with store.open_input_file(path) as f:
                    head = f.read_at(MEMBER.size, offset)
                    magic, null, k, n, size, crc = MEMBER.unpack(head)
                    if magic == b"LMMB":
                        known = (None if null else k), n
                    media = f.read_at(size, offset + MEMBER.size)
                if magic != b"LMMB" or len(media) != size or zlib.crc32(media) != crc:
                    raise OSError("member is damaged")
                return (None if null else k), n, media, None
            except (OSError, struct.error) as e:
                error = f"{path.rpartition('/')[2]}@{offset}: {e}"
        return *known, None, error

    @staticmethod
    def places(f, partition: Range):
        """Offsets of the range's members by the index, page by page; nothing if the index isn't sound."""
        n, index, magic = END.unpack(f.read_at(END.size, f.size() - END.size))
        if magic != b"LMND" or index + 8 * n + END.size != f.size():
            return None
        edges = []
        for wanted in (partition.start, partition.end):  # the first member from there on
            low, high = 0, n
            while high - low > PAGE:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if int.from_bytes(f.read_at(8, index + 8 * middle), "little") < wanted else (low, middle)
            page = np.frombuffer(f.read_at(8 * (high - low), index + 8 * low), "<u8")
            edges.append(low + int(np.searchsorted(page, wanted)))
        mine = np.frombuffer(f.read_at(8 * (edges[1] - edges[0]), index + 8 * edges[0]), "<u8").astype(np.int64)
        if len(mine) and (np.diff(mine, prepend=partition.start - 1).min() <= 0 or mine[-1] >= partition.end):
            return None
        return mine.tolist()

    @staticmethod
    def found(f, partition: Range) -> list[int]:
        """Offsets of the members that begin in the range, found without the index: by checksum, or with another one behind."""
        out, at, size = [], partition.start, f.size()
        while at < min(partition.end, size):
            raw = f.read_at(min(1 << 20, partition.end - at + MEMBER.size), at)
            near = raw.find(b"LMMB")
            if near < 0:
                at += max(1, len(raw) - 3)
                continue
            at += near
            head = f.read_at(MEMBER.size, at)
            if at >= partition.end or len(head) < MEMBER.size:
                break
            n, crc = MEMBER.unpack(head)[4:]
            media = f.read_at(n + 4, at + MEMBER.size) if at + MEMBER.size + n <= size else b""
            there = len(media) >= n and n > 0 and (zlib.crc32(media[:n]) == crc or media[n:] == b"LMMB")
            if there:
                out.append(at)
            at += MEMBER.size + n if there else 1
        return out

    def read(self, partition: Range):
        store, root = _store(self.path)
        if not partition.name:
            return
        path = f"{root}/{partition.name}"
        with store.open_input_file(path) as f:
            mine = self.places(f, partition)
            if mine is None:
                mine = self.found(f, partition)
            rows, size, at, raw = [], 0, 0, b""
            for offset in mine:
                if offset + MEMBER.size > at + len(raw):
                    at, raw = offset, f.read_at(1 << 20, offset)
                row = self.whole_in(raw, offset - at) or self.member(store, path, offset)
                rows.append(row)
                size += len(row[2] or b"")
                if size >= BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media, errors = zip(*rows, strict=True)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """Options: path; range_bytes (8 MB); retries of a member (3)."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("retries", 3)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    docs.sparkSession.dataSource.register(ArchiveSource)
    apart(docs, doc_id=id_col, text=text_col)[0].select(F.col("doc_id").cast("long").alias("doc_id"), "text").write.format("leafmill_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("leafmill_archive").options(**options).load(path)


def _sound(batches):
    for batch in batches:
        bad = batch.filter(pc.is_valid(batch.column("error"))).select(["doc_id", "error"]).slice(0, 1).to_pylist()
        if bad:
            raise OSError(f"document {bad[0]['doc_id']}: {bad[0]['error']}")
        yield batch


def _digest(batches):
    for batch in batches:
        ids, sizes, media, errors = (batch.column(k) for k in ("doc_id", "n_bytes", "media", "error"))
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in media:
            raw = x.as_py()
            samples = from_media(raw) if raw is not None else None
            for k, f in (("payload_bytes", len), ("payload_sha256", lambda s: hashlib.sha256(s).hexdigest()), ("tail_crc32", lambda s: zlib.crc32(s[-UNIT:])), ("feature", features)):
                out[k].append(f(samples) if samples is not None else None)
            out["media_bytes"].append(len(raw) if raw is not None else None)
            out["media_sha256"].append(hashlib.sha256(raw).hexdigest() if raw is not None else None)
        yield pa.record_batch({
            "doc_id": ids, "n_bytes": sizes, "payload_bytes": pa.array(out["payload_bytes"], pa.int64()), "payload_sha256": pa.array(out["payload_sha256"], pa.string()),
            "tail_crc32": pa.array(out["tail_crc32"], pa.int64()), "media_bytes": pa.array(out["media_bytes"], pa.int64()), "media_sha256": pa.array(out["media_sha256"], pa.string()),
            "feature": pa.array(out["feature"], pa.string()), "error": errors,
        })


def media_digest(media: DataFrame, strict: bool = False) -> DataFrame:
    """Sizes, checksums and features of the media read back; if strict, a member that can't be read is an error."""
    return media.mapInArrow((lambda batches: _digest(_sound(batches))) if strict else _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Stores the texts' payloads in the shared folder, reads them back and digests them; fails if one can't be read."""
    path = fresh_path(docs.sparkSession, "archives")
    write_archives(docs, path, id_col, text_col)
    return media_digest(read_archives(docs.sparkSession, path, **options), strict=True)

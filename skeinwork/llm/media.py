"""Media columns: payloads stored losslessly as images in archive directories, and read back by a custom data source.

``store_media`` turns each text into one 8-bit grey PNG (rows of 576 samples) and each partition into one tar archive with
an index of (id, offset, size). ``MediaArchives`` plans byte-range partitions over all archives of a directory; a reader
opens the index, takes the members that begin in its range, and yields Arrow batches of bounded bytes. A member that
can't be read or whose checksums fail is read again by its own offset through a new handle, without the others.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import fresh

WIDTH, PAD = 576, b"\xff"
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 16 << 20, 4 << 20, 4
NO_ID = -(1 << 63)
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """An 8-bit grey image of ``raw``, padded with 255 to a positive multiple of WIDTH samples; the length in a text chunk."""
    rows = max(1, -(-len(raw) // WIDTH))
    samples = np.full((rows, WIDTH + 1), 255, np.uint8)
    samples[:, 0] = 0  # filter type of each row: none
    flat = np.frombuffer(raw, np.uint8)
    whole = len(flat) // WIDTH
    samples[:whole, 1:] = flat[: whole * WIDTH].reshape(whole, WIDTH)
    samples[whole:, 1 : 1 + len(flat) - whole * WIDTH] = flat[whole * WIDTH :]
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(samples, 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[np.ndarray, int]:
    """(samples, length before padding); ValueError where a checksum or the form is wrong."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(data) != n or zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        parts[kind] = data
        at += 12 + n
    if b"IEND" not in parts:
        raise ValueError("the image is cut short")
    width, rows = struct.unpack_from(">II", parts[b"IHDR"])
    samples = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)[:, 1:]
    return samples.reshape(-1), int(parts[b"tEXt"].split(b"\0")[1])


def _filesystem(directory: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(directory if "://" in directory else directory.replace("file:", "file://") if directory.startswith("file:") else "file://" + directory)


def store_media(df: DataFrame, directory: str, id_column: str = "doc_id", text: str = "text") -> int:
    """Writes one archive a partition below ``directory`` (a folder that all executors share); returns the number of members.

    A task writes under a name of its attempt and renames at the end, so a task that runs again replaces its own archive.
    Null text is stored as an empty one, a null id as no id; repeated rows are stored as often.
    """
    fs, path = _filesystem(directory)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(directory)
        task = TaskContext.get()
        name, attempt = f"{path}/part-{task.partitionId():06d}", task.taskAttemptId()
        index, at, buf = [], 0, io.BytesIO()
        with fs.open_output_stream(f"{name}.{attempt}.tmp") as out:
            for b in batches:
                for key, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    image = to_png(raw or b"")
                    info = tarfile.TarInfo(f"{'none' if key is None else key}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.GNU_FORMAT)
                    index.append((NO_ID if key is None else key, at + len(head), len(image)))
                    body = head + image + b"\0" * (-len(image) % 512)
                    at += len(body)
                    out.write(body)
            out.write(b"\0" * 1024)
        if index:
            np.save(buf, np.array(index, np.int64))
            with fs.open_output_stream(f"{name}.idx.{attempt}.tmp") as out:
                out.write(buf.getvalue())
            fs.move(f"{name}.idx.{attempt}.tmp", f"{name}.idx")
            fs.move(f"{name}.{attempt}.tmp", f"{name}.tar")
        else:
            fs.delete_file(f"{name}.{attempt}.tmp")
        yield pa.RecordBatch.from_arrays([pa.array([len(index)], pa.int64())], names=["n"])

    done = df.select(id_column, text).mapInArrow(run, "n long").groupBy().sum("n").first()
    return done[0] or 0


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, directory: str, range_bytes: int, attempts: int):
        self.directory, self.range_bytes, self.attempts = directory, range_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        fs, path = _filesystem(self.directory)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".tar"))
        return [ByteRange(p, lo, min(size, lo + self.range_bytes)) for p, size in found for lo in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, fs: pafs.FileSystem, handle, archive: str, offset: int, size: int) -> bytes:
        """One member, checked; read again by its offset through a new handle when that fails."""
        for attempt in range(self.attempts):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with fs.open_input_file(archive) as again:
                        image = again.read_at(size, offset)
                else:
                    image = handle.read_at(size, offset)
                from_png(image)
                return image
            except (OSError, ValueError, KeyError, struct.error, zlib.error) as e:
                failed = e
        raise OSError(f"{archive}, offset {offset}: {self.attempts} attempts failed") from failed

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, _ = _filesystem(self.directory)
        with fs.open_input_file(part.archive[: -len("tar")] + "idx") as f:
            index = np.load(io.BytesIO(f.read()))
        index = index[(index[:, 1] >= part.start) & (index[:, 1] < part.end)]
        ids, images, held = [], [], 0
        with fs.open_input_file(part.archive) as handle:
            for key, offset, size in index.tolist():
                ids.append(None if key == NO_ID else key)
                images.append(self.member(fs, handle, part.archive, offset, size))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(ids, images)
                    ids, images, held = [], [], 0
        if ids:
            yield self._batch(ids, images)

    @staticmethod
    def _batch(ids: list, images: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("directory", ...)``: id long, media binary."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id long, media binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["directory"], int(self.options.get("rangebytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)))


def read_media(spark: SparkSession, directory: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("directory", directory).option("rangeBytes", range_bytes).load()


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and the shares (in 1/1000) of eight equal bands of sample values."""
    counts = np.bincount(samples, minlength=256)
    total = len(samples)
    mean = float(counts @ np.arange(256)) / total
    deviation = (float(counts @ np.arange(256) ** 2) / total - mean * mean) ** 0.5
    bands = counts.reshape(8, 32).sum(1) * 1000 // total
    return f"{WIDTH}x{total // WIDTH} mean={mean:.3f} sd={deviation:.3f} bands=" + ",".join(map(str, bands.tolist()))


def media_features(media: DataFrame, id_name: str = "doc_id") -> DataFrame:
    """Decodes each stored image and describes its payload; the values depend on the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for image in b.column("media").to_pylist():
                samples, n = from_png(image)
                payload = samples.tobytes()
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=[id_name, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("id", "media").mapInArrow(run, f"{id_name} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_round_trip(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text of ``df`` below the shared folder and returns the features of what is read back.

    Null text counts as empty (one row of 255s); an empty table gives no rows; other columns are not read.
    """
    directory = fresh(df.sparkSession, "media")
    store_media(df, directory, id_column, text)
    return media_features(read_media(df.sparkSession, directory), id_column)

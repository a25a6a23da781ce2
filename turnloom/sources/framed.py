"""Text files read by parts: byte ranges of plain files, frames of zstd files.  One large file is many tasks.

A part need not end at a line.  Lines are numbered over the whole file (what earlier parts hold is a running sum of a row a part), pieces of
one line that lie in several parts share its number and are put together again; all other lines never leave the task that read them.
"""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.ordered import running

CHUNK = 1 << 20
COMPRESSED = (".zst", ".zstd")
#: Fixed values of the zstd format: a frame's first bytes; a frame to skip has 0x50 to 0x5F and these.
FRAME, SKIPPED = b"\x28\xb5\x2f\xfd", b"\x2a\x4d\x18"


def located(path: str):
    """(file system, name there) on any storage that Arrow knows."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@?=&"))


def opened(path: str):
    system, name = located(path)
    return system.open_input_file(name)


def frames(f, size: int):
    """(start, stop) of the frames of a zstd file, found from headers alone.  What isn't a frame ends the file; a cut last frame ends with it."""
    import zstandard

    pos = 0
    while pos < size:
        f.seek(pos)
        head = f.read(18)
        if head[1:4] == SKIPPED and 0x50 <= head[0] <= 0x5F:
            pos += 8 + int.from_bytes(head[4:8], "little")
            continue
        if head[:4] != FRAME:
            return
        start = pos
        checked = zstandard.get_frame_parameters(head).has_checksum
        pos += zstandard.frame_header_size(head)
        last = False
        while not last:
            f.seek(pos)
            block = f.read(3)
            if len(block) < 3:
                pos = size
                break
            v = int.from_bytes(block, "little")
            # a block of one repeated byte stores that byte only
            pos += 3 + (1 if v >> 1 & 3 == 1 else v >> 3)
            last = bool(v & 1)
        pos = min(pos + 4 * checked, size)
        yield start, pos


def _parts(path: str, size: int, part_bytes: int):
    if not path.endswith(COMPRESSED):
        yield from ((a, min(a + part_bytes, size)) for a in range(0, size, part_bytes))
        return
    with opened(path) as f:
        start = stop = None
        for a, b in frames(f, size):
            start, stop = a if start is None else start, b
            if stop - start >= part_bytes:
                yield start, stop
                start = None
        if start is not None:
            yield start, stop


class _Range:
    """The bytes of a file between two places, as a file."""

    def __init__(self, f, start: int, stop: int):
        f.seek(start)
        self.f, self.left = f, stop - start

    def read(self, n: int = -1) -> bytes:
        b = self.f.read(self.left if n < 0 else min(n, self.left))
        self.left -= len(b)
        return b


def _chunks(path: str, start: int, stop: int):
    import zstandard

    with opened(path) as f:
        raw = _Range(f, start, stop)
        if path.endswith(COMPRESSED):
            raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True, closefd=False)
        while b := raw.read(CHUNK):
            yield b


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below a folder, or of a file; names that begin with ``_`` or ``.`` are left out.

    Folders are listed by tasks, so no list of files goes through the driver.  A pattern of folders is left to Spark.
    """
    if any(c in path for c in "*?[{"):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def below(name):
        from pyarrow import fs

        system, root = located(path)
        i = system.get_file_info(name or root)
        if i.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return [i] if i.type == fs.FileType.File else system.get_file_info(fs.FileSelector(i.path))

    def rows(infos):
        out = [(i.path, i.size if i.is_file else None) for i in infos if not i.base_name.startswith(("_", "."))]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 10_000]), (pa.string(), pa.int64()))], ["path", "length"])

    def first(batches):
        for _ in batches:
            yield from rows(below(None))

    def rest(batches):
        # the scheme and host, which Arrow's names lack
        root = located(path)[1].rstrip("/")
        prefix = path.rstrip("/").removesuffix(root)
        for b in batches:
            for name, size in zip(*(c.to_pylist() for c in b.columns)):
                todo = [(name, size)]
                while todo:
                    name, size = todo.pop()
                    if size is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([prefix + name]), pa.array([size], pa.int64())], ["path", "length"])
                        continue
                    for t in rows(below(name)):
                        todo += zip(*(c.to_pylist() for c in t.columns))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.range(0, 1, 1, 1).mapInArrow(first, "path string, length long")
    return top.repartition(n, "path").mapInArrow(rest, "path string, length long")


def file_parts(spark: SparkSession, path: str, part_bytes: int) -> DataFrame:
    """(path, part, start, stop, alone) of all files, ``alone`` where a file is one part; contents of plain files are not read, of zstd files the headers."""
    files = listed(spark, path)

    def cut(batches):
        for b in batches:
            rows = []
            for p, n in zip(*(c.to_pylist() for c in b.columns)):
                parts = list(_parts(p, n, part_bytes))
                rows += [(p, i, a, z, len(parts) == 1) for i, (a, z) in enumerate(parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "part", "start", "stop", "alone"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(cut, "path string, part long, start long, stop long, alone boolean")


def line_pieces(parts: DataFrame, alone: bool = False) -> DataFrame:
    """(path, part, line_no, whole, raw): the lines of each part, and the pieces of lines at its ends.

    ``parts`` has ``before``, the line ends of earlier parts.  Empty pieces are left out.  With ``alone`` the parts that are whole files are
    read, and those only; all their lines are whole.
    """

    def read(batches):
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], ["path", "part", "line_no", "whole", "raw"])

        for b in batches:
            names = ("path", "part", "start", "stop", "alone") if alone else ("path", "part", "start", "stop", "before")
            for path, part, start, stop, line in zip(*(b.column(c).to_pylist() for c in names)):
                if alone:
                    if not line:
                        continue
                    line = 0
                rows, size, rest, inside = [], 0, [], part == 0
                for chunk in _chunks(path, start, stop):
                    *ended, tail = chunk.split(b"\n")
                    for piece in ended:
                        raw, rest = b"".join([*rest, piece]), []
                        if raw:
                            rows.append((path, part, line, inside, raw))
                            size += len(raw)
                        line, inside = line + 1, True
                        if size >= CHUNK:
                            yield table(rows)
                            rows, size = [], 0
                    rest.append(tail)
                if raw := b"".join(rest):
                    rows.append((path, part, line, alone, raw))
                if rows:
                    yield table(rows)

    return parts.mapInArrow(read, "path string, part long, line_no long, whole boolean, raw binary")


def read_lines(spark: SparkSession, path: str, part_bytes: int = 8 << 20) -> DataFrame:
    """(path, line_no, line): lines of all files below ``path`` that aren't empty, plain or zstd, numbered from 0 in their file.

    Lines end with a line feed.  Bytes that aren't UTF-8 become replacement characters.  ``part_bytes`` is the least size of a part before
    decompression; a zstd file of a single frame is one part, which streams.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a given number of partitions, as the rows are few and small but what they stand for is not
    parts = file_parts(spark, path, part_bytes).repartition(n, "path", "part")

    def ends(batches):
        for b in batches:
            rows = [r for r in zip(*(b.column(c).to_pylist() for c in ("path", "part", "start", "stop", "alone"))) if not r[-1]]
            if rows:
                count = [sum(c.count(b"\n") for c in _chunks(p, a, z)) for p, _, a, z, _ in rows]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in list(zip(*rows))[:4]), pa.array(count, pa.int64())], ["path", "part", "start", "stop", "n_ends"])

    # only files of several parts are counted and put together: a file that is one part is opened once
    counted = parts.mapInArrow(ends, "path string, part long, start long, stop long, n_ends long")
    before = running(counted, ["path"], "part", {"before": ("sum", F.col("n_ends"))}, inclusive=False)
    before = before.withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
    pieces = line_pieces(before.repartition(n, "path", "part"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "raw"))), F.lit(b""), lambda a, x: F.concat(a, x.raw))
    cut = pieces.where("not whole").groupBy("path", "line_no").agg(joined.alias("raw"))
    lines = pieces.where("whole").select("path", "line_no", "raw").union(cut.select("path", "line_no", "raw"))
    lines = lines.union(line_pieces(parts, alone=True).select("path", "line_no", "raw"))
    return lines.select("path", "line_no", F.make_valid_utf8(F.col("raw").cast("string")).alias("line"))


def write_frames(lines: DataFrame, path: str, frame_lines: int = 10_000, file_lines: int = 1 << 20, plain: bool = False) -> None:
    """Write (session_id, line_no, line) as ``<path>/<session_id>/<n>.zst``, the lines in order, a zstd frame per ``frame_lines``.

    ``plain`` files have the same lines as text and end in ``.jsonl``.

    A session's file n has the line numbers from n * ``file_lines`` on, so a long session is many files and tasks.  A file gets its
    name when it is whole: a task that runs again replaces it with the same content.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lines.select(F.col("session_id").cast("string").alias("session_id"), F.floor(F.col("line_no") / file_lines).cast("long").alias("n"), "line_no", "line")
    d = d.repartition(n, "session_id", "n").sortWithinPartitions("session_id", "n", "line_no").select("session_id", "n", "line")

    def store(batches):
        import zstandard
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        system, root = located(path)
        held, out, buffer = None, None, []

        def frame():
            if buffer:
                raw = "".join(f"{x}\n" for x in buffer).encode()
                out.write(raw if plain else zstandard.ZstdCompressor().compress(raw))
                buffer.clear()

        def close():
            if held is not None:
                frame()
                out.close()
                system.move(f"{root}/{held[0]}/_{held[1]}.{attempt}", f"{root}/{held[0]}/{held[1]}{'.jsonl' if plain else '.zst'}")

        for b in batches:
            for session, part, line in zip(*(c.to_pylist() for c in b.columns)):
                if held != (session, part):
                    close()
                    held = (session, part)
                    system.create_dir(f"{root}/{session}", recursive=True)
                    out = system.open_output_stream(f"{root}/{session}/_{part}.{attempt}")
                buffer.append(line)
                if len(buffer) >= frame_lines:
                    frame()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["done"])

    d.mapInArrow(store, "done long").write.format("noop").mode("overwrite").save()

"""Data source "episodes": frame rows of robot recordings with their camera frames.

A root holds `meta/info.json`, `meta/stats.json`, `meta/tasks.parquet`,
`meta/episodes/**/*.parquet`, data files and one video file per camera, chunk and
file index. `spark.read.format("episodes")` takes the options

    roots         one path or URI, or several separated by commas
    partitioning  file_group (default), episode, chain, row_block, sequential
    block_size    rows of a row_block
    parallelism   tasks wanted (default: one per slice)
    columns       columns to read; frames of cameras not named aren't decoded
    codec         module:name of a callable (file, start) -> iterator of (seconds, array)
    filesystem    module:name of a callable path -> (pyarrow file system, path in it)

Paths without a scheme are local; URIs (hdfs://, s3://, gs://, file://) open the
file system of that scheme, others by the option `filesystem`. Metadata is read and
checked on the driver; a task gets its own slices with their episodes and opens its
own files, whose row groups outside a slice are skipped.

A codec gets a seekable binary file and gives frames in order of time, from the last
key frame at or before `start` on; frames it can't decode it gives as (None, None).
A frame is the first one of the row's own video file at or after the row's time less
half a frame; frames are never carried from file to file. One frame per camera is
held: the walk goes forward and seeks where the next row lies before it or far ahead.
"""

from __future__ import annotations

import importlib
import json
import posixpath
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

BATCH_BYTES = 128 << 20
#: A row further ahead than these seconds is sought, not walked to.
SEEK_AHEAD = 10.0
REQUIRED = ["total_frames", "total_episodes", "fps", "data_path", "features"]
TENSOR = pa.struct([("data", pa.binary()), ("shape", pa.list_(pa.int32()))])
ITEM_BYTES = {"float32": 4, "float64": 8, "int64": 8, "int32": 4, "bool": 1, "uint8": 1, "video": 1, "image": 1}


def named(name: str) -> Callable:
    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)


def storage(path: str, maker: str | None = None) -> tuple[pafs.FileSystem, str]:
    """File system of a path or URI, and the path in it."""
    if maker:
        return named(maker)(path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Root:
    """Checked metadata of one root. Sent to tasks without its episodes."""

    def __init__(self, path: str, filesystem: str | None = None) -> None:
        self.path, self.filesystem = path.rstrip("/"), filesystem
        if not self._exists("meta", "info.json"):
            raise FileNotFoundError(f"{self.path}: meta/info.json is missing")
        self.info = self._json("meta", "info.json")
        lacking = [k for k in REQUIRED if k not in self.info]
        if lacking:
            raise ValueError(f"{self.path}: info.json lacks {', '.join(lacking)}")
        self.features = self.info["features"]
        self.fps = self.info["fps"]
        self.cameras = sorted(k for k, f in self.features.items() if f.get("dtype") == "video")
        if self.cameras and not self.info.get("video_path"):
            raise ValueError(f"{self.path}: there are video features but no video_path")
        self.episodes = self._episodes()
        self.total = self.episodes[-1]["end"] if self.episodes else 0
        with self.open(self._inside("meta", "tasks.parquet")) as f:
            tasks = pq.read_table(f)
        name = next((c for c in ("task", "__index_level_0__") if c in tasks.column_names), None)
        if name is None:
            raise ValueError(f"{self.path}: tasks.parquet has no task column")
        self.tasks = dict(zip(tasks["task_index"].to_pylist(), tasks[name].to_pylist(), strict=True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("episodes", "_store")}

    def _episodes(self) -> list[dict]:
        fs, base = self.store()
        try:
            found = fs.get_file_info(pafs.FileSelector(posixpath.join(base, "meta/episodes"), recursive=True))
        except FileNotFoundError:
            found = []
        files = sorted(i.path for i in found if i.path.endswith(".parquet"))
        if not files:
            raise FileNotFoundError(f"{self.path}: no episode files")
        need = ["episode_index", "length", "data/chunk_index", "data/file_index", *(f"videos/{c}/{x}" for c in self.cameras for x in ("chunk_index", "file_index", "from_timestamp"))]
        out: list[dict] = []
        for name in files:
            with self.open(name) as f:
                out += pq.read_table(f, columns=need).to_pylist()
        out.sort(key=lambda r: r["episode_index"])
        if [r["episode_index"] for r in out] != list(range(len(out))):
            raise ValueError(f"{self.path}: episode indices are not 0 to {len(out) - 1}")
        at = 0
        for r in out:
            r["start"], r["end"] = at, at + r["length"]
            at = r["end"]
        return out

    def store(self) -> tuple[pafs.FileSystem, str]:
        if "_store" not in self.__dict__:
            self._store = storage(self.path, self.filesystem)
        return self._store

    def open(self, path: str) -> pa.NativeFile:
        return self.store()[0].open_input_file(path)

    def _inside(self, *parts: str) -> str:
        return posixpath.join(self.store()[1], *parts)

    def _exists(self, *parts: str) -> bool:
        return self.store()[0].get_file_info(self._inside(*parts)).type == pafs.FileType.File

    def _json(self, *parts: str) -> dict:
        with self.open(self._inside(*parts)) as f:
            return json.loads(f.read())

    def stats(self) -> dict:
        """Means and deviations as stored with the root; empty if there are none."""
        return self._json("meta", "stats.json") if self._exists("meta", "stats.json") else {}

    def task(self, index: int | None) -> str | None:
        """The task's text; an index that isn't in the root's tasks is an error."""
        if index not in self.tasks:
            raise ValueError(f"{self.path}: unknown task_index {index}")
        return self.tasks[index]

    def data_file(self, e: dict) -> str:
        return self._inside(self.info["data_path"].format(chunk_index=e["data/chunk_index"], file_index=e["data/file_index"]))

    def video_of(self, e: dict, camera: str) -> tuple[int, int]:
        return e[f"videos/{camera}/chunk_index"], e[f"videos/{camera}/file_index"]

    def video_file(self, e: dict, camera: str) -> str:
        chunk, file = self.video_of(e, camera)
        return self._inside(self.info["video_path"].format(video_key=camera, chunk_index=chunk, file_index=file))

    def row_bytes(self) -> int:
        total = 0
        for f in self.features.values():
            n = 1
            for x in f.get("shape") or [1]:
                n *= x
            total += n * ITEM_BYTES.get(f.get("dtype"), 0)
        return max(1, total)


def compatible(roots: list[Root]) -> None:
    """Cameras, rate and other features must agree; the error names both roots."""
    first = roots[0]
    for other in roots[1:]:
        for what, a, b in (("cameras", first.cameras, other.cameras), ("fps", first.fps, other.fps), ("features", sorted(set(first.features) - set(first.cameras)), sorted(set(other.features) - set(other.cameras)))):
            if a != b:
                raise ValueError(f"{what} mismatch: {first.path} has {a}, {other.path} has {b}")


def slices(root: Root, partitioning: str, block_size: int | None) -> list[tuple[int, int]]:
    """Half-open row ranges of a root that cover it without a gap."""
    eps = [e for e in root.episodes if e["end"] > e["start"]]
    if partitioning == "sequential":
        return [(0, root.total)] if root.total else []
    if partitioning == "episode":
        return [(e["start"], e["end"]) for e in eps]
    if partitioning == "row_block":
        if not block_size:
            raise ValueError("row_block needs block_size")
        return [(i, min(i + block_size, root.total)) for i in range(0, root.total, block_size)]
    if partitioning == "file_group":
        label = {e["episode_index"]: tuple(root.video_of(e, c) for c in root.cameras) for e in eps}
    elif partitioning == "chain":
        label = _chains(root, eps)
    else:
        raise ValueError(f"unknown partitioning {partitioning!r}")
    if not root.cameras:
        return [(e["start"], e["end"]) for e in eps]
    out: dict = {}
    for e in eps:
        key = label[e["episode_index"]]
        start, end, rows = out.get(key, (e["start"], e["end"], 0))
        out[key] = (min(start, e["start"]), max(end, e["end"]), rows + e["end"] - e["start"])
    for start, end, rows in out.values():
        if end - start != rows:
            raise ValueError(f"{root.path}: episodes of one {partitioning} slice are not adjacent (rows {start} to {end})")
    return sorted((s, e) for s, e, _ in out.values())


def _chains(root: Root, eps: list[dict]) -> dict[int, int]:
    """Episodes linked by a shared file of any camera, by breadth-first search over
    the files."""
    by_file: dict = {}
    for e in eps:
        for c in root.cameras:
            by_file.setdefault((c, root.video_of(e, c)), []).append(e)
    label: dict[int, int] = {}
    for e in eps:
        if e["episode_index"] in label:
            continue
        todo = [e]
        while todo:
            x = todo.pop()
            if x["episode_index"] in label:
                continue
            label[x["episode_index"]] = e["episode_index"]
            for c in root.cameras:
                todo += by_file.pop((c, root.video_of(x, c)), [])
    return label


@dataclass
class Slices(InputPartition):
    """What one task reads: (root number, start, end, episodes), abutting ranges as one."""

    segments: list[tuple[int, int, int, list[dict]]]


def plan(roots: list[Root], partitioning: str, block_size: int | None, parallelism: int | None) -> list[Slices]:
    parts = sorted((i, s, e) for i, r in enumerate(roots) for s, e in slices(r, partitioning, block_size))
    wanted = min(parallelism or len(parts), len(parts)) or 1
    small, more = divmod(len(parts), wanted)
    out, at = [], 0
    for t in range(wanted):
        own = parts[at : at + small + (t < more)]
        at += len(own)
        joined: list[tuple[int, int, int]] = []
        for i, s, e in own:
            if joined and joined[-1][0] == i and joined[-1][2] == s:
                joined[-1] = (i, joined[-1][1], e)
            else:
                joined.append((i, s, e))
        out.append(Slices([(i, s, e, overlapping(roots[i], s, e)) for i, s, e in joined]))
    return out


def overlapping(root: Root, start: int, end: int) -> list[dict]:
    """The episodes with rows in [start, end); ends of episodes ascend."""
    first = bisect_right(root.episodes, start, key=lambda e: e["end"])
    last = bisect_left(root.episodes, end, key=lambda e: e["start"])
    return [e for e in root.episodes[first:last] if e["end"] > e["start"]]


class FrameWalk:
    """Frames of one camera, forward through one file at a time; holds one frame."""

    def __init__(self, root: Root, codec: Callable) -> None:
        self.root, self.codec, self.path = root, codec, None
        self.file = self.frames = self.time = self.frame = None
        self.passed = 0.0

    def at(self, path: str, target: float):  # noqa: ANN201
        """The first frame at or after `target` less half a frame."""
        least = target - 0.5 / self.root.fps
        if path != self.path or least < self.passed or self.time is not None and least > self.time + SEEK_AHEAD:
            self.close()
            self.file, self.path = self.root.open(path), path
            self.frames = iter(self.codec(self.file, max(0.0, least)))
        self.passed = least
        while self.time is None or self.time < least:
            self.frame = None  # before the next one is decoded
            try:
                self.time, self.frame = next(self.frames)
            except StopIteration:
                raise ValueError(f"{path}: no frame at or after {target:.6f} s") from None
        return self.frame

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = self.path = self.frames = self.time = self.frame = None


class EpisodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "episodes"

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        paths = [p.strip() for p in (options.get("roots") or options.get("path") or "").split(",") if p.strip()]
        if not paths:
            raise ValueError("option roots is missing")
        self.roots = [Root(p, options.get("filesystem")) for p in paths]
        compatible(self.roots)
        first = self.roots[0]
        with first.open(first.data_file(first.episodes[0])) as f:
            data = pq.read_schema(f)
        fields = [*data, *(pa.field(c, TENSOR) for c in first.cameras), pa.field("task", pa.string()), pa.field("dataset_index", pa.int32())]
        wanted = [c.strip() for c in (options.get("columns") or "").split(",") if c.strip()]
        unknown = set(wanted) - {f.name for f in fields}
        if unknown:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        self.arrow = pa.schema([f for f in fields if not wanted or f.name in wanted]).remove_metadata()

    def schema(self):  # noqa: ANN201
        return from_arrow_schema(self.arrow)

    def reader(self, schema) -> EpisodeReader:  # noqa: ANN001
        roots = [r if "episodes" in r.__dict__ else Root(r.path, r.filesystem) for r in self.roots]  # planned in another process
        return EpisodeReader(roots, self.arrow, dict(self.options))


class EpisodeReader(DataSourceReader):
    def __init__(self, roots: list[Root], arrow: pa.Schema, options: dict) -> None:
        self.roots, self.arrow = roots, arrow
        number = lambda k: int(options[k]) if options.get(k) else None
        self.partitioning = options.get("partitioning", "file_group")
        self.block_size, self.parallelism = number("block_size"), number("parallelism")
        self.codec = options.get("codec")

    def partitions(self) -> list[Slices]:
        return plan(self.roots, self.partitioning, self.block_size, self.parallelism)

    def read(self, partition: Slices) -> Iterator[pa.RecordBatch]:
        for i, start, end, hit in partition.segments:
            root = self.roots[i]
            rows = max(1, BATCH_BYTES // root.row_bytes())
            if not hit:
                raise ValueError(f"{root.path}: no episode has rows {start} to {end}")
            cameras = [c for c in root.cameras if c in self.arrow.names]
            if cameras and not self.codec:
                raise ValueError("option codec is missing: frames can't be decoded")
            names = [f.name for f in self.arrow if f.name not in root.cameras and f.name not in ("task", "dataset_index")]
            need = list(dict.fromkeys([*names, "index", "episode_index", "timestamp", "task_index"]))
            walks = {c: FrameWalk(root, named(self.codec)) for c in cameras}
            for path in dict.fromkeys(root.data_file(e) for e in hit):
                with root.open(path) as f:
                    for batch in rows_between(pq.ParquetFile(f), need, start, end, rows):
                        yield self._row_batch(root, i, batch, hit, walks)
            for walk in walks.values():
                walk.close()

    def _row_batch(self, root: Root, number: int, batch: pa.RecordBatch, hit: list[dict], walks: dict[str, FrameWalk]) -> pa.RecordBatch:
        by_index = {e["episode_index"]: e for e in hit}
        columns: dict[str, pa.Array] = {n: batch.column(n) for n in batch.schema.names}
        columns["task"] = pa.array([root.task(t) for t in batch.column("task_index").to_pylist()], pa.string())
        columns["dataset_index"] = pa.array([number] * batch.num_rows, pa.int32())
        for c, walk in walks.items():
            out = []
            for e, t in zip(batch.column("episode_index").to_pylist(), batch.column("timestamp").to_pylist(), strict=True):
                episode = by_index[e]
                out.append(tensor(walk.at(root.video_file(episode, c), episode[f"videos/{c}/from_timestamp"] + t)))
            columns[c] = pa.array(out, TENSOR)
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in self.arrow], schema=self.arrow)


def tensor(array) -> dict:  # noqa: ANN001
    return {"data": array.tobytes(), "shape": list(array.shape)}


def rows_between(file: pq.ParquetFile, columns: list[str], start: int, end: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of the rows with start <= index < end, from the row groups whose
    statistics allow any."""
    at = file.schema_arrow.names.index("index")
    groups = []
    for g in range(file.num_row_groups):
        stats = next((c.statistics for c in (file.metadata.row_group(g).column(k) for k in range(file.metadata.num_columns)) if c.path_in_schema == file.schema_arrow.names[at]), None)
        if stats is None or not stats.has_min_max or stats.min < end and stats.max >= start:
            groups.append(g)
    for batch in file.iter_batches(batch_size=rows, row_groups=groups, columns=columns):
        index = batch.column(batch.schema.get_field_index("index"))
        kept = batch.filter(pc.and_(pc.greater_equal(index, start), pc.less(index, end)))
        if kept.num_rows:
            yield kept


def read_episodes(spark, roots: str | list[str], partitioning: str = "file_group", **options: object):  # noqa: ANN001, ANN201
    """Frame rows of one root or several; `dataset_index` numbers the roots."""
    spark.dataSource.register(EpisodeSource)
    given = {"roots": roots if isinstance(roots, str) else ",".join(roots), "partitioning": partitioning} | {k: str(v) for k, v in options.items()}
    return spark.read.format("episodes").options(**given).load()

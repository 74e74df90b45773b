import json
import os

import numpy as np
import pandas as pd
import pytest

from marlstone.sources import files
from marlstone.sources.episodes import read_episodes

LENGTHS = [3, 2, 4, 1, 5, 2]
FILES = {"a": [0, 0, 1, 1, 2, 2], "b": [0, 0, 0, 1, 1, 1]}


def make_root(path, lengths=LENGTHS, videos=FILES, fps=10, tasks_column="task"):
    os.makedirs(path / "meta/episodes")
    os.makedirs(path / "data")
    features = {"index": {"dtype": "int64", "shape": [1]}, "state": {"dtype": "float32", "shape": [2]}} | {c: {"dtype": "video", "shape": [2, 2, 3]} for c in videos}
    info = {"total_frames": sum(lengths), "total_episodes": len(lengths), "fps": fps, "data_path": "data/{chunk_index:03d}-{file_index:03d}.parquet", "video_path": "videos/{video_key}/{chunk_index}-{file_index}.json", "features": features}
    (path / "meta/info.json").write_text(json.dumps(info))
    (path / "meta/stats.json").write_text(json.dumps({"state": {"mean": [0.0, 1.0], "std": [1.0, 1.0]}}))
    pd.DataFrame({"task_index": [0, 1], tasks_column: ["pick", "push"]}).to_parquet(path / "meta/tasks.parquet")
    episodes, rows, index = [], [], 0
    shown = {}
    for e, n in enumerate(lengths):
        r = {"episode_index": e, "length": n, "data/chunk_index": 0, "data/file_index": e // 3}
        for c, of in videos.items():
            times = shown.setdefault((c, of[e]), [])
            r |= {f"videos/{c}/chunk_index": 0, f"videos/{c}/file_index": of[e], f"videos/{c}/from_timestamp": len(times) / fps}
            times += [(e, f) for f in range(n)]
        episodes.append(r)
        for f in range(n):
            rows.append({"index": index, "episode_index": e, "frame_index": f, "timestamp": f / fps, "task_index": e % 2, "state": [float(e), float(f)], "_file": e // 3})
            index += 1
    pd.DataFrame(episodes).to_parquet(path / "meta/episodes/0.parquet")
    for k, own in pd.DataFrame(rows).groupby("_file"):
        own.drop(columns="_file").to_parquet(path / f"data/000-{k:03d}.parquet")
    for (c, k), times in shown.items():
        os.makedirs(path / f"videos/{c}", exist_ok=True)
        (path / f"videos/{c}/0-{k}.json").write_text(json.dumps([[i / fps, e, f] for i, (e, f) in enumerate(times)]))
    return str(path)


CODEC = """
import json
import weakref
import numpy as np
import pyarrow.fs as pafs
alive = []
class Frame(np.ndarray):
    pass
def decode(file, start):
    shown = json.load(file)
    first = max((i for i, x in enumerate(shown) if x[0] <= start and i % 3 == 0), default=0)  # every third is a key frame
    for k, (t, e, f) in enumerate(shown[first:]):
        if k == 0 and first:
            yield None, None  # a packet that can't be decoded just after a seek
        frame = np.full((2, 2, 3), 16 * e + f, np.uint8).view(Frame)
        alive.append(k)
        weakref.finalize(frame, alive.pop)
        yield t, frame
        del frame
        if len(alive) > 2:
            raise RuntimeError("more than one frame per camera is held")
def store(path):
    return pafs.SubTreeFileSystem(path.removeprefix("store:/").rsplit("/", 1)[0], pafs.LocalFileSystem()), path.rsplit("/", 1)[1]
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory, spark):
    base = tmp_path_factory.mktemp("root")
    (base / "toy_codec.py").write_text(CODEC)
    spark.sparkContext.addPyFile(str(base / "toy_codec.py"))
    return make_root(base / "one")


@pytest.mark.parametrize("partitioning", ["sequential", "episode", "file_group", "chain", "row_block"])
def test_all_partitionings_give_the_same_rows(spark, root, partitioning):
    df = read_episodes(spark, root, partitioning, codec="toy_codec:decode", block_size=4, parallelism=3)
    rows = sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["index"])
    assert [r["index"] for r in rows] == list(range(sum(LENGTHS)))
    for r in rows:
        assert r["task"] == ["pick", "push"][r["episode_index"] % 2] and r["dataset_index"] == 0
        for camera in FILES:  # no frame of another file or time
            assert set(np.frombuffer(r[camera]["data"], np.uint8)) == {16 * r["episode_index"] + r["frame_index"]}
            assert r[camera]["shape"] == [2, 2, 3]


@pytest.mark.parametrize("scheme", ["file", "store"])
def test_other_file_systems(spark, root, scheme):
    more = {"filesystem": "toy_codec:store"} if scheme == "store" else {}
    df = read_episodes(spark, f"{scheme}://{root}", "episode", codec="toy_codec:decode", parallelism=2, **more)
    assert all(set(np.frombuffer(r["a"]["data"], np.uint8)) == {16 * r["episode_index"] + r["frame_index"]} for r in df.collect())
    assert df.count() == sum(LENGTHS)


def test_unknown_task_is_an_error(spark, tmp_path):
    path = make_root(tmp_path / "tasks")
    pd.DataFrame({"task_index": [0], "task": ["pick"]}).to_parquet(f"{path}/meta/tasks.parquet")
    with pytest.raises(Exception, match="unknown task_index 1"):
        read_episodes(spark, path, columns="index,task").collect()


def test_tasks_stay_small_with_many_episodes(tmp_path):
    import pickle

    from marlstone.sources.episodes import EpisodeReader, EpisodeSource

    path = make_root(tmp_path / "many", lengths=[1] * 6)
    rows = [{"episode_index": e, "length": 2, "data/chunk_index": 0, "data/file_index": 0} | {f"videos/{c}/{x}": 0 for c in FILES for x in ("chunk_index", "file_index", "from_timestamp")} for e in range(100_000)]
    pd.DataFrame(rows).to_parquet(f"{path}/meta/episodes/0.parquet")
    reader = EpisodeSource({"roots": path}).reader(None)
    parts = EpisodeReader(reader.roots, reader.arrow, {"partitioning": "row_block", "block_size": "100"}).partitions()
    assert len(parts) == 2000 and len(pickle.dumps(reader)) < 20_000 and max(len(pickle.dumps(p)) for p in parts) < 20_000


def test_row_groups_outside_a_slice_are_skipped(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from marlstone.sources.episodes import rows_between

    pq.write_table(pa.table({"index": list(range(1000)), "x": [0.5] * 1000}), tmp_path / "d.parquet", row_group_size=100)
    got = list(rows_between(pq.ParquetFile(tmp_path / "d.parquet"), ["index"], 250, 310, 40))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(250, 310)) and max(b.num_rows for b in got) <= 40


def test_slices(spark, root):
    from marlstone.sources.episodes import Root, slices

    r = Root(root)
    assert slices(r, "chain", None) == [(0, 17)] and len(slices(r, "file_group", None)) == 4 and len(slices(r, "episode", None)) == 6
    assert r.stats()["state"]["mean"] == [0.0, 1.0]


def test_columns_skip_decoding(spark, root):
    assert read_episodes(spark, root, columns="index,task").columns == ["index", "task"]
    assert read_episodes(spark, root, columns="index,task").count() == sum(LENGTHS)


def test_two_roots(spark, root, tmp_path):
    other = make_root(tmp_path / "two", tasks_column="__index_level_0__")
    got = read_episodes(spark, [root, other], columns="index,dataset_index").groupBy("dataset_index").count().collect()
    assert {r["dataset_index"]: r["count"] for r in got} == {0: 17, 1: 17}


def test_errors(spark, root, tmp_path):
    other = make_root(tmp_path / "fps", fps=30)
    with pytest.raises(Exception, match="fps mismatch"):
        read_episodes(spark, [root, other])
    torn = make_root(tmp_path / "torn", videos={"a": [0, 1, 0, 1, 0, 1]})
    with pytest.raises(Exception, match="not adjacent"):
        read_episodes(spark, torn, "file_group", columns="index").count()
    with pytest.raises(Exception, match="info.json is missing"):
        read_episodes(spark, str(tmp_path / "nowhere"))
    with pytest.raises(Exception, match="block_size"):
        read_episodes(spark, root, "row_block", columns="index").count()


def test_plain_files(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "a"), (2.5, "b")], "x float, s string")
    path = files.write_stamped(df, str(tmp_path / "out"), single=True)
    assert files.parquet(spark, str(tmp_path / "out"), ["s"], readers=2).columns == ["s"]
    part = next(p for p in os.listdir(path) if p.endswith(".parquet"))
    assert files.inspect(f"{path}/{part}")["rows"] == 2
    df.write.csv(str(tmp_path / "csv"), header=True)
    assert files.csv(spark, str(tmp_path / "csv"), df.schema).count() == 2


def test_small_sources(spark, tmp_path):
    calls = []
    get = lambda u: calls.append(u) or b"x"
    for _ in range(2):
        assert open(files.fetch_once("http://x", str(tmp_path / "f"), get), "rb").read() == b"x"
    assert calls == ["http://x"]
    once = files.prompts(spark, ["a", "b", "c"], 50, 3).collect()
    assert once == files.prompts(spark, ["a", "b", "c"], 50, 3).collect() and {r["prompt"] for r in once} == {"a", "b", "c"}
    rows = files.regression_rows(spark, 400, 3, 1).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    assert np.abs(y - x @ [0, 1, 2] - 0.5).std() < 0.2


def test_session_works_from_another_folder(tmp_path):
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from marlstone.session import build_session\n"
        "from marlstone.functions.text import fix_mojibake\n"
        "sys.path.pop(0)\n"
        "s = build_session('local-cluster[1,1,1024]', **{'spark.checkpoint.dir': sys.argv[2]})\n"
        "print(s.createDataFrame([('a',)], 't string').select(fix_mojibake('t')).collect()[0][0] * 3)\n"
    )
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, repo, f"file://{tmp_path}"], cwd=tmp_path, capture_output=True, text=True, timeout=180, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "aaa" in done.stdout, done.stderr[-2000:]

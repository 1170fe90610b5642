"""Readers and writers of sensor logs, point clouds, poses and labels.

Text formats are scanned by Spark line by line; binary ones are read as whole files by
executors. Sentinels of the formats become nulls on the way in and come back on the way out.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridloom.session import ship


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their file and their number in it; a line's number is found by its offset order within one file, files being bounded."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("n", "line"))


def _tokens(line: str = "line") -> Column:
    return F.split(F.trim(F.col(line)), r"\s+")


def _numbers(tokens: str, names: Sequence[str], kind: str = "double") -> list[Column]:
    return [F.element_at(tokens, i + 1).cast(kind).alias(n) for i, n in enumerate(names)]


def associations(spark: SparkSession, path: str) -> DataFrame:
    """Depth and colour files by time; lines that have not four tokens are left out."""
    rows = spark.read.text(path).select(_tokens("value").alias("t")).where(F.size("t") == 4)
    stamp = [F.col("t")[i].cast("double") for i in (0, 2)]
    return rows.select(stamp[0].alias("t_rgb"), F.col("t")[1].alias("rgb_path"), stamp[1].alias("t_depth"), F.col("t")[3].alias("depth_path"), ((stamp[0] + stamp[1]) / 2).alias("ts"))


POSE = ["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Time, place and quaternion; of lines with another count of tokens all is null."""
    rows = spark.read.text(path).select(_tokens("value").alias("t")).where(F.col("t")[0] != "")
    whole = F.size("t") == 8
    return rows.select(*[F.when(whole, F.expr(f"try_cast(t[{i}] as double)")).alias(n) for i, n in enumerate(POSE)])


def write_trajectory(frames: DataFrame, path: str, keep: Column | None = None) -> None:
    """Tracked frames, eight decimals each."""
    rows = frames.where(keep) if keep is not None else frames
    rows.select(F.concat_ws(" ", *[F.format_string("%.8f", F.col(c).cast("double")) for c in POSE]).alias("value")).write.mode("overwrite").text(path)


CAMERA = ["width", "height", "fx", "fy", "cx", "cy", "d0", "d1", "d2", "d3", "d4", "depth_scale", "max_depth"]


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row of intrinsics; without 13 numbers the defaults."""
    rows = spark.read.text(path).select(_tokens("value").alias("t")).where(F.size("t") == 13).limit(1)
    default = [640, 480, 525.0, 525.0, 319.5, 239.5, 0, 0, 0, 0, 0, 1000.0, 8.0]
    found = rows.select(*_numbers("t", CAMERA))
    spare = spark.createDataFrame([tuple(map(float, default))], ", ".join(f"{c} double" for c in CAMERA))
    both = found.withColumn("__o", F.lit(0)).unionByName(spare.withColumn("__o", F.lit(1))).orderBy("__o").limit(1).drop("__o")
    d = F.array(*[f"d{i}" for i in range(5)]).alias("d")
    return both.select(F.col("width").cast("int"), F.col("height").cast("int"), "fx", "fy", "cx", "cy", d, "depth_scale", "max_depth")


def settings(text: str, defaults: dict | None = None) -> dict:
    """Scalars of a flat yaml file, over defaults; numbers become numbers."""
    out = dict(defaults or {})
    for line in text.splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip(), value.strip().strip('"')
        if colon and value and not key.startswith("%"):
            try:
                out[key] = int(value)
            except ValueError:
                try:
                    out[key] = float(value)
                except ValueError:
                    out[key] = value
    return out


CLOUD = ["x", "y", "z", "nx", "ny", "nz"]


def fpcd(spark: SparkSession, path: str) -> DataFrame:
    """Text clouds: a count, then position, normal and packed label. Column complete tells whether the count is right."""
    rows = _lines(spark, path).withColumn("t", _tokens())
    count = rows.where("n = 0").select(F.col("file").alias("f"), F.col("t")[0].cast("long").alias("want"))
    body = rows.where("n > 0").where(F.size("t") == 7)
    have = body.groupBy(F.col("file").alias("f")).agg(F.count(F.lit(1)).alias("have"))
    told = count.join(have, "f", "left").select("f", (F.col("want") == F.coalesce("have", F.lit(0))).alias("complete"))
    return body.join(told, body.file == told.f).select("file", F.col("n").alias("idx"), *_numbers("t", CLOUD, "float"), F.col("t")[6].cast("long").alias("label"), "complete")


def write_fpcd(points: DataFrame, path: str, order: str) -> None:
    """One text file: the count, then the points in order. A cloud is a single file by its format."""
    body = points.select(F.lit(1).alias("k"), F.col(order).cast("double").alias("o"), F.concat_ws(" ", *[F.col(c).cast("string") for c in [*CLOUD, "label"]]).alias("value"))
    head = points.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(0).alias("k"), F.lit(0.0).alias("o"), "value")
    head.unionByName(body).repartitionByRange(1, "k", "o").sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def ply_text(points: pd.DataFrame, faces: Sequence[Sequence[int]] = ()) -> str:
    """ASCII PLY of points with normals and colours where there are such columns, and faces."""
    names = [c for c in ("x", "y", "z", "nx", "ny", "nz") if c in points]
    colours = [c for c in ("red", "green", "blue") if c in points]
    head = ["ply", "format ascii 1.0", f"element vertex {len(points)}", *[f"property float {c}" for c in names], *[f"property uchar {c}" for c in colours]]
    if len(faces):
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    rows = [" ".join([*(repr(float(v)) for v in r[: len(names)]), *(str(int(v)) for v in r[len(names) :])]) for r in points[names + colours].itertuples(index=False)]
    return "\n".join([*head, "end_header", *rows, *(f"{len(f)} {' '.join(map(str, f))}" for f in faces)]) + "\n"


_PLY = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


def parse_ply(data: bytes) -> dict[str, list[dict]]:
    """Elements of an ASCII or binary PLY file, each as rows."""
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :] if b"\n" in body else b""
    kind, elements = "ascii", []
    for line in head.decode("ascii", "replace").splitlines():
        t = line.split()
        if t[:1] == ["format"]:
            kind = t[1]
        elif t[:1] == ["element"]:
            elements.append((t[1], int(t[2]), []))
        elif t[:1] == ["property"]:
            elements[-1][2].append((t[-1], t[2:4] if t[1] == "list" else None, t[1]))
    out, at = {}, 0
    words = body.split() if kind == "ascii" else []
    end = ">" if "big" in kind else "<"

    def take(code: str):
        nonlocal at
        if kind == "ascii":
            at += 1
            return (float if code in "fd" else int)(words[at - 1])
        n = struct.calcsize(code)
        at += n
        return struct.unpack(end + code, body[at - n : at])[0]

    for name, count, props in elements:
        rows = []
        for _ in range(count):
            row = {}
            for p, lists, t in props:
                row[p] = [take(_PLY[lists[1]]) for _ in range(take(_PLY[lists[0]]))] if lists else take(_PLY[t])
            rows.append(row)
        out[name] = rows
    return out


def ply_binary(points: pd.DataFrame, faces: Sequence[Sequence[int]] = ()) -> bytes:
    """Little-endian PLY of points (x y z) and faces."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\n"
    head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = points[["x", "y", "z"]].to_numpy("<f4").tobytes() + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in faces)
    return head.encode() + body


def binary_files(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    """Rows of parse(bytes) -> DataFrame for each file, with a column file; a file is the unit of work."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in pdf.itertuples(index=False):
                found = parse(bytes(content))
                if len(found):
                    yield found.assign(file=name)

    return files.mapInPandas(rows, f"{schema}, file string")


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    def parse(data: bytes) -> pd.DataFrame:
        rows = parse_ply(data).get("vertex", [])
        out = pd.DataFrame({c: [float(r[c]) for r in rows] for c in ("x", "y", "z")})
        for c in ("nx", "ny", "nz"):
            out[c] = pd.Series([r.get(c) for r in rows], dtype="float64")
        for c in ("red", "green", "blue"):
            out[c] = pd.Series([r.get(c) for r in rows], dtype="Int64")
        return out.assign(idx=range(len(out)))

    return binary_files(spark, path, "x double, y double, z double, nx double, ny double, nz double, red long, green long, blue long, idx long", parse)


def ply_faces(spark: SparkSession, path: str) -> DataFrame:
    def parse(data: bytes) -> pd.DataFrame:
        rows = [r["vertex_indices"] for r in parse_ply(data).get("face", [])]
        return pd.DataFrame({"tri_id": range(len(rows)), "v0": [r[0] for r in rows], "v1": [r[1] for r in rows], "v2": [r[2] for r in rows]})

    return binary_files(spark, path, "tri_id long, v0 long, v1 long, v2 long", parse)


def submap_poses(spark: SparkSession, path: str) -> DataFrame:
    """A count, then id, rotation by rows and translation of each submap."""
    rows = _lines(spark, path).where("n > 0").withColumn("t", _tokens()).where(F.size("t") == 13)
    part = lambda a, n: F.transform(F.slice("t", a, n), lambda x: x.cast("double"))
    return rows.select("file", F.col("t")[0].cast("int").alias("submap_id"), part(2, 9).alias("r"), part(11, 3).alias("t"))


def rooms(spark: SparkSession, path: str) -> DataFrame:
    """Room id, count, and so many submaps."""
    rows = _lines(spark, path).where("n > 0").withColumn("t", _tokens()).where(F.size("t") >= 2)
    return rows.select("file", F.col("t")[0].cast("int").alias("room_id"), F.transform(F.slice("t", F.lit(3), F.col("t")[1].cast("int")), lambda x: x.cast("int")).alias("submaps"))


def base_paths(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("n > 0").withColumn("t", _tokens()).where(F.size("t") == 2)
    return rows.select(F.col("t")[0].cast("int").alias("agent_id"), F.col("t")[1].alias("path"))


def write_counted(rows: DataFrame, path: str, value: Column, order: str) -> None:
    """One text file with the count of rows in front, as the state files are."""
    body = rows.select(F.lit(1).alias("k"), F.col(order).cast("double").alias("o"), value.alias("value"))
    head = rows.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(0).alias("k"), F.lit(0.0).alias("o"), "value")
    head.unionByName(body).repartitionByRange(1, "k", "o").sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npz_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def npz_arrays(data: bytes) -> dict[str, np.ndarray]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n.removesuffix(".npy"): npy_array(z.read(n)) for n in z.namelist()}


def npy_vectors(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(idx, name, file) of one-dimensional integer files."""
    return binary_files(spark, path, f"idx long, {name} long", lambda data: pd.DataFrame({"idx": range(len(a := npy_array(data).ravel())), name: a.astype("int64")}))


def labels(spark: SparkSession, semantic: str, instance: str) -> DataFrame:
    """Semantic and instance vectors of equal length side by side."""
    a = npy_vectors(spark, semantic, "semantic").withColumn("key", F.regexp_extract("file", r"([^/]*)_semantic\.npy$", 1)).drop("file")
    b = npy_vectors(spark, instance, "instance").withColumn("key", F.regexp_extract("file", r"([^/]*)_instance\.npy$", 1)).drop("file")
    return a.join(b, ["key", "idx"])


def _doubles(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 8 * 8], "<f8")


def submap_info(spark: SparkSession, path: str) -> DataFrame:
    """Binary doubles: count, then id, R, t."""
    def parse(data: bytes) -> pd.DataFrame:
        a = _doubles(data)[1:]
        a = a[: len(a) // 13 * 13].reshape(-1, 13)
        return pd.DataFrame({"submap_id": a[:, 0].astype(int), "r": list(a[:, 1:10]), "t": list(a[:, 10:])})

    return binary_files(spark, path, "submap_id int, r array<double>, t array<double>", parse)


def keyframe_info(spark: SparkSession, path: str) -> DataFrame:
    """Binary doubles: count, then keyframe, submap, R, t, relative R, relative t."""
    def parse(data: bytes) -> pd.DataFrame:
        a = _doubles(data)[1:]
        a = a[: len(a) // 26 * 26].reshape(-1, 26)
        return pd.DataFrame({"kf_id": a[:, 0].astype(int), "submap_id": a[:, 1].astype(int), "r": list(a[:, 2:11]), "t": list(a[:, 11:14]), "rel_r": list(a[:, 14:23]), "rel_t": list(a[:, 23:])})

    return binary_files(spark, path, "kf_id int, submap_id int, r array<double>, t array<double>, rel_r array<double>, rel_t array<double>", parse)


def correspondences(spark: SparkSession, path: str) -> DataFrame:
    """Binary doubles: count, then two ids and 43 sums. Read to the end of the file, as the count may be too high."""
    def parse(data: bytes) -> pd.DataFrame:
        a = _doubles(data)[1:]
        a = a[: len(a) // 45 * 45].reshape(-1, 45)
        return pd.DataFrame({"ref": a[:, 0].astype(int), "new": a[:, 1].astype(int), "sums": list(a[:, 2:])})

    return binary_files(spark, path, "ref int, new int, sums array<double>", parse)


def spill_bytes(chunks: Sequence[tuple[tuple[int, int, int], dict[int, tuple[float, float]]]]) -> bytes:
    """A submap as floats: size, chunk count, then per chunk its key, count and (voxel, sdf, weight), ended by -2. Empty voxels are left out."""
    body: list[float] = []
    for key, voxels in chunks:
        held = {i: v for i, v in voxels.items() if v[1] != 0 or v[0] < 1}
        body += [*key, len(held), *(x for i, v in sorted(held.items()) for x in (i, *v)), -2]
    return np.array([len(body) + 2, len(chunks), *body], "<f4").tobytes()


def spilled(spark: SparkSession, path: str) -> DataFrame:
    def parse(data: bytes) -> pd.DataFrame:
        a, rows = np.frombuffer(data, "<f4"), []
        at = 2
        for _ in range(int(a[1]) if len(a) > 1 else 0):
            key, n = a[at : at + 3].astype(int).tolist(), int(a[at + 3])
            block = a[at + 4 : at + 4 + 3 * n].reshape(-1, 3)
            rows += [(*key, int(i), float(s), float(w)) for i, s, w in block]
            at += 5 + 3 * n
        return pd.DataFrame(rows, columns=["cx", "cy", "cz", "vid", "sdf", "weight"])

    return binary_files(spark, path, "cx int, cy int, cz int, vid int, sdf float, weight float", parse)


def write_submaps(voxels: DataFrame, path: str) -> None:
    """Non-empty voxels by agent and submap: reading one submap prunes the others."""
    voxels.where("weight <> 0 OR sdf < 1").write.mode("overwrite").partitionBy("camera_id", "submap_id").parquet(path)


#: 3 floats of position, 3 of colour, 3 half floats of normal (fixed layout of 30 bytes).
_POINT = np.dtype([("p", "<f4", 3), ("c", "<f4", 3), ("n", "<f2", 3)])


def pack_points(xyz: np.ndarray, colour: np.ndarray, normal: np.ndarray) -> bytes:
    out = np.zeros(len(xyz), _POINT)
    out["p"], out["c"], out["n"] = xyz, colour, normal
    return out.tobytes()


def unpack_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _POINT)


def half(column: Column):
    """Rounded to a 16-bit float."""
    @F.pandas_udf("double")
    def to_half(x: pd.Series) -> pd.Series:
        return x.astype("float16").astype("float64")

    return to_half(column)


def split_mesh(triangles: DataFrame, labels_: Sequence[str]) -> DataFrame:
    """Triangles by label: one of mixed labels goes to each of its labels."""
    return triangles.withColumn("label", F.explode(F.array_distinct(F.array(*labels_))))


# Log of frames: int32 count; per frame int64 stamp, int32 depth size, int32 colour size, zlib depth, colour.


def raw_log_bytes(frames: Sequence[tuple[int, bytes, bytes]]) -> bytes:
    out = [struct.pack("<i", len(frames))]
    for stamp, depth, colour in frames:
        packed = zlib.compress(depth)
        out += [struct.pack("<qii", stamp, len(packed), len(colour)), packed, colour]
    return b"".join(out)


def raw_log_index(data: bytes) -> list[tuple[int, int, int, int]]:
    """(stamp, place, depth size, colour size) of each whole frame."""
    at, out = 4, []
    for _ in range(struct.unpack("<i", data[:4])[0]):
        if at + 16 > len(data):
            break
        stamp, d, c = struct.unpack("<qii", data[at : at + 16])
        if at + 16 + d + c > len(data):
            break
        out.append((stamp, at + 16, d, c))
        at += 16 + d + c
    return out


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class RawLogReader(DataSourceReader):
    """Frames of a log in partitions of consecutive frames; option frames sets how many."""

    def __init__(self, options):
        self.path, self.many = options["path"].removeprefix("file://"), int(options.get("frames", 64))

    def partitions(self):
        with open(self.path, "rb") as f:
            n = struct.unpack("<i", f.read(4))[0]
        return [_Range(a, min(n, a + self.many)) for a in range(0, n, self.many)]

    def read(self, part):
        with open(self.path, "rb") as f:
            data = f.read()
        for i, (stamp, at, d, c) in list(enumerate(raw_log_index(data)))[part.start : part.end]:
            yield i, stamp, zlib.decompress(data[at : at + d]), data[at + d : at + d + c]


class RawLogStream(DataSourceStreamReader):
    """The same log as a stream, so many frames a batch."""

    def __init__(self, options):
        self.path, self.many, self.at = options["path"].removeprefix("file://"), int(options.get("frames", 64)), 0

    def initialOffset(self):
        return {"frame": 0}

    def latestOffset(self):
        with open(self.path, "rb") as f:
            n = struct.unpack("<i", f.read(4))[0]
        self.at = min(n, self.at + self.many)
        return {"frame": self.at}

    def partitions(self, start, end):
        return [_Range(start["frame"], end["frame"])]

    def commit(self, end):
        pass

    def read(self, part):
        return RawLogReader({"path": self.path}).read(part)


class RawLog(DataSource):
    """spark.read.format("rawlog").load(path) after spark.dataSource.register(RawLog)."""

    @classmethod
    def name(cls):
        return "rawlog"

    def schema(self):
        return "frame int, stamp long, depth binary, colour binary"

    def reader(self, schema):
        return RawLogReader(self.options)

    def streamReader(self, schema):
        return RawLogStream(self.options)

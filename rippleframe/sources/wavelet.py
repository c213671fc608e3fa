"""The data source "wavelet": spark.read.format("wavelet") gives samples or headers of coded images, write stores them.

Options of the reader: path (a file or folder, any file system that pyarrow knows), kind ("samples" or "config"),
maxLayers, reduce, upsample, bytes (how much of the files a task reads, 32 MB). Equality on image_id and comp is
taken over from filters where Spark pushes them. Files that can't be decoded give no samples.
The writer takes (image_id, content), a row per image, and writes a file each; a failed job's files are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SAMPLES = "image_id string, comp int, y int, x int, v int"
CONFIG = "image_id string, width int, height int, comps int, model string, container boolean, layers int, tiles int"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.names, self.comps = options, None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("image_id",):
                self.names = wanted if self.names is None else self.names & wanted
            elif wanted is not None and f.attribute == ("comp",) and self.options.get("kind", "samples") == "samples":
                self.comps = wanted if self.comps is None else self.comps & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = _system(self.options["path"])
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        most, out, held = int(self.options.get("bytes", 32 << 20)), [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if self.names is not None and f.base_name not in self.names:
                continue
            if not out or held + f.size > most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from ..kernels import codec

        system, _ = _system(self.options["path"])
        layers, reduce = int(self.options.get("maxlayers", 0)), int(self.options.get("reduce", 0))
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            with system.open_input_stream(path) as f:
                data = f.read()
            try:
                if self.options.get("kind", "samples") == "config":
                    c = codec.config(data)
                    yield (name, *(c[k] for k in ("width", "height", "comps", "model", "container", "layers", "tiles")))
                    continue
                image = codec.decode(data, layers, reduce)
            except (ValueError, IndexError):
                continue
            planes = image.planes
            if self.options.get("upsample", "false") == "true":
                h, high, wide = image.header, image.planes[0].shape[0], image.planes[0].shape[1]
                planes = [codec.upsample(p, high * h.comps[0].dy, wide * h.comps[0].dx, k.dx, k.dy) for p, k in zip(planes, h.comps, strict=True)]
            for c, p in enumerate(planes):
                if self.comps is None or c in self.comps:
                    for y, row in enumerate(p.tolist()):
                        for x, v in enumerate(row):
                            yield name, c, y, x, v


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, path = _system(self.options["path"])
        system.create_dir(path, recursive=True)
        done = []
        for row in rows:
            # Under a hidden name until the job commits, so that a repeated task leaves no half file.
            target = f"{path}/.{self.job}.{uuid.uuid4().hex}.{row['image_id']}"
            with system.open_output_stream(target) as f:
                f.write(bytes(row["content"]))
            done.append(target)
        return Written(done)

    def commit(self, messages) -> None:
        system, path = _system(self.options["path"])
        for m in messages:
            for p in m.paths if m else []:
                system.move(p, f"{path}/{p.rsplit('/', 1)[-1].split('.', 3)[3]}")

    def abort(self, messages) -> None:
        system, _ = _system(self.options["path"])
        for m in messages:
            for p in m.paths if m else []:
                system.delete_file(p)


class Wavelet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavelet"

    def schema(self) -> str:
        return CONFIG if self.options.get("kind", "samples") == "config" else SAMPLES

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark) -> None:
    """Makes the format known to a session. The reader takes filters over, which Spark wants to be switched on for sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Wavelet)

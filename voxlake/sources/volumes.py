"""Voxels of image files as a data source that reads slabs: a task takes some slices of a large file or some small files.

Filters on image_id, z, t and u reach the reader. Files that the image_id rules out aren't opened, and of a file that isn't
compressed only the slices asked for are read, by their place in it. A compressed file is one task, which unpacks it slice by
slice. The files .hdr and .img of a pair are one image, named by its header.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import datasource as ds

from . import codecs, store
from .meta import ImageMeta

VOXELS = "image_id string, x int, y int, z int, t int, u int, value double"
KINDS = {"nifti": (".nii", ".hdr", ".img"), "nrrd": (".nrrd",), "png": (".png",)}
#: Bytes of voxels for a task, unless the option `slab` says otherwise, and for a batch of rows.
SLAB, BATCH = 32 << 20, 1 << 20


def kind_of(name: str) -> str:
    """Codec by file name; what isn't known counts as NIfTI."""
    return next((k for k, ends in KINDS.items() if any(e in name.lower() for e in ends)), "nifti")


@dataclass(frozen=True)
class Image:
    """Address of an image's header and, where they are apart, of its pixels; size of the file that holds the pixels."""

    header: str
    pixels: str | None
    size: int


def images_of(files: list[tuple[str, int]]) -> list[Image]:
    """The images that files make up. A pixel file without its header, or the other way round, is an error."""
    stem = lambda p: p.removesuffix(".gz").rsplit(".", 1)
    ends = {p: (stem(p)[0], stem(p)[1].lower() if len(stem(p)) > 1 else "") for p, _ in files}
    pixels = {base: (p, size) for p, size in files for base, end in [ends[p]] if end == "img"}
    headers = {base for base, end in ends.values() if end == "hdr"}
    if pixels.keys() != headers:
        raise ValueError(f"one file of a .hdr/.img pair is missing: {sorted(pixels.keys() ^ headers)[:5]}")
    return [Image(p, *pixels[ends[p][0]]) if ends[p][1] == "hdr" else Image(p, None, size) for p, size in files if ends[p][1] != "img"]


def header_bytes(path: str) -> bytes:
    """A NIfTI or Analyze header with its extensions, without the voxels behind them."""
    with store.stream(path, store.zipped(path)) as f:
        head = f.read(1024)
        more = codecs.nifti_layout(head, True)[2] - len(head)
        return head + f.read(more) if more > 0 else head


def layout(image: Image) -> tuple[ImageMeta, np.dtype, int]:
    return codecs.nifti_layout(header_bytes(image.header), image.pixels is not None)


def _meets(f: ds.Filter, value) -> bool:
    if isinstance(f, ds.In):
        return value in f.value
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return value == f.value
    if isinstance(f, ds.GreaterThan):
        return value > f.value
    if isinstance(f, ds.GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, ds.LessThan) else value <= f.value


PUSHED = (ds.In, ds.EqualTo, ds.EqualNullSafe, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


@dataclass
class Slabs(ds.InputPartition):
    """What a task reads: images with their first slice and the one behind the last (None: to the end)."""

    parts: list[tuple[Image, int, int | None]]


class Voxels(ds.DataSource):
    """Source `voxels`; options path (a file or folder), scaled (with the header's slope and intercept, the default) and slab.

    spark.sql.python.filterPushdown.enabled must be true, as read_voxels() sets it.
    """

    @classmethod
    def name(cls) -> str:
        return "voxels"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> ds.DataSourceReader:
        return VoxelReader(self.options["path"], self.options.get("scaled", "true") == "true", int(self.options.get("slab", SLAB)))


class VoxelReader(ds.DataSourceReader):
    def __init__(self, path: str, scaled: bool, slab: int):
        self.path, self.scaled, self.slab = path, scaled, slab
        self.filters: dict[str, list[ds.Filter]] = {"image_id": [], "z": [], "t": [], "u": []}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if isinstance(f, PUSHED) and name in self.filters and f.value is not None and not (isinstance(f, ds.In) and None in f.value):
                self.filters[name].append(f)
            elif not isinstance(f, ds.IsNotNull):  # no column is ever null but value
                yield f
            elif name == "value":
                yield f

    def _wanted(self, name: str, value) -> bool:
        return all(_meets(f, value) for f in self.filters[name])

    def _slices(self, meta: ImageMeta, lo: int, hi: int | None) -> list[tuple[int, int, int, int]]:
        """(place in the file, z, t, u) of the slices asked for between two places."""
        _, _, nz, nt, nu = meta.dim[:5]
        at = {name: [k for k in range(n) if self._wanted(name, k)] for name, n in (("z", nz), ("t", nt), ("u", nu))}
        found = ((z + nz * (t + nt * u), z, t, u) for u in at["u"] for t in at["t"] for z in at["z"])
        return [s for s in found if lo <= s[0] and (hi is None or s[0] < hi)]

    def partitions(self) -> list[Slabs]:
        found = [i for i in images_of(store.listed(self.path)) if self._wanted("image_id", i.header)]
        large = [i for i in found if i.size > self.slab and kind_of(i.header) == "nifti" and not store.zipped(i.pixels or i.header)]
        with ThreadPoolExecutor(16) as pool:  # only large files' headers are read here
            layouts = dict(zip(large, pool.map(layout, large), strict=True))
        out: list[Slabs] = []
        room = 0
        for i in found:
            if i in layouts:
                meta, kind, _ = layouts[i]
                each = max(1, self.slab // max(1, meta.dim[0] * meta.dim[1] * kind.itemsize))
                wanted = [s[0] for s in self._slices(meta, 0, None)]
                for k in range(0, len(wanted), each):
                    out.append(Slabs([(i, wanted[k], wanted[min(k + each, len(wanted)) - 1] + 1)]))
                room = 0
            elif i.size <= room:
                out[-1].parts.append((i, 0, None))
                room -= i.size
            else:
                out.append(Slabs([(i, 0, None)]))
                room = self.slab - i.size
        return out or [Slabs([])]

    def read(self, partition: Slabs) -> Iterator[pa.RecordBatch]:
        for image, lo, hi in partition.parts:
            meta, slices = self._stored(image, lo, hi) if kind_of(image.header) == "nifti" else self._decoded(image)
            for (_, z, t, u), values in slices:
                yield self._rows(image.header, meta, z, t, u, values)

    def _rows(self, name: str, meta: ImageMeta, z: int, t: int, u: int, values: np.ndarray) -> pa.RecordBatch:
        """Rows of a slice whose values come with x running fastest."""
        n, i = len(values), np.arange(len(values), dtype=np.int32)
        value = values * (meta.scl_slope if self.scaled else 1.0) + (meta.scl_inter if self.scaled else 0.0)
        fixed = [pa.array(np.full(n, k, np.int32)) for k in (z, t, u)]
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name])).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(i % meta.dim[0]), pa.array(i // meta.dim[0]), *fixed, pa.array(value)], [c.split()[0] for c in VOXELS.split(", ")])

    def _decoded(self, image: Image):
        from .images import decode

        with store.stream(image.header, False) as f:
            meta, v = decode(image.header, f.read())
        v = v.astype(float) if v.ndim == 7 else v.astype(float).mean(-1)
        return meta, ((s, v[:, :, s[1], s[2], s[3], 0, 0].ravel(order="F")) for s in self._slices(meta, 0, None))

    def _stored(self, image: Image, lo: int, hi: int | None):
        meta, kind, start = layout(image)
        return meta, self._read_slices(image.pixels or image.header, self._slices(meta, lo, hi), meta.dim[0] * meta.dim[1], kind, start)

    @staticmethod
    def _read_slices(path: str, slices: list[tuple[int, int, int, int]], n: int, kind: np.dtype, start: int):
        """Each slice and its values; slices that follow each other in the file are read together up to a batch's bytes."""
        size = n * kind.itemsize
        packed = store.zipped(path)
        with store.stream(path, True) if packed else store.seekable(path) as f:
            at, k = 0, 0
            while k < len(slices):
                run = 1
                while k + run < len(slices) and slices[k + run][0] == slices[k][0] + run and (run + 1) * size <= BATCH:
                    run += 1
                to = start + slices[k][0] * size
                if packed:
                    while at < to and (passed := len(f.read(min(BATCH, to - at)))):
                        at += passed
                else:
                    f.seek(to)
                data = f.read(run * size)
                if len(data) < run * size:
                    raise ValueError(f"{path} ends before its last voxel")
                at = to + run * size
                for j in range(run):
                    v = np.frombuffer(data, kind, n, j * size).astype(float)
                    yield slices[k + j], v if v.ndim == 1 else v.mean(-1)
                k += run

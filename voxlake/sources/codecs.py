"""Bytes to arrays and back: NIfTI-1, NIfTI-2, Analyze, PNG and NRRD. Arrays are indexed [x, y, z, t, u, v, w]."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np

from .meta import ImageMeta, repaired

#: Element types by their NIfTI code (fixed values of the format).
TYPES = {2: "uint8", 256: "int8", 4: "int16", 512: "uint16", 8: "int32", 768: "uint32", 1024: "int64", 1280: "uint64", 16: "float32", 64: "float64", 128: "rgb24"}
CODES = {v: k for k, v in TYPES.items()}


def _dtype(kind: str, end: str) -> np.dtype:
    return np.dtype((np.uint8, 3)) if kind == "rgb24" else np.dtype(kind).newbyteorder(end)


def read_nifti(data: bytes, pixels: bytes | None = None, header_only: bool = False) -> tuple[ImageMeta, np.ndarray | None]:
    """Header (repaired) and voxels as stored. pixels: the second file of a pair. gzip is seen through."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    pixels = gzip.decompress(pixels) if pixels and pixels[:2] == b"\x1f\x8b" else pixels
    end = next((e for e in "<>" if struct.unpack_from(e + "i", data)[0] in (348, 540)), None)
    if end is None:
        raise ValueError("not a NIfTI or Analyze header")
    u = lambda f, at: struct.unpack_from(end + f, data, at)
    if u("i", 0)[0] == 540:
        dim, (code,), pix = u("8q", 16), u("h", 12), u("8d", 104)
        (offset,), (slope, inter) = u("q", 168), u("2d", 176)
        p, (qcode, scode), quat, rows = u("3d", 80), u("2i", 344), u("6d", 352), u("12d", 400)
        (units,), name, size = u("i", 500), data[508:524], 540
    else:
        dim, (code,), pix, (offset,) = u("8h", 40), u("h", 70), u("8f", 76), u("f", 108)
        nifti = data[344:347] in (b"n+1", b"ni1")
        slope, inter = u("2f", 112) if nifti else (1.0, 0.0)
        p, (qcode, scode) = u("3f", 56), u("2h", 252) if nifti else (0, 0)
        quat, rows = u("6f", 256), u("12f", 280)
        units, name, size = data[123] if nifti else 2, data[328:344], 348
    if code not in TYPES:
        raise ValueError(f"element type {code} isn't supported")
    n = min(max(dim[0], 1), 7)
    shape = tuple(max(1, d) for d in dim[1 : n + 1]) + (1,) * (7 - n)
    ext, at = [], size + 4
    if pixels is None and len(data) >= size + 4 and data[size]:
        while at + 8 <= int(offset):
            length, kind = u("2i", at)
            if length < 16:
                break
            ext.append((kind, data[at + 8 : at + length]))
            at += length
    meta = repaired(ImageMeta("", shape, tuple(pix[1:8]), TYPES[code], slope, inter, scode, qcode, (*rows, 0.0, 0.0, 0.0, 1.0), quat[:3], quat[3:], -1.0 if pix[0] < 0 else 1.0, units or 2, name.rstrip(b"\0").decode("latin-1"), p, tuple(ext)))
    if header_only:
        return meta, None
    raw, start, kind = (pixels, 0, meta.datatype) if pixels is not None else (data, int(offset) or size, meta.datatype)
    values = np.frombuffer(raw, _dtype(kind, end), int(np.prod(shape)), start)
    return meta, values.reshape((*shape, 3) if kind == "rgb24" else shape, order="F") if kind != "rgb24" else values.reshape(*shape[::-1], 3).transpose(6, 5, 4, 3, 2, 1, 0, 7)


def nifti_layout(head: bytes, paired: bool) -> tuple[ImageMeta, np.dtype, int]:
    """Header, element type and place of the first voxel in the file that holds the voxels: the other one where paired."""
    end = next((e for e in "<>" if struct.unpack_from(e + "i", head)[0] in (348, 540)), None)
    if end is None:
        raise ValueError("not a NIfTI or Analyze header")
    second = struct.unpack_from(end + "i", head)[0] == 540
    offset = int(struct.unpack_from(end + ("q" if second else "f"), head, 168 if second else 108)[0])
    meta, _ = read_nifti(head, b"" if paired else None, header_only=True)
    return meta, _dtype(meta.datatype, end), offset if paired else offset or (540 if second else 348)


def write_nifti(meta: ImageMeta, values: np.ndarray, compress: bool = False) -> bytes:
    """A single NIfTI-1 file."""
    h = bytearray(352)
    nd = max((k + 1 for k, n in enumerate(meta.dim) if n > 1), default=1)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, max(nd, 3), *meta.dim)
    struct.pack_into("<3f", h, 56, *meta.intent_p)
    struct.pack_into("<2h", h, 70, CODES[meta.datatype], 24 if meta.datatype == "rgb24" else np.dtype(meta.datatype).itemsize * 8)
    struct.pack_into("<8f", h, 76, meta.qfac, *meta.pixdim)
    ext = b"".join(struct.pack("<2i", len(d) + 8, k) + d for k, d in meta.ext)
    struct.pack_into("<3f", h, 108, 352 + len(ext), meta.scl_slope, meta.scl_inter)
    h[123] = meta.units
    struct.pack_into("<2h6f12f", h, 252, meta.qform_code, meta.sform_code, *meta.quatern, *meta.qoffset, *meta.sform[:12])
    h[328:344] = meta.intent.encode("latin-1")[:16].ljust(16, b"\0")
    h[344:348] = b"n+1\0"
    h[348] = 1 if ext else 0
    body = np.ascontiguousarray(values.transpose(6, 5, 4, 3, 2, 1, 0, 7), np.uint8).tobytes() if meta.datatype == "rgb24" else np.asarray(values).astype(_dtype(meta.datatype, "<")).tobytes(order="F")
    out = bytes(h) + ext + body
    return gzip.compress(out, mtime=0) if compress else out


def read_png(data: bytes) -> np.ndarray:
    """Grey levels 0..255 as [x, y]: 16-bit samples lose their low byte, colours are weighted by eye."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, palette, head = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    if interlace:
        raise ValueError("interlaced PNG isn't supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bpp, row = max(1, channels * depth // 8), (w * channels * depth + 7) // 8
    raw, prior, out = zlib.decompress(idat), np.zeros(row, np.uint8), np.zeros((h, row), np.uint8)
    for y in range(h):
        kind, line = raw[y * (row + 1)], np.frombuffer(raw, np.uint8, row, y * (row + 1) + 1).copy()
        if kind == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind == 2:
            line += prior
        elif kind in (3, 4):
            x = line.astype(int)
            for i in range(row):
                a, b = int(x[i - bpp]) if i >= bpp else 0, int(prior[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = int(prior[i - bpp]) if i >= bpp else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                x[i] = (x[i] + guess) & 255
            line = x.astype(np.uint8)
        out[y] = prior = line
    if depth == 16:
        v = out.reshape(h, w, channels, 2)[..., 0]
    elif depth == 8:
        v = out.reshape(h, w, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        v = (bits @ (1 << np.arange(depth)[::-1]))[..., None]
        v = v if colour == 3 else v * 255 // (2**depth - 1)
    if colour == 3:
        v = palette[v[..., 0]]
    elif channels <= 2:
        v = np.repeat(v[..., :1], 3, axis=2)
    v = v[..., :3].astype(float)
    return (np.floor(v[..., 0] * 0.299) + np.floor(v[..., 1] * 0.587) + np.floor(v[..., 2] * 0.114)).astype(np.uint8).T


def write_png(values: np.ndarray) -> bytes:
    """[x, y] as an 8-bit grey PNG; values outside 0..255 are rescaled to that range first."""
    v = np.asarray(values, float)
    lo, hi = np.nanmin(v), np.nanmax(v)
    if lo < 0 or hi > 255:
        v = (v - lo) / (hi - lo) * 255 if hi > lo else v * 0
    g = np.nan_to_num(v).astype(np.uint8).T
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(g))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", g.shape[1], g.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


_NRRD = {"uchar": "uint8", "signed char": "int8", "short": "int16", "ushort": "uint16", "int": "int32", "uint": "uint32", "float": "float32", "double": "float64"}


def read_nrrd(data: bytes) -> tuple[ImageMeta, np.ndarray]:
    """Attached NRRD, raw or gzip; a leading vector axis becomes u."""
    head, _, body = data.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    if not lines or not lines[0].startswith("NRRD"):
        raise ValueError("not a NRRD")
    f = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x and not x.startswith("#")))
    sizes = [int(x) for x in f["sizes"].split()]
    kind = next((v for k, v in _NRRD.items() if f["type"] in (k, v, k.replace("uchar", "unsigned char").replace("ushort", "unsigned short").replace("uint", "unsigned int"))), None)
    if kind is None or f.get("encoding", "raw") not in ("raw", "gzip", "gz"):
        raise ValueError("this NRRD type or encoding isn't supported")
    body = gzip.decompress(body) if f["encoding"] in ("gzip", "gz") else body
    v = np.frombuffer(body, np.dtype(kind).newbyteorder(">" if f.get("endian") == "big" else "<"), int(np.prod(sizes))).reshape(sizes, order="F")
    dirs = [[float(x) for x in d.strip("()").split(",")] if d != "none" else None for d in f.get("space directions", "").split()]
    vector = bool(dirs) and dirs[0] is None
    if vector:
        v, dirs = np.moveaxis(v, 0, -1), dirs[1:]
        v = v.reshape(*v.shape[:-1], *(1,) * (5 - v.ndim), v.shape[-1])
    v = v.reshape(*v.shape, *(1,) * (7 - v.ndim))
    m = np.eye(4)
    for k, d in enumerate(dirs[:3]):
        if d:
            m[: len(d), k] = d
    origin = [float(x) for x in f.get("space origin", "").strip("()").split(",") if x]
    m[: len(origin), 3] = origin
    pix = [float(np.linalg.norm(m[:3, k])) or 1.0 for k in range(3)]
    return repaired(ImageMeta("", v.shape, (*pix, 1.0, 1.0, 1.0, 1.0), kind, 1.0, 0.0, 1 if dirs else 0, 0, tuple(m.ravel()))), v


def write_nrrd(meta: ImageMeta, values: np.ndarray) -> bytes:
    kind = next(k for k, v in _NRRD.items() if v == meta.datatype)
    v, m = np.asarray(values), meta.world()
    axes = [n for n in meta.dim[:4]]
    vector = meta.dim[4] > 1
    while len(axes) > 2 and axes[-1] == 1:
        axes.pop()
    body = v[:, :, :, :, :, 0, 0].reshape(*axes, meta.dim[4]) if vector else v.reshape(axes)
    body = np.moveaxis(body, -1, 0) if vector else body
    dirs = ["none"] * vector + ["(" + ",".join(repr(float(x)) for x in m[:3, k]) + ")" for k in range(min(3, len(axes)))] + ["none"] * max(0, len(axes) - 3)
    head = ["NRRD0004", f"type: {kind}", f"dimension: {body.ndim}", "space dimension: 3", "sizes: " + " ".join(map(str, body.shape)), "space directions: " + " ".join(dirs), "space origin: (" + ",".join(repr(float(x)) for x in m[:3, 3]) + ")", "endian: little", "encoding: gzip"]
    return "\n".join(head).encode() + b"\n\n" + gzip.compress(body.astype(np.dtype(meta.datatype).newbyteorder("<")).tobytes(order="F"), mtime=0)

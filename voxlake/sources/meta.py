"""Image headers: dimensions, spacing, element type, scaling and the voxel-to-world matrix."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class ImageMeta:
    image_id: str = ""
    dim: tuple[int, ...] = (1, 1, 1, 1, 1, 1, 1)
    pixdim: tuple[float, ...] = (1.0,) * 7
    datatype: str = "float32"
    scl_slope: float = 0.0
    scl_inter: float = 0.0
    sform_code: int = 0
    qform_code: int = 0
    sform: tuple[float, ...] = tuple(np.eye(4).ravel())
    quatern: tuple[float, ...] = (0.0, 0.0, 0.0)
    qoffset: tuple[float, ...] = (0.0, 0.0, 0.0)
    qfac: float = 1.0
    units: int = 2
    intent: str = ""
    intent_p: tuple[float, ...] = (0.0, 0.0, 0.0)
    ext: tuple = field(default=())

    def qform(self) -> np.ndarray:
        b, c, d = self.quatern
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        out = np.eye(4)
        out[:3, :3] = r * np.array([self.pixdim[0], self.pixdim[1], self.pixdim[2] * (self.qfac or 1.0)])
        out[:3, 3] = self.qoffset
        return out

    def world(self) -> np.ndarray:
        """The sform where it is set, else the qform."""
        return np.array(self.sform).reshape(4, 4) if self.sform_code > 0 else self.qform()


def repaired(m: ImageMeta) -> ImageMeta:
    """Dimensions of at least 1, no zero slope or spacing, lengths in mm, and a qform if there is no matrix at all."""
    scale = {1: 1000.0, 3: 0.001}.get(m.units & 7, 1.0)
    pix = tuple((abs(p) or 1.0) * (scale if k < 3 else 1.0) for k, p in enumerate(m.pixdim))
    sform = np.array(m.sform, float)
    if scale != 1.0:
        sform[:12] *= scale
    out = replace(m, dim=tuple(max(1, int(n)) for n in m.dim), pixdim=pix, scl_slope=m.scl_slope or 1.0, sform=tuple(sform), qoffset=tuple(q * scale for q in m.qoffset), units=(m.units & ~7) | 2)
    return out if m.sform_code or m.qform_code else replace(out, qform_code=1, quatern=(0.0, 0.0, 0.0), qoffset=(0.0, 0.0, 0.0), qfac=1.0)

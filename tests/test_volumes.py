"""The voxel source: slabs of large files, pairs, filters that reach the files, and odd folders."""

import re
from dataclasses import replace

import numpy as np
import pytest
from tests.test_sources import META

from voxlake.sources import codecs, images, volumes


def values_of(df):
    return {(r.image_id.rsplit("/", 1)[-1], r.x, r.y, r.z, r.t): r.value for r in df.collect()}


def pair(folder, name, v, packed=False):
    whole = codecs.write_nifti(META, v)
    head = bytearray(whole[:348])
    head[108:112] = b"\0" * 4
    head[344:348] = b"ni1\0"
    import gzip

    shut = gzip.compress if packed else bytes
    (folder / f"{name}.hdr{'.gz' * packed}").write_bytes(shut(bytes(head)))
    (folder / f"{name}.img{'.gz' * packed}").write_bytes(shut(whole[352:]))


@pytest.mark.parametrize("slab", [None, 100])
def test_every_kind_of_file_in_one_folder(spark, tmp_path, slab):
    v = np.arange(120).reshape(5, 4, 3, 2, 1, 1, 1)
    (tmp_path / "plain.nii").write_bytes(codecs.write_nifti(replace(META, ext=((6, b"x" * 4080),)), v))
    (tmp_path / "packed.nii.gz").write_bytes(codecs.write_nifti(META, v, True))
    (tmp_path / "n.nrrd").write_bytes(codecs.write_nrrd(replace(META, dim=(5, 4, 3, 1, 1, 1, 1), datatype="float32"), v[:, :, :, :1].astype("float32")))
    (tmp_path / "_hidden").write_bytes(b"no image")
    pair(tmp_path, "two", v)
    pair(tmp_path, "shut", v, True)
    rows = images.read_voxels(spark, str(tmp_path), False, slab)
    if slab:  # 40 bytes a slice, so two slices a task of each of the two large files
        assert rows.rdd.getNumPartitions() >= 6
    got = values_of(rows)
    assert len(got) == 4 * 120 + 60
    for name in ("plain.nii", "packed.nii.gz", "two.hdr", "shut.hdr.gz"):
        assert all(got[name, x, y, z, t] == v[x, y, z, t, 0, 0, 0] for x in range(5) for y in range(4) for z in range(3) for t in range(2))
    heads = {r.image_id.rsplit("/", 1)[-1]: list(r.dim[:4]) for r in images.read_headers(spark, str(tmp_path / "*[!n]")).where("image_id NOT LIKE '%hidden%'").collect()}
    assert heads.keys() >= {"packed.nii.gz", "two.hdr", "shut.hdr.gz"} and heads["two.hdr"] == [5, 4, 3, 2]


def test_filters_reach_the_files(spark, tmp_path):
    v = np.arange(120).reshape(5, 4, 3, 2, 1, 1, 1)
    data = codecs.write_nifti(META, v)
    (tmp_path / "a.nii").write_bytes(data[: 352 + 40 * 2])  # only the first two slices are there
    (tmp_path / "b.nii").write_bytes(b"no image at all")
    rows = images.read_voxels(spark, str(tmp_path), False, 64).where(f"image_id = '{tmp_path}/a.nii' AND z >= 1 AND z < 2 AND t IN (0) AND x > 2")
    plan = re.sub(r"#\d+", "", rows._jdf.queryExecution().executedPlan().toString())
    assert re.findall(r"Filter .*", plan) == ["Filter (x > 2)"], plan  # the others are the reader's
    got = values_of(rows)
    assert got == {("a.nii", x, y, 1, 0): v[x, y, 1, 0, 0, 0, 0] for x in (3, 4) for y in range(4)}
    with pytest.raises(Exception, match="ends before its last voxel"):
        images.read_voxels(spark, str(tmp_path / "a.nii")).count()


def test_slabs_of_a_large_file_hold_the_slices_asked_for(tmp_path):
    v = np.zeros((50, 40, 30, 4, 1, 1, 1))
    (tmp_path / "a.nii").write_bytes(codecs.write_nifti(replace(META, dim=v.shape, datatype="int16"), v))
    reader = volumes.VoxelReader(str(tmp_path), True, 10 * 4000)
    assert [p.parts[0][1:] for p in reader.partitions()] == [(k, k + 10) for k in range(0, 120, 10)]
    assert list(reader.pushFilters([volumes.ds.EqualTo(("t",), 2), volumes.ds.IsNotNull(("t",)), volumes.ds.LessThan(("x",), 3)])) == [volumes.ds.LessThan(("x",), 3)]
    assert [p.parts[0][1:] for p in reader.partitions()] == [(k, k + 10) for k in range(60, 90, 10)]


def test_odd_folders(spark, tmp_path):
    assert images.read_voxels(spark, str(tmp_path)).count() == 0
    (tmp_path / "half.img").write_bytes(b"12")
    with pytest.raises(ValueError, match="pair is missing"):
        volumes.VoxelReader(str(tmp_path), True, 1).partitions()

import numpy as np
import pytest

from voxlake.sources import codecs, images
from voxlake.sources.meta import ImageMeta, repaired

META = ImageMeta("", (5, 4, 3, 2, 1, 1, 1), (1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0), "int16", 2.0, -1.0, 1, 0, (1.0, 0, 0, -4, 0, 2.0, 0, 3, 0, 0, 3.0, 1, 0, 0, 0, 1.0))


@pytest.mark.parametrize("kind", ["uint8", "int16", "int32", "float32", "float64"])
@pytest.mark.parametrize("zipped", [True, False])
def test_nifti_round_trip(kind, zipped):
    from dataclasses import replace

    v = np.arange(120).reshape(5, 4, 3, 2, 1, 1, 1)
    m, got = codecs.read_nifti(codecs.write_nifti(replace(META, datatype=kind, ext=((6, b"x" * 24),)), v, zipped))
    assert np.array_equal(got, v) and m.datatype == kind and m.scl_slope == 2.0 and np.allclose(m.world(), META.world()) and m.ext[0][1] == b"x" * 24


def test_header_repair():
    m = repaired(ImageMeta(dim=(4, 0, 0, 1, 1, 1, 1), pixdim=(1000.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), units=3))
    assert m.dim[:2] == (4, 1) and m.pixdim[0] == 1.0 and m.scl_slope == 1.0 and m.qform_code == 1


def test_png_round_trip_and_rescale():
    v = np.arange(48).reshape(8, 6) * 5
    got = codecs.read_png(codecs.write_png(v))
    assert got.shape == (8, 6) and np.abs(got.astype(int) - v).max() <= 3
    assert codecs.read_png(codecs.write_png(v - 100.0)).max() >= 252


@pytest.mark.parametrize("vector", [False, True])
def test_nrrd_round_trip(vector):
    from dataclasses import replace

    dim = (5, 4, 3, 1, 3, 1, 1) if vector else (5, 4, 3, 1, 1, 1, 1)
    v = np.arange(np.prod(dim)).reshape(dim).astype("float32")
    m, got = codecs.read_nrrd(codecs.write_nrrd(replace(META, dim=dim, datatype="float32"), v))
    assert np.array_equal(got, v) and np.allclose(m.world(), META.world())


def test_folder_of_images(spark, tmp_path):
    v = np.arange(120).reshape(5, 4, 3, 2, 1, 1, 1)
    for k in range(3):
        (tmp_path / f"a{k}.nii.gz").write_bytes(codecs.write_nifti(META, v + k, True))
    rows = images.read_voxels(spark, str(tmp_path))
    assert rows.count() == 360
    assert rows.where("x = 4 AND y = 3 AND z = 2 AND t = 1").selectExpr("max(value)").first()[0] == (119 + 2) * 2 - 1
    assert images.read_headers(spark, str(tmp_path)).first().dim[:4] == [5, 4, 3, 2]
    back = images.encode_images(images.read_voxels(spark, str(tmp_path), scaled=False), META)
    assert sorted(int(codecs.read_nifti(bytes(r.content))[1].max()) for r in back.collect()) == [119, 120, 121]


def test_names_and_matrices(spark, tmp_path):
    assert images.kind_of("a.nii.gz") == "nifti" and images.kind_of("b.PNG") == "png" and images.kind_of("c.dat") == "nifti" and not images.is_image_name("m.txt")
    (tmp_path / "m.txt").write_text(images.matrix_text(np.eye(4) * 1.5))
    assert np.allclose(images.read_matrix(spark, str(tmp_path / "m.txt")), np.eye(4) * 1.5)
    (tmp_path / "l.txt").write_text("1 2 3\n4 5 6\n")
    assert [(r.px, r.pz) for r in images.read_landmarks(spark, str(tmp_path / "l.txt")).orderBy("landmark").collect()] == [(1.0, 3.0), (4.0, 6.0)]


def test_images_are_written_as_files(spark, tmp_path):
    voxels = spark.createDataFrame([(f"case {i}.nii", x, y, 0, 0, 0, float(x + 4 * y + i)) for i in range(3) for x in range(4) for y in range(3)], images.VOXELS)
    meta = ImageMeta("", (4, 3, 1, 1, 1, 1, 1), (1.0,) * 7, "float32", 1.0, 0.0, 1, 0, tuple(np.eye(4).ravel()))
    for _ in range(2):  # written again: the same files
        images.write_images(images.encode_images(voxels, meta), str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["case_0.nii", "case_1.nii", "case_2.nii"]
    back = {(r.image_id.rsplit("/", 1)[-1], r.x, r.y): r.value for r in images.read_voxels(spark, str(tmp_path / "out")).collect()}
    assert len(back) == 36 and back["case_2.nii", 3, 2] == 13.0


def test_reoriented_voxels_stay_where_they_are(spark):
    new, dim = {"x": "-y", "y": "z", "z": "x"}, {"x": 5, "y": 4, "z": 3}
    m = np.array(META.sform).reshape(4, 4) if hasattr(META, "sform") else np.array([[1.0, 0, 0, -4], [0, 2, 0, 3], [0, 0, 3, 1], [0, 0, 0, 1]])
    turned = images.reoriented_world(m, new, dim)
    df = spark.createDataFrame([(1, 2, 0, 7.0), (4, 3, 2, 8.0)], "x int, y int, z int, value double")
    for a, b in zip(df.orderBy("value").collect(), images.reoriented(df, new, dim).orderBy("value").collect(), strict=True):
        assert np.allclose(m @ [a.x, a.y, a.z, 1], turned @ [b.x, b.y, b.z, 1])


def test_matrix_size(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    (tmp_path / "bad.txt").write_text("1 2 3\n4 5\n")
    assert images.matrix_size(spark, str(tmp_path / "m.txt")) == (2, 3)
    with pytest.raises(ValueError):
        images.matrix_size(spark, str(tmp_path / "bad.txt"))


def test_grids_in_the_middle_cover_both_images(spark):
    from voxlake.operators.transform import middle_grids

    forward, backward, box = middle_grids(spark, {"x": 10, "y": 8}, {"x": 10, "y": 8}, [1, 0, 0, 4.0, 0, 1, 0, -2.0, 0, 0, 1, 0, 0, 0, 0, 1], 2.0)
    assert box == {"x": (-2, 11), "y": (-1, 8)}
    first = forward.where("x = 1 AND y = 1").first()
    assert (first.vx, first.vy) == (-2.0, -1.0) and backward.count() == 10 * 8

import numpy as np
import pytest

from voxlake.operators import matrix as m


def some(k=2):
    return m.make_affine([10 * k, -7, 4], [3, -2, k], [1.1, 0.9, 1], [0.05, 0, 0.02])


def test_log_and_exp_undo_each_other():
    assert np.allclose(m.expm(m.logm(some())), some(), atol=1e-10)


def test_half_applied_twice():
    assert np.allclose(m.half(some()) @ m.half(some()), some(), atol=1e-10)


def test_mean_of_equal_matrices():
    assert np.allclose(m.mean([some()] * 3), some(), atol=1e-9)


def test_trimmed_mean_leaves_outliers_out():
    assert np.allclose(m.trimmed_mean([some(), some(), some(), m.make_affine([0, 0, 80], [50, 0, 0], [2, 2, 2], [0, 0, 0])]), some(), atol=1e-6)


def test_rigid_part_is_a_rotation():
    r = m.rigid_part(some())[:3, :3]
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-12) and np.linalg.det(r) > 0


def test_demean_of_rigid_matrices_is_identity():
    assert np.allclose(m.demean([m.make_affine([5, 3, 1], [1, 2, 3], [1, 1, 1], [0, 0, 0])] * 2), np.eye(4), atol=1e-9)


@pytest.mark.parametrize("rigid", [True, False])
def test_trimmed_fit_finds_the_matrix_despite_outliers(spark, rigid):
    from voxlake.operators.estimate import trimmed_fit

    rng = np.random.default_rng(0)
    truth = m.make_affine([10, -5, 20], [4, -3, 2], [1, 1, 1] if rigid else [1.2, 0.9, 1.1], [0, 0, 0] if rigid else [0.1, 0, 0])
    r = rng.uniform(-50, 50, (120, 3))
    w = r @ truth[:3, :3].T + truth[:3, 3]
    w[:20] += rng.uniform(-100, 100, (20, 3))
    df = spark.createDataFrame(np.hstack([r, w]).tolist(), "rx double, ry double, rz double, wx double, wy double, wz double")
    assert np.allclose(trimmed_fit(df, 3, 50, rigid), truth, atol=1e-3)


def test_kabsch_never_reflects():
    x = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]])
    y = x * np.array([1, 1, -1])
    out = m.rigid_from_moments(4, x.sum(0), y.sum(0), x.T @ x, x.T @ y)
    assert np.linalg.det(out[:3, :3]) == pytest.approx(1)

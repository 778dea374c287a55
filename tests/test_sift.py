import numpy as np

from vicinal.functions.sift import Parameters, extract_keypoints, keypoints


def blobs(angle=0.0, size=96):
    ys, xs = np.mgrid[0:size, 0:size] - size / 2
    c, s = np.cos(angle), np.sin(angle)
    x, y = c * xs + s * ys, -s * xs + c * ys
    image = np.zeros((size, size))
    for bx, by, r, v in ((-18, -12, 4, 200), (15, 10, 5, 150), (10, -20, 3, 220), (-12, 18, 6, 120)):
        image += v * np.exp(-((x - bx) ** 2 + (y - by) ** 2) / (2 * r * r))
    return image


def test_finds_blobs_where_they_are():
    found = keypoints(blobs(), Parameters(peak=1.0))
    at = np.array([(k[0], k[1]) for k in found])
    for bx, by in ((-18, -12), (15, 10), (10, -20), (-12, 18)):
        assert np.hypot(at[:, 0] - 48 - bx, at[:, 1] - 48 - by).min() < 1.5
    assert all(np.isclose(np.linalg.norm(k[4]), 1) and len(k[4]) == 128 for k in found)


def test_descriptors_survive_a_turn():
    a, b = keypoints(blobs(), Parameters(peak=1.0)), keypoints(blobs(np.pi / 2), Parameters(peak=1.0))
    assert len(a) and len(b)
    best = [min(np.linalg.norm(x[4] - y[4]) for y in b) for x in a]
    assert np.median(best) < 0.4


def test_table(spark):
    rows = [(1, 96, 96, blobs().ravel().tolist()), (2, 0, 0, []), (3, 4, 4, [0.0] * 16), (4, 9, 9, None), (5, 64, 64, [7.0] * 4096)]
    got = extract_keypoints(spark.createDataFrame(rows, "object int, width int, height int, pixels array<double>"), p=Parameters(peak=1.0)).toPandas()
    assert set(got["object"]) == {1} and got["feature"].map(max).max() <= 1 and got["t"].between(0, 1.1).all()

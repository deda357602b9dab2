"""Malformed images and integral rows."""

import numpy as np
import pytest

from sparkloom.llm import media


def test_malformed_images_are_errors():
    for data in (b"P3\n1 1\n255\n99999999999999999999 1 1", b"P2 1 1 255\n-5", b"P2 1 1 255\nx", b"P7\nWIDTH -3\nHEIGHT -3\nDEPTH 1\nMAXVAL 255\nENDHDR\n" + b"x" * 9, b"P7\nWIDTH 0\nHEIGHT 1\nDEPTH 1\nMAXVAL 255\nENDHDR\nx", b"P5 1 1 70000\nx", b"P2\n2 2\n255\n", b"P1"):
        rows = media.image_tiles(data)
        assert len(rows) in (1, 4) and (len(rows) == 4 or rows[0][-1])
    assert (media.decode(b"P2 2 1 255\n300 7")[0].reshape(-1) == [255, 7]).all()
    assert (media.decode(b"P2 2 1 255\n99999999999 7")[0].reshape(-1) == [255, 7]).all()


def test_mutated_images_never_raise():
    rng = np.random.default_rng(8)
    images = [media.drawn(k, rng.integers(0, 256, 300).astype(np.uint8).tobytes()) for k in range(len(media.DRAWN))]
    for data in images:
        assert media.image_tiles(data)[0][-1] is None
        for _ in range(400):
            bad = bytearray(data)
            for at in rng.integers(0, min(len(bad), 70), rng.integers(1, 5)):
                bad[at] = rng.integers(0, 256)
            media.image_tiles(bytes(bad[: rng.integers(0, len(bad) + 1)] if rng.random() < 0.3 else bad))


@pytest.mark.parametrize("shape,to", [((1, 1, 1), (64, 64)), ((37, 53, 3), (64, 64)), ((200, 3, 4), (8, 9)), ((9000, 5, 2), (7, 3))])
def test_averages_are_the_areas(shape, to):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)

    def shares(size, n):
        edges = np.arange(n + 1) * size / n
        low, high = np.arange(size)[None, :], np.arange(1, size + 1)[None, :]
        return np.clip(np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low), 0, None) * n / size

    want = np.einsum("yi,ijc,xj->yxc", shares(shape[0], to[0]), image.astype(float), shares(shape[1], to[1]))
    assert np.allclose(media.Integral(image, (to[0], 8)).averages(*to), want, atol=1e-6)


def test_formats_hold_the_drawn_samples():
    data = bytes(range(256)) * 3
    for k, (kind, depth) in enumerate(media.DRAWN):
        image, name = media.decode(media.drawn(k, data))
        flat = image[:, :, :1].reshape(-1) if depth == 1 else image.reshape(-1)
        want = np.frombuffer(data, np.uint8)
        if kind in (1, 4):
            want = np.where(want < 128, 0, 255)
        if (kind, depth) == (0, 4):
            flat, want = image.reshape(-1), np.delete(want.reshape(-1, 4), 3, 1).reshape(-1)
        assert name == (f"P{kind}" if kind else "BMP") and (flat[: len(want)] == want).all()

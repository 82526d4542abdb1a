import numpy as np
import pytest

from lodestone.functions import raster
from lodestone.functions.text import TextFailure
from lodestone.plans.cases import _pictures, _pixels, _png
from lodestone.plans.engine import EncodeRequest, Engine, default_readers


def test_interlaced_and_small_depths():
    bits = (_pixels()[:, :, 0] > 100).astype(np.uint8)
    one = _png(np.packbits(bits, axis=1), 0, 1, (0, 2))
    assert np.array_equal(raster.read_rgb(one)[0], np.repeat(bits[:, :, None] * 255, 3, 2))
    tga = bytes([0, 0, 2]) + bytes(9) + (96).to_bytes(2, "little") + (64).to_bytes(2, "little") + bytes([24, 32]) + _pixels()[:, :, ::-1].tobytes()
    assert np.array_equal(raster.read_rgb(tga, "tga")[0], _pixels())
    runs = bytes([0, 0, 11]) + bytes(9) + (4).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes([8, 32]) + bytes([0x82, 7, 0, 9])
    assert raster.read_rgb(runs, "tga")[0][0, :, 0].tolist() == [7, 7, 7, 9]


@pytest.mark.parametrize("name", [n for n, c in _pictures().items() if n not in ("damaged png", "cut off ppm", "huge", "jpeg")])
def test_what_is_cut_off_is_refused(name):
    whole = _pictures()[name]
    assert raster.read_rgb(whole)[0].shape == (64, 96, 3)
    for size in (9, len(whole) // 2):
        with pytest.raises(TextFailure):
            raster.read_rgb(whole[:size])


def test_preprocessing():
    rng = np.random.default_rng(1)
    same = rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    back = raster.preprocess(same, 40).transpose(1, 2, 0) * np.array(raster.DEVIATION) + np.array(raster.MEAN)
    assert np.abs(back * 255 - same).max() < 0.01
    flat = np.full((17, 90, 3), 128, np.uint8)
    assert np.ptp(raster.preprocess(flat, 32), axis=(1, 2)).max() < 1e-6 and raster.preprocess(flat).shape == (3, 320, 320)
    ramp = np.repeat(np.arange(200, dtype=np.uint8)[None, :, None], 3, 2).repeat(50, 0)
    means = raster.preprocess(ramp, 50)[0].mean(0) * raster.DEVIATION[0] * 255 + raster.MEAN[0] * 255
    assert np.allclose(np.diff(means)[1:-1], 4, atol=0.6) and (raster.triangle(7, 20).sum(1) - 1 < 1e-6).all()


def test_a_model_can_be_plugged_in(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(_pictures()["png"])
    (tmp_path / "broken.png").write_bytes(_pictures()["damaged png"])
    reader = raster.model_reader(lambda x: x.reshape(3, -1).mean(1).repeat(171)[:512] + 0.1)
    rows = {r.path: r for r in Engine(spark, readers=default_readers() | {("image", "raster"): reader}).encode(EncodeRequest(str(tmp_path))).records.collect()}
    assert rows["p.png"].state == "ready" and len(rows["p.png"].vector) == 512 and rows["broken.png"].error.code == "decode_failed"

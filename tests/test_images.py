from __future__ import annotations

import numpy as np
import pytest

from gridloom.functions.pyramid import Affine
from gridloom.sources.images import read_geotiff, read_png, write_geotiff, write_png


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64"])
def test_geotiff(dtype):
    data = (np.arange(3 * 5 * 7).reshape(3, 5, 7) % 200).astype(dtype)
    a = Affine(0.5, 0.0, 10.0, 0.0, -0.5, 50.0)
    got, meta = read_geotiff(write_geotiff(data, a, "EPSG:3857", 7, {"k": "v"}))
    assert (got == data).all() and meta == {"affine": a, "crs": "EPSG:3857", "nodata": 7.0, "dtype": dtype}


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png(bands):
    data = (np.arange(bands * 4 * 6).reshape(bands, 4, 6) * 7 % 256).astype(np.uint8)
    assert (read_png(write_png(data)) == data).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        read_geotiff(b"no image at all")

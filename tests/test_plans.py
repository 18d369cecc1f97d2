"""From photos to answers, with a recognizer that reads a disc's size."""

from __future__ import annotations

import io

import numpy as np
import pytest

from lodestone.operators import kernels
from lodestone.plans import cli
from lodestone.plans.service import Invalid, Missing, Service


@pytest.fixture
def by_size():
    """A recognizer as workers can get it: made within a function, so that it travels whole."""

    class BySize:
        """Reads each crop's brightness as a code; dim pieces are unreadable."""

        def read(self, image):
            share = int((image[..., 0] > 150).mean() * 100)
            return [] if share < 60 else [(f"b-{300 + share}", 0.95, None)]

    return BySize


@pytest.fixture
def photo(tmp_path):
    image = np.full((200, 300, 3), 18, np.uint8)
    yy, xx = np.mgrid[:200, :300]
    image[(xx - 70) ** 2 + (yy - 90) ** 2 <= 40**2] = 235
    image[(abs(xx - 210) <= 45) & (abs(yy - 90) <= 45)] = 235
    image[(abs(xx - 150) + abs(yy - 160)) <= 28] = 235
    path = tmp_path / "desk.png"
    path.write_bytes(kernels.png(image))
    return path


def test_index_query_and_render(spark, photo, by_size, tmp_path):
    service = Service(spark, str(tmp_path / "index"), by_size)
    with pytest.raises(Invalid):
        service.ingest(str(photo), "2026-01-01T00:00:00", "a/b")
    row = service.ingest(str(photo), "2026-01-01T00:00:00").first()
    assert (row["photo_id"], row["total"]) == ("desk", 3) and 1 <= row["recognized"] < 3
    code = service.pieces().where("code is not null").first()["code"]
    found, rows = service.query(f" {code.lower()} ")
    assert found and rows.first()["photo_id"] == "desk"
    found, rows = service.query("D-777")
    assert not found and rows.first()["n"] == 3 - row["recognized"]
    assert service.highlight(code)[:4] == service.thumbnail(code)[:4] == service.highlight("D-777", "desk")[:4] == b"\x89PNG"
    with pytest.raises(Missing):
        service.highlight("D-777")
    out = io.StringIO()
    base = ["--index-dir", str(tmp_path / "index")]
    assert cli.main(["query", code, *base], spark, by_size, out) == 0
    assert cli.main(["query", "D-777", *base], spark, by_size, out) == 1
    assert cli.main(["stats", *base], spark, by_size, out) == 0
    assert cli.main(["index", str(tmp_path / "none.png"), *base], spark, by_size, out) == 2
    assert "desk" in out.getvalue()
    service.delete("desk")
    with pytest.raises(Missing):
        service.delete("desk")


def test_upload_of_bytes(spark, photo, by_size, tmp_path):
    service = Service(spark, str(tmp_path / "index"), by_size)
    data = photo.read_bytes()
    with pytest.raises(Invalid):
        service.upload(data, "x.png", "2026-01-01T00:00:00", " ")
    with pytest.raises(Invalid):
        service.upload(b"no image", "x.png", "2026-01-01T00:00:00")
    assert service.upload(data, "in/left.PNG", "2026-01-01T00:00:00").first()["photo_id"] == "left"
    assert service.upload(data, "in/left.PNG", "2026-01-02T00:00:00", " right ").first()["photo_id"] == "right"
    unnamed = service.upload(data, None, "2026-01-03T00:00:00").first()["photo_id"]
    assert len(unnamed) == 8 and service.upload(data, "left", "2026-01-04T00:00:00").first()["created_at"] == "2026-01-04T00:00:00"
    with pytest.raises(Invalid):
        service.upload(b"no image", "left.png", "2026-01-05T00:00:00")
    stored = tmp_path / "index-photos"
    assert {p.name for p in stored.glob("*.image")} == {"left.image", "right.image", f"{unnamed}.image"} and (stored / "left.image").read_bytes() == data
    assert {r["photo_id"]: r["total"] for r in service.summary().collect()} == {"left": 3, "right": 3, unnamed: 3}

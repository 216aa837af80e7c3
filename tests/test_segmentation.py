"""The steps of segmentation as relations against those of the photo kernel, on the same derived photos."""

import numpy as np
import pytest

from pigmenta.operators import segment
from pigmenta.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    rows = plans.queries()["kept_parts"](spark, FOLDER).collect()
    masks = {p: np.zeros((50, 64), bool) for p in {r.photo_id for r in rows}}
    for r in rows:
        masks[r.photo_id][r.y, r.x] = True
    return masks


def test_owners_and_shapes_are_those_of_the_kernel(spark, kept):
    owners = {}
    for r in plans.queries()["seed_owners"](spark, FOLDER).collect():
        owners.setdefault(r.photo_id, np.zeros((50, 64), int))[r.y, r.x] = r.seed
    objects = plans.queries()["segmented_objects"](spark, FOLDER).collect()
    assert len(kept) >= 8 and set(owners) == set(kept)
    for photo, mask in kept.items():
        parts = segment.parts_of(mask)
        owner, distance = segment.split_touching(mask, parts, np.arange(len(parts.area)) > 0)
        assert (owner == owners[photo]).all()
        shapes = segment.shapes_of(owner, distance, np.zeros((50, 64, 3)))
        mine = sorted((r for r in objects if r.photo_id == photo), key=lambda r: r.seed)
        assert [r.area for r in mine] == shapes.area.tolist()
        assert np.allclose([(r.cx, r.cy, r.rx, r.ry) for r in mine], shapes.ellipse[:, :4], atol=1e-4) and np.allclose([r.fill for r in mine], shapes.fill, atol=1e-5)


def test_a_photo_of_one_colour_has_no_part(spark, tmp_path):
    spark.range(50).selectExpr("id AS vec_id", "array_repeat(CAST(0.1 AS FLOAT), 64) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = plans.queries()
    (status,) = q["segment_status"](spark, str(tmp_path)).collect()
    assert (status.status, status.objects, status.bare) == ("no part", 0, 1.0) and q["segmented_objects"](spark, str(tmp_path)).count() == 0
    (sheet,) = q["sheet_colour"](spark, str(tmp_path)).collect()
    assert sheet.share == 1.0

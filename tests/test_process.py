from dataclasses import asdict

import numpy as np
import pytest

from tarn import cli, process
from tarn.operators import audit
from tarn.plans.lattice import GridPlan
from tarn.sources import binary, catalog

PLAN = GridPlan(25833, 5.0, 0.0, 0.0, 8, 2, 2, 2)


@pytest.fixture(scope="module")
def world(spark):
    r, c = np.mgrid[0:17, 0:17]
    h = 120.0 + r * 0.5 + c * 0.25
    lake = (r - 8) ** 2 + (c - 8) ** 2 <= 16
    h[lake] = 118.0
    rows = [(int(a), int(b), float(h[a, b]), 2 if lake[a, b] else 0, 1 if lake[a, b] else 0) for a in range(17) for b in range(17)]
    cells = spark.createDataFrame(rows, "row int, col int, h double, kind int, lake_id int")
    return cells, spark.createDataFrame([(1, 119.0, False)], "lake_id int, published double, regulated boolean")


def test_process_and_validate(spark, world, tmp_path, capsys):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    catalog.write_manifest(data, "dataset.json", {"plan": asdict(PLAN), "name": "bowl"})
    for name, df in zip(("cells", "lakes"), world, strict=True):
        df.write.parquet(f"{data}/{name}.parquet")
    assert cli.main(["process", data, out]) == 0
    assert cli.main(["validate", out]) == 0 and "ok" in capsys.readouterr().out
    assert cli.main(["exports", str(tmp_path)]) == 0
    made = catalog.read_manifest(out, "manifest.json")
    assert made["level_sources"] == {"nve_hoyde": 1} and made["statistics"]["tree_errors"] == 0
    codes = binary.read_level(f"{out}/heights.atlas", PLAN, 0, "<u2")
    metres = made["height_min"] + codes / 65535 * (made["height_max"] - made["height_min"])
    assert metres[8, 8] < 118 and metres[0, 0] == pytest.approx(120, abs=0.01)
    assert (binary.read_level(f"{out}/water_id.atlas", PLAN, 1, "<u2") == 17).sum() > 5
    assert binary.read_level(f"{out}/surface.atlas", PLAN, 0, "<u2")[0, 0] == 65535
    with open(f"{out}/heights.atlas", "r+b") as f:
        f.truncate(64)
    assert cli.main(["validate", out]) == 1


def test_checks(spark):
    tree = spark.createDataFrame([(0, None, None, None, 9), (1, 3, 5, 8, 2), (2, 3, 4, 8, 2), (3, 0, 4, 7, 4), (4, 9, 1, 2, 1)], "node int, parent int, floor_code int, spill_code int, subtree_cells long")
    assert {(r.node, r.error) for r in audit.check_tree(tree).collect()} == {(1, "parent spills lower"), (2, "parent spills lower"), (4, "no parent")}
    seg = spark.createDataFrame([(1, 2, 5.0), (2, None, 3.0), (3, 8, 1.0)], "seg_id int, downstream int, discharge double")
    junctions = spark.createDataFrame([(1, 7)], "seg_id int, lake_id int")
    lakes = spark.createDataFrame([(6,)], "lake_id int")
    assert {(r.seg_id, r.error) for r in audit.check_links(seg, junctions, lakes).collect()} == {(1, "less discharge downstream"), (3, "no such segment"), (1, "unknown lake")}
    assert audit.differences(seg, seg).count() == 0 and audit.differences(seg, seg.limit(2)).count() == 1


def test_match_lakes(spark):
    cells = spark.createDataFrame([(1, 1, 5.0)] * 6 + [(1, 0, 9.0)] * 2 + [(2, 0, 6.0)] * 4 + [(2, 2, 6.5)], "label int, lake_id int, h double")
    tree = spark.createDataFrame([(0, None, None, 0.0), (1, 3, 8.0, 1.0), (2, 3, 8.0, 0.0), (3, 0, 10.0, 0.0)], "node int, parent int, spill_m double, head double")
    levels = spark.createDataFrame([(1, 7.0, False), (2, None, False), (5, 3.0, False)], "lake_id int, level double, regulated boolean")
    got = {r.lake_id: (r.node, r.status) for r in audit.match_lakes(cells, tree, levels).collect()}
    assert got == {1: (1, "ok"), 2: (None, "no_level"), 5: (None, "no_node")}
    assert {r.lake_id: r.status for r in audit.match_lakes(cells, tree, spark.createDataFrame([(1, 8.5, False)], levels.schema)).collect()} == {1: "held_by_outflow"}

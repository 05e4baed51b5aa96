import json

import numpy as np
import pytest

from lumenweave.sources import asdf, fits, products, records


def test_asdf_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    sci = np.arange(20, dtype=np.float32).reshape(4, 5)
    dq = np.zeros((4, 5), dtype=np.uint32)
    dq[2, 3] = 1 << 31
    asdf.write_asdf(str(tmp_path / "a.asdf"), {"data": sci, "dq": dq}, {"instrument": "X1", "exptime": 12.5})
    df = asdf.open_raster(spark, str(tmp_path / "a.asdf"), tileSize="2")
    got = {(r.x, r.y): r.v for r in fits.pixels(df.filter("extname = 'data'")).collect()}
    assert got == {(x, y): float(sci[y, x]) for y in range(4) for x in range(5)}
    assert [(r.x, r.y, r.exact) for r in fits.pixels(df.filter("extname = 'dq'")).filter("exact <> 0").collect()] == [(3, 2, 1 << 31)]
    assert df.first().cards["instrument"] == "X1"
    raw = bytearray((tmp_path / "a.asdf").read_bytes())
    raw[-1] ^= 1
    (tmp_path / "a.asdf").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        asdf.open_raster(spark, str(tmp_path / "a.asdf")).collect()


def test_mosaic_and_listing(spark, tmp_path):
    rows = [(x, y, float(x + y), 2.0, 3, 8) for x in range(4) for y in range(3)]
    m = spark.createDataFrame(rows, "ox long, oy long, v double, weight double, inputs int, dq int")
    path = str(tmp_path / "F606W_x_drz.fits")
    products.save_mosaic(m, path, 4, 3, cards={"TELESCOP": "T", "EXPTIME": 10.0})
    got = products.list_headers(spark, path).collect()
    assert [(r.extname, r.width, r.height) for r in got] == [("", 4, 3), ("WHT", 4, 3), ("NCONTRIB", 4, 3), ("DQ", 4, 3)]
    assert got[0].telescop == "T" and got[0].samples == 12 and got[2].median == 3
    (tmp_path / "f814w_y_driz.fits").write_bytes(b"x")
    (tmp_path / "b_starmap.fits").write_bytes(b"x")
    found = products.discover(spark, str(tmp_path))
    assert found.count() == 2 and [r.filter for r in products.compose_inputs(found).collect()] == ["F606W", "F814W"]


def test_masks(spark, tmp_path):
    mask = spark.createDataFrame([(1, 1), (3, 0)], "x long, y long")
    path = str(tmp_path / "m.fits")
    products.save_mask(mask, path, 4, 2)
    assert sorted((r.x, r.y) for r in products.read_mask(spark, path).collect()) == [(1, 1), (3, 0)]
    with pytest.raises(FileExistsError):
        products.save_mask(mask, path, 4, 2)
    with pytest.raises(ValueError):
        products.save_mask(mask, str(tmp_path / "n.fits"), 2, 2)


def test_reduced_copies(spark, tmp_path):
    fits.write_file(str(tmp_path / "a.fits"), [("", np.arange(36, dtype=np.float32).reshape(6, 6), {})])
    out = products.reduce_files(spark, str(tmp_path / "a.fits"), str(tmp_path / "o"), 4).collect()
    assert len(out) == 1 and out[0].chips == 1 and out[0].path.endswith("a_bin4.fits")
    fits.register(spark)
    got = fits.pixels(spark.read.format("fits").load(str(tmp_path / "o"))).filter("extname = 'SCI'").collect()
    assert [(r.x, r.y, r.v) for r in got] == [(0, 0, np.arange(36).reshape(6, 6)[:4, :4].mean())]  # incomplete edge blocks go
    with pytest.raises(FileExistsError):
        products.reduce_files(spark, str(tmp_path / "a.fits"), str(tmp_path / "o"), 4)
    with pytest.raises(ValueError):
        products.reduce_files(spark, str(tmp_path / "a.fits"), str(tmp_path / "p"), 3)


def test_context_planes(spark):
    k = spark.createDataFrame([(0, 0, f) for f in (0, 31, 32, 70)] + [(1, 0, 5)], "ox long, oy long, frame long")
    got = {r.ox: (r.planes, r.inputs) for r in products.context_planes(k).collect()}
    assert got == {0: ({0: (1 << 31) | 1, 1: 1, 2: 1 << 6}, 4), 1: ({0: 32}, 1)}


def test_projects_and_offsets(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"weights": [{"id": "a", "red": 1.0, "green": 0.0, "blue": 0.0}, {"id": "a", "red": 1.0, "green": 0.0, "blue": 0.0}, {"id": "b", "red": -1.0, "green": 0.0, "blue": 0.0}], "layers": [{"id": "x", "path": "y", "stretch": {"mode": "Log"}}]}))
    project = records.read_project(spark, str(p))
    assert project.first().mode == "artistic" and project.first().layers[0].stretch.scaled == 100.0
    assert sorted(r.reason for r in records.invalid_weights(project).collect()) == ["share", "twice", "twice"]
    old = tmp_path / "o.txt"
    old.write_text("# old\na.fits 1.5 -2\nb.fits 3 4\n")
    new = tmp_path / "o.json"
    new.write_text(json.dumps([{"name": "b.fits", "dx": 9.0}, {"name": "c.fits"}]))
    merged = records.update_offsets(records.read_offsets(spark, str(old)), records.read_offsets(spark, str(new))).collect()
    assert [(r.name, r.dx, r.dy, r.a) for r in merged] == [("a.fits", 1.5, -2.0, 1.0), ("b.fits", 9.0, 0.0, 1.0), ("c.fits", 0.0, 0.0, 1.0)]
    assert [r["split"] for r in records.default_regions(40, 30)][:3] == ["train", "train", "validation"]


def test_corpus_subpackage_is_optional():
    """Nothing outside the subpackage needs it."""
    import pathlib

    root = pathlib.Path(products.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "lumenweave.llm" not in f.read_text(), f

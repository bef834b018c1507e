import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox import api, cli
from stratavox.sources import files, sinks
from stratavox.sources.volumes import read_label_volume

OUTLINE = "ID,Abbreviation,is_leaf,RegionLevel_01,RegionLevel_02,RegionLevel_03\n1,root,,root,,\n10, A ,,,Area,\n11,A1,LEAF,,,deep\n20010,A-other,leaf,,,rest\n12,B,leaf,,b,\n"
VOLUMES = "region_id,aggregated_voxel_count,aggregated_volume_mm3\n1,100,10.0\n10,70,7.0\n11,50,5.0\n12,30,3.0\n"
MERGE = "ID,Abbreviation,Description\n5,G,group,11,12,,11\n6,H,empty\n"


@pytest.fixture()
def folder(tmp_path):
    for name, text in (("outline.csv", OUTLINE), ("volumes.csv", VOLUMES), ("merge.csv", MERGE)):
        (tmp_path / name).write_text(text)
    return tmp_path


def volume():
    return np.random.default_rng(4).integers(0, 300, (5, 6, 7)).astype("<u2")


def write_chunks(path, data, codec, version):
    root = path / "data"
    root.mkdir(parents=True)
    chunks = [2, 4, 4]
    pack = {"zlib": zlib.compress, None: bytes, "zstd": lambda b: __import__("zstandard").compress(b)}[codec]
    if version == 2:
        (root / ".zarray").write_text(json.dumps({"shape": list(data.shape), "chunks": chunks, "dtype": "<u2", "fill_value": 0, "order": "C", "filters": None, "compressor": codec and {"id": codec}}))
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])
        (root / "zarr.json").write_text(json.dumps({"shape": list(data.shape), "chunk_grid": {"configuration": {"chunk_shape": chunks}}, "data_type": "uint16", "fill_value": 0, "codecs": codecs}))
    for k in range(3):
        for i in range(2):
            for j in range(2):
                part = data[2 * k : 2 * k + 2, 4 * i : 4 * i + 4, 4 * j : 4 * j + 4]
                full = np.zeros(chunks, data.dtype)
                full[: part.shape[0], : part.shape[1], : part.shape[2]] = part
                if not full.any():
                    continue
                name = f"{k}.{i}.{j}" if version == 2 else f"c/{k}/{i}/{j}"
                (root / name).parent.mkdir(parents=True, exist_ok=True)
                (root / name).write_bytes(pack(full.tobytes()))


def write_tiff(path, pages):
    out, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for page in pages:
        data_at = len(out)
        out += page.tobytes()
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, data_at), (278, 4, page.shape[0]), (279, 4, page.nbytes)]
        struct.pack_into("<I", out, links[-1], len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        links.append(len(out))
        out += struct.pack("<I", 0)
    path.write_bytes(bytes(out))


def rebuilt(df):
    rows = df.collect()
    out = np.zeros((5, 6, 7), int)
    for r in rows:
        out[r["z"], r["y"]] = r["labels"]
    assert len(rows) == 30
    return out


@pytest.mark.parametrize("codec,version", [(None, 2), ("zlib", 2), ("zstd", 3)])
def test_chunked_volumes(spark, tmp_path, codec, version):
    data = volume()
    data[2:4] = 0
    path = tmp_path / "v.zarr"
    write_chunks(path, data, codec, version)
    df = read_label_volume(spark, str(path))
    assert df.rdd.getNumPartitions() == 3 and (rebuilt(df) == data).all()
    assert sorted({r["z"] for r in df.filter("z >= 4").collect()}) == [4]
    with zipfile.ZipFile(tmp_path / "v.zarr.zip", "w") as z:
        for p in path.rglob("*"):
            if p.is_file():
                z.write(p, p.relative_to(path))
    assert (rebuilt(read_label_volume(spark, str(tmp_path / "v.zarr.zip"))) == data).all()


def test_image_stacks(spark, tmp_path):
    data = volume()
    write_tiff(tmp_path / "all.tif", data)
    (tmp_path / "slices").mkdir()
    for i, page in enumerate(data):
        write_tiff(tmp_path / "slices" / f"s{i:03d}.tif", [page])
    assert (rebuilt(read_label_volume(spark, str(tmp_path / "all.tif"))) == data).all()
    assert (rebuilt(read_label_volume(spark, str(tmp_path / "slices"))) == data).all()


def test_detections(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        "<Root><Data><Marker_Type><Type>1</Type><Marker><MarkerX>1</MarkerX><MarkerY>2</MarkerY><MarkerZ>3</MarkerZ></Marker></Marker_Type>"
        "<Marker_Type><Type>2</Type><Marker><MarkerX>4</MarkerX><MarkerY>5</MarkerY><MarkerZ>6.5</MarkerZ></Marker><Marker><MarkerX>7</MarkerX><MarkerY>8</MarkerY><MarkerZ>9</MarkerZ></Marker></Marker_Type></Data></Root>"
    )
    got = files.read_cells_xml(spark, str(tmp_path / "c.xml"))
    assert sorted((r["z"], r["y"], r["x"]) for r in got.collect()) == [(6.5, 5, 4), (9, 8, 7)] and files.read_cells_xml(spark, str(tmp_path / "c.xml"), cells_only=False).count() == 3
    (tmp_path / "c.yml").write_text("- {z: 1, y: 2, x: 3, type: 2, metadata: {r_xy: 1.5}}\n- {z: 4, y: 5, x: 6}\n")
    rows = files.read_cells_yaml(spark, str(tmp_path / "c.yml")).collect()
    assert [(r["z"], r["metadata"]) for r in rows] == [(1.0, {"r_xy": 1.5}), (4.0, {})]


def test_summarize_layouts_and_files(spark, folder):
    cells = spark.createDataFrame([(i, r, 2.0) for i, r in enumerate([10, 11, 12, 0])], "cell_ord long, region_id int, r_xy double")
    outline, volumes, merge = files.read_outline(spark, str(folder / "outline.csv")), files.read_volumes(spark, str(folder / "volumes.csv")), files.read_merge_tree(spark, str(folder / "merge.csv"))
    api.summarize_regions(cells=cells, outline=outline, volumes=volumes, output_path=str(folder / "flat.csv"), cell_filters=["r_xy>0"])
    text = (folder / "flat.csv").read_bytes().decode()
    assert text.split("\r\n")[0] == ",".join(sinks.FLAT_HEADER) and text.split("\r\n")[1] == "1,root,root,100,10.0,3,0.3"
    api.summarize_regions(cells=cells, outline=outline, volumes=volumes, output_path=str(folder / "levels.csv"), levels=True)
    assert (folder / "levels.csv").read_text().splitlines()[4] == "20010,A-other,TRUE,10,10,A,20,2.0,1,0.5,,,rest"
    merged = api.summarize_regions(cells=cells, outline=outline, volumes=volumes, merge_tree=merge, output_path=str(folder / "merged.csv"))
    assert [(r["group_id"], r["n_cells"], r["volume_voxels"]) for r in merged.collect()] == [(5, 3, 130)]
    with pytest.raises(ValueError, match="level layout"):
        api.summarize_regions(cells=cells, outline=outline, volumes=volumes, merge_tree=merge, levels=True)
    with pytest.raises(ValueError, match="add up"):
        api.summarize_regions(cells=cells, outline=outline, volumes=volumes.filter("region_id <> 12"))


def test_filter_and_locate_outputs(spark, folder):
    spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0, 5.0)], "cell_ord long, z double, y double, x double, r_xy double").write.parquet(str(folder / "cells"))
    cells = spark.read.parquet(str(folder / "cells"))
    api.filter_cells(cells=cells, cell_filters=["r_xy>2"], output_path=str(folder / "kept"), removed_path=str(folder / "removed"))
    assert [r["cell_ord"] for r in spark.read.parquet(str(folder / "kept")).collect()] == [2] and [r["cell_ord"] for r in spark.read.parquet(str(folder / "removed")).collect()] == [1]
    with pytest.raises(ValueError, match="being read"):
        sinks.write_cells(cells, str(folder / "cells"), "overwrite")
    outline = files.read_outline(spark, str(folder / "outline.csv"))
    annotation = spark.createDataFrame([(0, 0, [10, 12])], "z int, y int, labels array<int>")
    located = api.locate_cells(cells=cells, annotation=annotation, atlas_name="own", outline=outline)
    assert {r["cell_ord"]: r["region_id_own"] for r in located.collect()} == {1: 20010, 2: 12}


def test_panels(spark):
    values = spark.createDataFrame([(float(v + 1),) for v in range(100)], "r_xy double")
    panels = api.distributions(values, "r_xy")
    assert set(panels) == {"log", "linear", "inverse_gamma", "q01_q99", "q05_q95", "titles"} and sum(r["n"] for r in panels["linear"].collect()) == 100


def test_scales_and_titles_of_panels(spark):
    from stratavox.functions.panels import quantile_to_value, range_title, value_to_quantile

    made = api.distributions(spark.createDataFrame([(float(v),) for v in range(101)], "r_xy double"), "r_xy")
    cut = made["q05_q95"].orderBy("bin").collect()
    assert (cut[0]["low"], cut[0]["low_quantile"]) == (5.0, 0.05) and cut[-1]["high_quantile"] == pytest.approx(0.95)
    assert {r["panel"]: r["title"] for r in made["titles"].collect()}["q01_q99"] == "0.01 - 0.99 quantiles"
    assert range_title(0, 120.5) == "(  0, 120.5)" and range_title(0.5, 1e7, 3) == "(0.5,   3*, 1e+07)"
    there = value_to_quantile(F.col("x"), 2.0, 6.0, 0.1, 0.9)
    rows = spark.createDataFrame([(v,) for v in (2.0, 4.0, 7.0)], "x double").select("x", there.alias("q")).withColumn("y", quantile_to_value(F.col("q"), 2.0, 6.0, 0.1, 0.9)).collect()
    assert [r["q"] for r in rows][:2] == [0.1, 0.5] and [r["y"] for r in rows] == pytest.approx([2.0, 4.0, 7.0])
    empty = api.distributions(spark.createDataFrame([], "r_xy double"), "r_xy")
    assert all(t.count() == 0 for name, t in empty.items() if name != "titles")


@pytest.fixture()
def study(folder):
    (folder / "meta.csv").write_text("Image_name,Condition,Sex\n s1 ,Ctl,F\ns2,ctl,M\ns3,Drug,F\ns4,drug,M\n,Drug,M\nnone,Ctl,F\n")
    (folder / "sums").mkdir()
    for k, s in enumerate(["s1", "s2", "s3", "s4"]):
        lines = ["ID,Abbreviation,Total cells"] + [f"{i},{a},{10 * (k // 2) + k + i % 5}" for i, a in ((1, "root"), (10, "A"), (11, "A1"), (20010, "A-other"), (12, "B"))]
        (folder / "sums" / f"{s}_561_x.csv").write_text("\r\n".join(lines) + "\r\n")
    return folder


def test_collate(spark, study):
    run = dict(spark=spark, metadata_path=str(study / "meta.csv"), summaries_root=str(study / "sums"), channels=[561, 640], lookup_column="Image_name", first_columns=2, pattern="{name}_{channel}_*.csv")
    got = api.collate_summaries(**run, output_path=str(study / "long"))
    assert got.columns == ["Image_name", "Condition", "Channel", "Summary filename", "ID", "Abbreviation", "Total cells"] and got.count() == 20
    assert spark.read.csv(str(study / "long"), header=True).count() == 20
    assert api.collate_summaries(**{**run, "pattern": "{name}-{channel}"}, output_path=str(study / "no")) is None and not (study / "no").exists()
    (study / "sums" / "s1_561_y.csv").write_text("x")
    with pytest.raises(ValueError, match="Several files"):
        api.collate_summaries(**run)
    (study / "sums" / "s1_561_y.csv").unlink()
    (study / "sums" / "s2_561_x.csv").write_text("ID,Other\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        api.collate_summaries(**run)


def test_analyze_by_command_line(spark, study):
    args = cli.parser().parse_args(
        ["analyze", "--metadata", str(study / "meta.csv"), "--summaries-root", str(study / "sums"), "--channel", "561", "--lookup-column", "Image_name", "--pattern", "{name}_{channel}_*.csv", "--outline", str(study / "outline.csv"),
         "--factor", "Condition", "--stat-column", "total cells", "--t-test", "--false-discovery", "--exclude-region", "12", "--raw", str(study / "raw_{channel}.csv"), "--analyzed", str(study / "tests.csv")]
    )
    cli.run(spark, args)
    raw = (study / "raw_561.csv").read_text().splitlines()
    assert raw[0] == "ID,Abbreviation,s1:total cells,s2:total cells,s3:total cells,s4:total cells" and raw[1] == "1,root,1.0,2.0,13.0,14.0" and len(raw) == 5
    tests = (study / "tests.csv").read_text().splitlines()
    assert len(tests) == 5 and tests[0] == "region_id,ID,Abbreviation,p: ctl vs. drug,p-corr: ctl vs. drug"
    assert [line.split(",")[4] == "-1.0" for line in tests[1:]] == [True, True, False, False]
    assert cli.parse_group(["Condition=Ctl", "Sex=F"]) == {"condition": "ctl", "sex": "f"}
    with pytest.raises(ValueError):
        cli.parse_group(["Condition"])
    with pytest.raises(ValueError, match="overwrite"):
        sinks.channel_path("a/b.csv", 561, True)


def test_discovery_and_what_is_missing(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.yml", "a/b/two.yml", "a/good_x.yml", "a/other.txt"):
        (tmp_path / name).write_text("")
    found = files.discover(spark, str(tmp_path), ".yml", ("good*", "bad*"))
    assert [f.rsplit("/", 1)[1] for f in found] == ["two.yml", "one.yml"]
    assert files.without_outputs(spark, [("x", str(tmp_path / "a")), ("y", str(tmp_path / "new"))]) == [("y", str(tmp_path / "new"))]

import pytest

from stratavox import api, cli
from stratavox.sources import files, sinks

OUTLINE = "ID,Abbreviation,is_leaf,RegionLevel_01,RegionLevel_02,RegionLevel_03\n1,root,,root,,\n10, A ,,,Area,\n11,A1,LEAF,,,deep\n20010,A-other,leaf,,,rest\n12,B,leaf,,b,\n"
VOLUMES = "region_id,aggregated_voxel_count,aggregated_volume_mm3\n1,100,10.0\n10,70,7.0\n11,50,5.0\n12,30,3.0\n"
MARKER = "<Marker><MarkerX>{}</MarkerX><MarkerY>{}</MarkerY><MarkerZ>{}</MarkerZ></Marker>"


@pytest.fixture()
def folder(spark, tmp_path):
    (tmp_path / "outline.csv").write_text(OUTLINE)
    (tmp_path / "volumes.csv").write_text(VOLUMES)
    (tmp_path / "c.xml").write_text(
        "<Root><Marker_Type><Type>1</Type>" + MARKER.format(0, 0, 0) + "</Marker_Type><Marker_Type><Type>2</Type>" + MARKER.format(1, 0, 2) + MARKER.format(0, 0, 1) + "</Marker_Type></Root>"
    )
    (tmp_path / "c.yml").write_text(
        "- {z: 2, y: 0, x: 1, type: 2, metadata: {r_xy: 5.0, region_id: 11}}\n- {z: 1, y: 0, x: 0, metadata: {r_xy: 1.0, region_id: 12}}\n- {z: 0, y: 0, x: 0, type: 1, metadata: {r_xy: 9.0}}\n"
    )
    spark.createDataFrame([(1, 2.0, 0.0, 1.0, 5.0, 11), (2, 1.0, 0.0, 0.0, 1.0, 12)], "cell_ord long, z double, y double, x double, r_xy double, region_id int").write.parquet(str(tmp_path / "c.parquet"))
    return tmp_path


def command(spark, *words):
    cli.run(spark, cli.parser().parse_args([str(w) for w in words]))


@pytest.mark.parametrize("kind", ["xml", "yml", "parquet"])
def test_locate_reads_every_format_and_orders_its_output(spark, folder, kind, monkeypatch):
    volume = spark.createDataFrame([(z, 0, [10 + z, 12]) for z in range(3)], "z int, y int, labels array<int>")
    monkeypatch.setattr(cli, "read_label_volume", lambda spark, path: volume)
    command(spark, "locate", "--cells", folder / f"c.{kind}", "--volume", "v", "--output", folder / "out")
    parts = sorted((folder / "out").glob("*.parquet"))
    rows = [tuple(r) for p in parts for r in spark.read.parquet(str(p)).select("z", "x", "y", "region_id").collect()]
    assert rows == [(1.0, 0.0, 0.0, 11), (2.0, 1.0, 0.0, 12)]


@pytest.mark.parametrize("kind", ["yml", "parquet"])
def test_filter_and_summarize_see_the_measures(spark, folder, kind):
    command(spark, "filter", "--cells", folder / f"c.{kind}", "--filter", "r_xy>2", "--output", folder / "kept", "--removed", folder / "removed")
    assert [r["r_xy"] for r in spark.read.parquet(str(folder / "kept")).collect()] == [5.0] and spark.read.parquet(str(folder / "removed")).count() == 1
    command(spark, "summarize", "--cells", folder / f"c.{kind}", "--outline", folder / "outline.csv", "--volumes", folder / "volumes.csv", "--output", folder / "s.csv", "--filter", "r_xy>2")
    assert (folder / "s.csv").read_text().splitlines()[1] == "1,root,root,100,10.0,1,0.1"


def test_all_types_of_detections(spark, folder):
    for kind in ("xml", "yml"):
        assert files.read_cells(spark, str(folder / f"c.{kind}"), cells_only=False).count() == 3 and files.read_cells(spark, str(folder / f"c.{kind}")).count() == 2


def test_filter_on_positions_of_marker_files(spark, folder):
    command(spark, "filter", "--cells", folder / "c.xml", "--filter", "z>1", "--output", folder / "kept")
    assert [r["z"] for r in spark.read.parquet(str(folder / "kept")).collect()] == [2.0]


def test_a_root_is_worked_off_and_finished_outputs_are_skipped(spark, folder):
    (folder / "in" / "deep").mkdir(parents=True)
    for name in ("in/a.yml", "in/deep/b.yml", "in/bad_c.yml"):
        (folder / name).write_text((folder / "c.yml").read_text())
    words = ("filter", "--root", folder / "in", "--suffix", ".yml", "--exclude", "bad*", "--output-root", folder / "out", "--filter", "r_xy>2")
    command(spark, *words)
    made = sorted(str(p.relative_to(folder / "out")) for p in (folder / "out").rglob("*.parquet") if p.is_dir())
    assert made == ["a.parquet", "deep/b.parquet"]
    assert cli.jobs(spark, cli.parser().parse_args([str(w) for w in words])) == []
    with pytest.raises(ValueError, match="--root"):
        command(spark, "filter", "--filter", "r_xy>2")


def summarize(spark, folder, regions, **kwargs):
    cells = spark.createDataFrame(list(enumerate(regions)), "cell_ord long, region_id int")
    return api.summarize_regions(cells=cells, outline=files.read_outline(spark, str(folder / "outline.csv")), volumes=files.read_volumes(spark, str(folder / "volumes.csv")), **kwargs)


def test_null_and_unknown_regions_raise(spark, folder):
    assert {r["region_id"]: r["n_cells"] for r in summarize(spark, folder, [11, 12, 0, 10]).collect()}[1] == 3
    for bad in (None, 404):
        with pytest.raises(Exception, match="Region is"):
            summarize(spark, folder, [11, bad])


def test_a_root_that_misses_cells_raises(spark, folder, monkeypatch):
    from stratavox.operators import regions

    right = regions.leaf_counts
    monkeypatch.setattr(regions, "leaf_counts", lambda placed, keys=None: right(placed, keys).filter("region_id <> 12"))
    with pytest.raises(ValueError, match="roots count 1 cells, but 2"):
        summarize(spark, folder, [11, 12])


def test_unknown_members_and_regions_raise(spark, folder):
    merge = spark.createDataFrame([(5, "G", "group", [11, 404], 0)], "id int, abbreviation string, description string, member_ids array<int>, loaded_at long")
    with pytest.raises(ValueError, match="unknown members: .404"):
        summarize(spark, folder, [11], merge_tree=merge)
    (folder / "meta.csv").write_text("Image_name,Condition\ns1,Ctl\n")
    (folder / "s1_561_x.csv").write_text("ID,Abbreviation,Total cells\r\n1,root,5\r\n")
    run = dict(
        spark=spark, metadata_path=str(folder / "meta.csv"), lookup_column="Image_name", factors=["Condition"], summaries_root=str(folder), channels=[561], pattern="{name}_{channel}_*.csv",
        outline=files.read_outline(spark, str(folder / "outline.csv")), stat_column="total cells",
    )
    for name in ("include_regions", "exclude_regions"):
        with pytest.raises(ValueError, match="Unknown regions.*999"):
            api.analyze_summaries(**run, **{name: [999]})


def test_limits_of_files_are_checked_before_reading(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "DICTIONARY_LINES", 3)
    with pytest.raises(ValueError, match="at most 3"):
        files.read_outline(spark, str(folder / "outline.csv"))
    monkeypatch.setattr(sinks, "ONE_FILE_ROWS", 3)
    with pytest.raises(ValueError, match="More than 3"):
        sinks.write_csv(spark.range(5).toDF("a"), str(folder / "x.csv"))

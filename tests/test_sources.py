"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from nightframe.sources import catalogs, documents, outputs

FULL = """ ID ,hip,proper,ra,dec,mag,rarad,decrad,con,pmrarad,pmdecrad
0,,Sun,0,0,-26.7,0,0,,,
1,11, Vega ,6.0,-10,1.0,,,Lyr,0.5,
2,,,1,1,5.0,1.0,0.5,,,
3,x,,bad,1,2.0,,,,,
4,,,1,1,,,,,,
5,,,1,1,2.0,1.0,,,,
"""


@pytest.mark.parametrize("name", ["stars.csv", "stars.csv.gz"])
def test_star_catalog(spark, tmp_path, name):
    path = tmp_path / name
    (gzip.open(path, "wt") if name.endswith("gz") else open(path, "w")).write(FULL)
    got = {r.star_id: r for r in catalogs.star_catalog(spark, str(path)).collect()}
    assert sorted(got) == [1, 2, 5]
    assert (got[1].ra_deg, got[1].dec_deg, got[1].proper, got[1].hip, got[1].con, got[1].pm_ra, got[1].pm_dec) == (90.0, -10.0, "Vega", 11, "Lyr", 0.5, 0.0)
    assert abs(got[2].ra_deg - 57.2957795) < 1e-6 and abs(got[2].dec_deg - 28.6478898) < 1e-6
    assert got[5].ra_deg == 15.0
    assert {r.ra_deg for r in catalogs.star_catalog(spark, str(path), "degrees").where("star_id = 1").collect()} == {6.0}


def test_bad_catalogs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ra,dec\n1,2,3\n")
    with pytest.raises(ValueError, match="mag"):
        catalogs.star_catalog(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("id,ra,dec,mag\nx,2,3,4\n")
    with pytest.raises(Exception, match="bad id"):
        catalogs.star_catalog(spark, str(tmp_path / "b.csv")).collect()


def test_simple_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿star_id,ra_deg,dec_deg,mag_v\nsirius,101.287,-16.716,-1.46\n,1,2,3\nvega,279.234,38.783,0.03\n")
    assert sorted(map(tuple, catalogs.simple_catalog(spark, str(tmp_path / "a.csv")).collect())) == [("sirius", 101.287, -16.716, -1.46), ("vega", 279.234, 38.783, 0.03)]
    (tmp_path / "b.csv").write_text("id,ra,dec,mag\na,1,2,bright\n")
    with pytest.raises(Exception, match="bad mag"):
        catalogs.simple_catalog(spark, str(tmp_path / "b.csv")).collect()


def test_constellations(spark, tmp_path):
    shape = lambda i, *lines: {"id": i, "geometry": {"type": "MultiLineString", "coordinates": list(lines)}}
    (tmp_path / "l.json").write_text(json.dumps({"features": [shape("Ser", [[-10, 5], [20, 6]], [[1, 1]]), shape("Ser", [[0, 0], [1, 1], [2, 2]])]}))
    got = documents.constellation_lines(spark, str(tmp_path / "l.json")).collect()
    assert len(got) == 5 and {r.feature for r in got} == {0, 1} and got[0].ra == 350.0
    (tmp_path / "n.json").write_text(json.dumps({"features": [{"id": "Ser", "properties": {"name": "Serpens"}}, {"id": "Ori", "properties": {}}]}))
    assert sorted(map(tuple, documents.constellation_names(spark, str(tmp_path / "n.json")).collect())) == [("Ori", "Ori"), ("Ser", "Serpens")]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"id": "X", "geometry": {"type": "Point", "coordinates": []}}]}))
    with pytest.raises(Exception, match="MultiLineString"):
        documents.constellation_lines(spark, str(tmp_path / "p.json")).collect()


def test_manifest_and_solutions(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "file": "a.png", "track": "solver", "unknown": 1}, {"id": "b", "file": "b.png", "track": "scene", "width": 5}]))
    assert [(r.id, r.track, r.width) for r in documents.manifest(spark, str(tmp_path / "m.json")).orderBy("id").collect()] == [("a", "solver", None), ("b", "scene", 5)]
    folder = tmp_path / "wcs"
    folder.mkdir()
    good = {"ra": 1.0, "dec": 2.0, "pixscale": 3.0, "orientation": 4.0, "parity": 1.0}
    for name, x in {"bare": good, "wrapped": {"calibration": good}, "null": {"calibration": None}, "flat": {**good, "pixscale": 0.0}, "part": {"pixscale": 2.0}}.items():
        (folder / f"{name}.json").write_text(json.dumps(x))
    got = {r.file.rpartition("/")[2][:-5]: r for r in documents.plate_solutions(spark, str(folder)).collect()}
    assert {k: r.error for k, r in got.items()} == {"bare": None, "wrapped": None, "null": "calibration is null", "flat": "bad pixscale", "part": "bad ra, dec or orientation"}
    assert got["bare"].ra == got["wrapped"].ra == 1.0


def test_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"schema":1,"ts":"t","outcome":"solved","result":{"fov_x_deg":20.5}}\n\n{bad\n{"outcome":"failed","more":1}\n')
    assert sorted((r.outcome, r.result.fov_x_deg if r.result else None) for r in documents.solve_log(spark, str(tmp_path / "log.jsonl")).collect()) == [("failed", None), ("solved", 20.5)]


def test_truth_round_trip_and_digests(spark, tmp_path):
    stars = spark.createDataFrame([(1, 10.0, 20.0, 3.5, 1.25, 2.5), (2, 11.0, 21.0, 4.5, 3.0, 4.0)], "star_id long, ra_deg double, dec_deg double, mag double, x double, y double")
    outputs.write_truth(stars.coalesce(1), str(tmp_path / "truth"))
    assert sorted(map(tuple, documents.truth_table(spark, str(tmp_path / "truth")).collect())) == [("1", 1.25, 2.5), ("2", 3.0, 4.0)]
    outputs.write_reports(stars.withColumnRenamed("star_id", "id").withColumn("none", F.lit(None).cast("int")), str(tmp_path / "reports"))
    text = spark.read.text(str(tmp_path / "reports")).collect()
    assert len(text) == 2 and all("none" not in r.value for r in text)
    for where in ("one/run", "two/run", "other/run"):
        (tmp_path / where).mkdir(parents=True)
        (tmp_path / where / "a.txt").write_text("x")
        (tmp_path / where / "b.txt").write_text("y" if where != "other/run" else "z")
    digest = lambda p: outputs.folder_digest(spark, str(tmp_path / p)).first().digest
    assert digest("one/run") == digest("two/run") != digest("other/run")


def test_images(spark, tmp_path):
    for name in ("a.PNG", "b.tif", "c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert sorted((r.path.rpartition("/")[2], r.length) for r in documents.images(spark, str(tmp_path)).collect()) == [("a.PNG", 3), ("b.tif", 3)]
    assert [r.path.rpartition("/")[2] for r in documents.images(spark, str(tmp_path)).collect()] == ["a.PNG", "b.tif"]
    assert [r.length for r in documents.images(spark, str(tmp_path / "b.tif")).collect()] == [3]


def test_calibration_of_the_outermost_object_counts(spark, tmp_path):
    good = '{"ra": 1, "dec": 2, "pixscale": 3, "orientation": 4, "parity": 1'
    texts = {"bare": good + ', "other": {"calibration": null}}', "text": good + ', "note": "\\"calibration\\": null"}', "null": '{"calibration": null, "other": {"calibration": 1}}', "empty": "{}", "no": "[broken"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file.rpartition("/")[2][:-5]: r.error for r in documents.plate_solutions(spark, str(tmp_path)).collect()}
    assert got == {"bare": None, "text": None, "null": "calibration is null", "empty": "bad pixscale", "no": "bad pixscale"}


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.bin", bytes([i]) * i) for i in range(20)] + [(None, b"1"), ("x", None)], "name string, content binary").repartition(3)
    for _ in range(2):  # again, as a task that is run again
        assert outputs.write_files(rows, str(tmp_path / "c")) == 20
    assert {p.name: p.read_bytes() for p in (tmp_path / "c").iterdir()} == {f"{i}.bin": bytes([i]) * i for i in range(20)}
    assert outputs.write_files(rows.limit(0), str(tmp_path / "d")) == 0 and list((tmp_path / "d").iterdir()) == []


def test_plate_solutions_are_packed(spark, tmp_path, monkeypatch):
    """Each frame's document is a line of its own; files do not grow in number with frames."""
    from nightframe.plans import files, library

    monkeypatch.setattr(files, "folder", lambda t: str(tmp_path / "out"))
    spark.range(1, 401).select(F.col("id").alias("s_suppkey")).coalesce(4).write.parquet(f"{tmp_path}/supplier.parquet")
    got = library.queries()["s15_plate_solutions"](spark, str(tmp_path)).collect()
    assert len(got) == 400 and sum(r.error is None for r in got) == 200
    assert {r.frame_id for r in got} == {k for k in range(1, 401) if k % 4 != 2} | {None}
    assert len(list((tmp_path / "out").glob("part-*"))) <= 8

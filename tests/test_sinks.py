"""The log sink: each batch once, whatever comes again; batches that cannot be written."""

import json

from nightframe.streaming import log


def feed(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_a_batch_is_there_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    feed(source, "a", [{"id": 1, "cam": 1, "outcome": "solved", "fov": 20.0}, {"id": 2, "cam": 1, "outcome": "failed"}])
    run = lambda: log.append_log(log.log_stream(spark, str(source)), out, str(state))
    query, warnings = run()
    query.awaitTermination()
    feed(source, "b", [{"id": 3, "cam": 2, "outcome": "solved", "fov": 30.0}])
    query, _ = run()
    query.awaitTermination()
    assert sorted(r.id for r in log.read_log(spark, out).collect()) == [1, 2, 3] and not warnings
    # as after a crash between writing the rows and noting that it was done
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    query, warnings = run()
    query.awaitTermination()
    assert sorted(r.id for r in log.read_log(spark, out).collect()) == [1, 2, 3] and not warnings
    lines = [line for p in (tmp_path / "out").rglob("*.json") for line in p.read_text().splitlines()]
    assert any("fov" not in json.loads(line) for line in lines)


def test_a_batch_that_fails_is_told_of_once(spark, tmp_path):
    source, blocked = tmp_path / "in", tmp_path / "file"
    blocked.write_text("no folder")
    for i in range(3):
        feed(source, f"f{i}", [{"id": i}])
    query, warnings = log.append_log(log.log_stream(spark, str(source), files=1), str(blocked / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert query.exception() is None and len(warnings) == 1 and "batch 0" in warnings[0]


def test_a_run_folder_and_its_gate(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from nightframe.sources import outputs

    rows = [(i, "solved" if i % 3 else "failed", None if i % 3 else f"code_{i % 2}", float(i) if i % 3 else None) for i in range(30)] + [(30, "missing_image", None, None)]
    reports = spark.createDataFrame(rows, "id long, status string, code string, axis double")
    path = str(tmp_path / "run")
    outputs.write_run(reports, path, single=True)
    s = outputs.read_summary(spark, path).first()
    assert (s.n, s.attempted, s.solved, s.failures) == (31, 30, 20, {"code_0": 5, "code_1": 5}) and abs(s.solve_rate - 2 / 3) < 1e-12
    assert sorted(p.name for p in (tmp_path / "run" / "worst-cases").glob("case=*"))[:2] == ["case=01_29", "case=02_28"]
    assert len(list((tmp_path / "run" / "per-frame").glob("_key=*"))) == 31
    better, none = reports.withColumn("axis", F.col("axis") * 0.5), reports.where("status = 'missing_image'")
    gate = lambda now, old: outputs.gate(outputs.run_summary(now), outputs.run_summary(old)).first()
    assert gate(better, reports).passes and gate(reports, better).worse == ["error_p95"] and gate(reports, none).passes
    assert gate(reports.withColumn("status", F.when(F.col("id") < 9, "failed").otherwise(F.col("status"))), reports).worse == ["solve_rate"]

    # a run that is killed before its end has no summary
    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(outputs, "run_summary", killed)
    cut = str(tmp_path / "cut")
    try:
        outputs.write_run(reports, cut)
    except KeyboardInterrupt:
        pass
    try:
        outputs.read_summary(spark, cut)
        raise AssertionError("read a run that was not finished")
    except FileNotFoundError:
        assert isinstance(spark.read.json(f"{cut}/per-frame"), DataFrame)

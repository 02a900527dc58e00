"""Readers, writers, settings, commands and the stream."""

import csv
import datetime as dt
import json
import zipfile

import pytest

from barleaf import cli
from barleaf import config as settings
from barleaf.errors import FrozenDatasetError, IngestError, SchemaError, StageError
from barleaf.operators import flags
from barleaf.sources import bars, synthetic
from barleaf.sources import tables as t
from barleaf.streaming import daily

HEADER = list(bars.RAW)


def write_csv(path, rows, header=HEADER):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


# --- zip and CSV


def test_zip_members(tmp_path):
    z, target = tmp_path / "d.zip", tmp_path / "bars.csv"
    with pytest.raises(IngestError):
        bars.extract_csv(str(z), str(target))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/other.csv", "x")
        f.writestr("in/two.csv", "y")
    with pytest.raises(IngestError):
        bars.extract_csv(str(z), str(target))
    with zipfile.ZipFile(z, "a") as f:
        f.writestr("in/bars.csv", "named")
    bars.extract_csv(str(z), str(target))
    assert target.read_text() == "named" and not list(tmp_path.glob("*.part"))
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("sole.csv", "sole")
    bars.extract_csv(str(z), str(target))
    assert target.read_text() == "named"  # what is there stays
    target.unlink()
    bars.extract_csv(str(z), str(target))
    assert target.read_text() == "sole"


def test_csv_is_read_with_types_and_no_row_lost(spark, tmp_path):
    rows = synthetic.clean_rows(days=5)
    write_csv(tmp_path / "a.csv", rows)
    got = bars.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == list(flags.BRONZE) and sorted(map(tuple, got.collect())) == sorted(rows)
    write_csv(tmp_path / "b.csv", rows, [*HEADER[:-1], "Vol"])
    with pytest.raises(SchemaError):
        bars.read_csv(spark, str(tmp_path / "b.csv"))
    write_csv(tmp_path / "c.csv", [("A", "2020-01-06", "x", 1, 1, 1, 1, 1)])
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        bars.read_csv(spark, str(tmp_path / "c.csv")).collect()


def test_nan_becomes_null_once(spark, tmp_path):
    rows = [("A", dt.datetime(2020, 1, 6), float("nan"), float("inf"), 1.0, 1.0, 1.0, 3)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp, open double, high double, low double, close double, adj_close double, volume long")
    df.write.parquet(str(tmp_path / "p"))
    (r,) = bars.read_parquet(spark, str(tmp_path / "p")).collect()
    assert r.open is None and r.high is None and r.date == dt.date(2020, 1, 6)
    with pytest.raises(SchemaError):
        bars.read_parquet(spark, str(tmp_path / "p2")) if (df.drop("low").write.parquet(str(tmp_path / "p2")) or True) else None


# --- tables


def test_tables_are_sorted_and_checked(spark, tmp_path):
    df = synthetic.clean_bars(spark)
    t.write_table(df, path := str(tmp_path / "v/bronze"))
    assert t.read_table(spark, path, flags.BRONZE, StageError, "ingest").count() == df.count()
    with pytest.raises(StageError, match="run `ingest`"):
        t.read_table(spark, path, ("ticker",), StageError, "ingest")
    with pytest.raises(StageError, match="run `ingest`"):
        t.read_table(spark, str(tmp_path / "none"), None, StageError, "ingest")


def test_registry_and_hashes(tmp_path):
    path = str(tmp_path / "r.csv")
    row = dict.fromkeys(t.REGISTRY, "1")
    t.append_registry(row, path)
    t.append_registry(row, path)
    lines = open(path).read().splitlines()
    assert len(lines) == 3 and lines[0] == ",".join(t.REGISTRY)
    with pytest.raises(ValueError):
        t.append_registry({"run_id": 1}, path)
    assert t.sha256_json({"b": 1, "a": 2}) == t.sha256_json({"a": 2, "b": 1}) and len(t.sha256_file(path)) == 64
    assert t.new_run_id("x", dt.datetime(2020, 1, 2)).startswith("20200102T000000-x-") and len(t.git_commit()) >= 7
    assert t.markdown_table(["a"], [["x|y"]]).endswith("| x\\|y |")


# --- settings


def test_settings():
    base = settings.Config()
    over = settings.with_overrides(base, ["labels.horizons=[5, 20]", "universe.drop_stitched=true", "universe.min_close=4", "project.variant=x", "validation.train_window_days=null"])
    assert over.labels.horizons == (5, 20) and over.universe.drop_stitched and over.universe.min_close == 4.0 and over.project.variant == "x"
    assert settings.fingerprint(base) == settings.fingerprint(settings.Config()) != settings.fingerprint(over)
    for bad in ("labels.none=1", "nothing.x=1", "labels", "universe.drop_stitched=3"):
        with pytest.raises(StageError):
            settings.with_overrides(base, [bad])


def test_settings_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"validation": {"locked_test_start": "2019-01-02"}, "labels": {"winsor_pct": [0.05, 0.95]}}))
    got = settings.load(str(tmp_path / "c.json"), ["labels.min_names=3"])
    assert got.validation.locked_test_start == dt.date(2019, 1, 2) and got.labels.winsor_pct == (0.05, 0.95) and got.labels.min_names == 3


# --- commands


def test_commands_in_order(spark, tmp_path, capsys):
    root = tmp_path / "run"
    (root / "raw").mkdir(parents=True)
    write_csv(root / "raw/bars.csv", synthetic.clean_rows(("AAA", "BBB", "CCC"), 90, seed=2))
    (root / "reference").mkdir()
    (root / "reference/curated.csv").write_text("ticker,issuer_id,share_class,exclusion_reason,stitching_suspect,notes\nBBB,,,by hand,false,\n")
    run = lambda *a: cli.main(["--root", str(root), "--override", "universe.seasoning_days=5", "--override", "universe.min_median_dollar_volume_63=1", "--override", "labels.min_names=2", *a])
    assert run("build-universe") == 1 and "run `validate`" in capsys.readouterr().err
    for command in ("ingest", "validate", "build-master", "build-universe", "build-adjusted", "build-labels", "build-features", "status"):
        assert run(command) == 0, command
    assert "missing" not in capsys.readouterr().out
    assert run("ingest") == 0  # the same data again
    names = ("bronze", "silver", "universe", "adjusted", "labels", "features_raw", "features_model")
    counts = {n: spark.read.parquet(t.table_path(str(root / "processed"), "base", n)).count() for n in names}
    assert set(counts.values()) == {270}
    master = t.read_master(spark, str(root / "reference/security_master.csv"))
    assert {r.ticker: r.status_reason for r in master.collect()} == {"AAA": "", "BBB": "curated: by hand", "CCC": ""}
    assert "AAA,AAA,,,false,,2020-01-06" in (root / "reference/security_master.csv").read_text()
    report = (root / "reports/data_quality.md").read_text()
    assert "| no_gaps | hard | passed | 0 |" in report
    write_csv(root / "raw/bars.csv", synthetic.clean_rows(("AAA",), 90))
    with pytest.raises(FrozenDatasetError):
        t.check_frozen(t.read_manifest(str(root / "manifest.json")), t.sha256_file(str(root / "raw/bars.csv")))
    assert run("ingest") == 1 and counts["bronze"] == spark.read.parquet(t.table_path(str(root / "processed"), "base", "bronze")).count()


def test_failed_checks_write_a_report_and_no_silver(tmp_path):
    root = tmp_path / "bad"
    (root / "raw").mkdir(parents=True)
    rows = synthetic.clean_rows(("AAA",), 20)
    rows[3] = (*rows[3][:2], 1.0, 0.1, *rows[3][4:])
    write_csv(root / "raw/bars.csv", rows)
    assert cli.main(["--root", str(root), "ingest"]) == 0
    assert cli.main(["--root", str(root), "validate"]) == 1
    assert "FAILED" in (root / "reports/data_quality.md").read_text() and not (root / "processed/base/silver").exists()


# --- stream


def test_stream_equals_batch(spark, tmp_path):
    rows = synthetic.toy_rows(4, 40)
    dates = sorted({r[1] for r in rows})
    landing = tmp_path / "in"
    for i in range(0, 40, 10):
        part = [r for r in rows if r[1] in dates[i : i + 10]]
        spark.createDataFrame(part, synthetic.BRONZE).coalesce(1).write.mode("append").parquet(str(landing))
    root = str(tmp_path / "bars")
    run = lambda: daily.start(spark, str(landing), root, str(tmp_path / "cp")).awaitTermination(120)
    run()
    want = sorted(map(tuple, flags.add_flags(spark.createDataFrame(rows, synthetic.BRONZE)).collect()))
    assert sorted(map(tuple, daily.silver(spark, root).collect())) == want
    # a late row is set aside, what was written stays
    late = spark.createDataFrame([(*rows[0][:2], 9.0, 9.0, 9.0, 9.0, 9.0, 1)], synthetic.BRONZE)
    late.coalesce(1).write.mode("append").parquet(str(landing))
    run()
    assert daily.silver(spark, root).count() == len(rows) and daily.rejected(spark, root).count() == 1
    # a batch that is tried again changes nothing
    daily.append_batch(spark, late, 4, root)
    assert sorted(map(tuple, daily.silver(spark, root).collect())) == want and daily.rejected(spark, root).count() == 1


def test_a_batch_tried_again_and_other_faults(spark, tmp_path):
    rows, root = synthetic.toy_rows(3, 30), str(tmp_path / "bars")
    dates = sorted({r[1] for r in rows})
    parts = [spark.createDataFrame([r for r in rows if r[1] in dates[i : i + 10]], synthetic.BRONZE) for i in (0, 10, 20)]
    for i in (0, 0, 1, 2, 2):
        daily.append_batch(spark, parts[i], i, root)
    want = flags.add_flags(spark.createDataFrame(rows, synthetic.BRONZE))
    assert sorted(map(tuple, daily.silver(spark, root).collect())) == sorted(map(tuple, want.collect())) and daily.rejected(spark, root).count() == 0
    with pytest.raises(StageError):
        daily.append_batch(spark, parts[0], 9, root)  # the batch before is missing
    with pytest.raises(StageError):
        daily.append_batch(spark, parts[0], 0, root)  # another checkpoint
    # a table that is there but can't be read is no fresh start
    broken = tmp_path / "broken" / "last" / "batch=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("no Parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        daily.append_batch(spark, parts[1], 1, str(tmp_path / "broken"))

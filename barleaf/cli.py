"""Commands of the batch pipeline: each reads tables of the stage before and writes its own.

    python -m barleaf.cli [--config FILE] [--override section.key=value]... --root DIR COMMAND

A stage error is printed and gives exit code 1.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from barleaf import config as settings
from barleaf.errors import AdjustError, FeatureError, LabelError, LeakageError, LockedTestError, SecurityMasterError, StageError, UniverseError, ValidationError
from barleaf.operators import adjust, calendar, checks, flags, folds, labels, leakage, master, universe
from barleaf.operators.calendar import TradingCalendar
from barleaf.operators.features.build import build_features
from barleaf.sources import bars
from barleaf.sources import tables as t


#: Types that columns of stage tables have wherever they occur.
STAGE_TYPES = checks.TYPES | {c: "double" for c in ("adj_factor", "adj_open", "adj_high", "adj_low", "dollar_volume", "logret_cc", "median_dollar_volume_63")} | {"t_idx": "int", "n_obs": "int", "year": "int", "is_month_first_day": "boolean", "eligible": "boolean"} | {c: "boolean" for c in (*flags.FLAGS, *universe.FAILS)}

log = logging.getLogger("barleaf")


@contextmanager
def logging_to(path: str | None) -> Iterator[None]:
    """Messages of the command on the error stream and, if asked for, in a file."""
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        for h in handlers:
            log.removeHandler(h)
            h.close()


class Run:
    """Paths and readers of one root folder and variant."""

    def __init__(self, args: argparse.Namespace):
        self.args, self.root = args, Path(args.root)
        self.config = settings.load(args.config, args.override)
        self._spark: SparkSession | None = None

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName("barleaf").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return self._spark

    def path(self, name: str) -> str:
        return t.table_path(str(self.root / "processed"), self.config.project.variant, name)

    def file(self, name: str) -> str:
        return str(self.root / name)

    def read(self, name: str, columns: tuple[str, ...] | None, error: type[StageError], command: str):
        """A stage's table with these columns; those whose type is fixed must have it."""
        return t.read_table(self.spark, self.path(name), columns, error, command, {c: STAGE_TYPES[c] for c in columns or () if c in STAGE_TYPES})

    def calendar(self):
        return self.read("calendar", ("date", "t_idx", "year", "is_month_first_day"), StageError, "ingest")

    def silver(self, error: type[StageError]):
        return self.read("silver", flags.SILVER, error, "validate")


def status(run: Run) -> int:
    names = ("bronze", "calendar", "silver", "universe", "adjusted", "labels", "market_series", "features_raw", "features_model")
    for name in names:
        print(f"{name:15} {'present' if Path(run.path(name)).exists() else 'missing'}")
    print(f"config {settings.fingerprint(run.config)[:12]} variant {run.config.project.variant}")
    return 0


def ingest(run: Run) -> int:
    """Raw CSV (from a zip if need be) to bronze, calendar and manifest; other data than the first time is refused."""
    csv = run.args.csv or run.file("raw/bars.csv")
    if run.args.zip:
        bars.extract_csv(run.args.zip, csv)
    if not Path(csv).exists():
        raise StageError(f"{csv} does not exist")
    digest = t.sha256_file(csv)
    t.check_frozen(t.read_manifest(run.file("manifest.json")), digest)
    bronze = bars.read_csv(run.spark, csv)
    t.write_table(bronze, run.path("bronze"))
    bronze = run.spark.read.parquet(run.path("bronze"))
    t.write_table(calendar.build_calendar(bronze), run.path("calendar"), ("date",))
    print(t.write_manifest(bronze, csv, digest, run.file("manifest.json")))
    return 0


def validate(run: Run) -> int:
    """Hard checks, then silver and the report; with a failed check only the report is written."""
    bronze, cal = run.read("bronze", flags.BRONZE, StageError, "ingest"), run.calendar()
    results = checks.hard_checks(bronze, cal)
    totals, survivors = checks.dataset_counts(bronze).first().asDict(), checks.survivorship(bronze)
    if failed := [r["name"] for r in results if r["severity"] == "hard" and not r["passed"]]:
        log.error("hard checks failed: %s", ", ".join(failed))
    else:
        results += checks.soft_checks(bronze, cal, run.config.flags, checks.expectations(run.args.expect))
        silver = flags.add_flags(bronze, run.config.flags)
        totals |= checks.flag_totals(silver).first().asDict()
        t.write_table(silver, run.path("silver"))
        events = flags.corp_action_events(run.silver(ValidationError)).orderBy("date", "ticker")
        t.write_csv(events, run.file("reports/corp_action_events.csv"))
    for r in results:
        if r["severity"] == "soft" and not r["passed"]:
            log.warning("%s: %s", r["name"], r["message"])
    t.write_text(t.render_report(results, totals, survivors), run.file("reports/data_quality.md"))
    t.write_text(json.dumps({"checks": results, "totals": totals, "survivorship": survivors, "config": settings.fingerprint(run.config)}, indent=2, default=str) + "\n", run.file("reports/data_quality.json"))
    checks.assert_passed(results)
    return 0


def build_master(run: Run) -> int:
    curated = run.file("reference/curated.csv")
    rows = t.read_text_csv(run.spark, curated) if Path(curated).exists() else None
    made = master.build_master(run.silver(SecurityMasterError), rows, run.config.flags.max_zero_volume_share_ticker)
    Path(run.file("reference")).mkdir(exist_ok=True)
    t.write_master(made, run.file("reference/security_master.csv"))
    return 0


def build_universe(run: Run) -> int:
    made = universe.build_universe(run.silver(UniverseError), t.read_master(run.spark, run.file("reference/security_master.csv")), run.config.universe)
    t.write_table(made, run.path("universe"))
    print(universe.summary(run.spark.read.parquet(run.path("universe"))).first())
    return 0


def build_adjusted(run: Run) -> int:
    made = adjust.build_adjusted(run.silver(AdjustError), run.calendar())
    t.write_table(made, run.path("adjusted"))
    for r in adjust.last_factors(run.spark.read.parquet(run.path("adjusted"))).where("not is_one").collect():
        log.warning("last factor of %s is %s", r.ticker, r.last_factor)
    return 0


def build_labels(run: Run) -> int:
    adjusted = run.read("adjusted", adjust.ADJUSTED, LabelError, "build-adjusted")
    uni = run.read("universe", universe.UNIVERSE, LabelError, "build-universe")
    t.write_table(labels.build_labels(adjusted, uni, run.calendar(), run.config.labels), run.path("labels"))
    return 0


def build_feature_tables(run: Run) -> int:
    adjusted = run.read("adjusted", adjust.ADJUSTED, FeatureError, "build-adjusted")
    uni = run.read("universe", universe.UNIVERSE, FeatureError, "build-universe")
    made = build_features(adjusted, uni, run.config.features)
    t.write_table(made.market_series, run.path("market_series"), ("date",))
    t.write_table(made.raw, run.path("features_raw"))
    t.write_table(made.model, run.path("features_model"))
    return 0


def fold_plan(run: Run) -> int:
    folds.write_plan(run.config, TradingCalendar.of(run.calendar()), run.file("fold_plan.json"))
    return 0


def check_leakage(run: Run) -> int:
    return leakage.run_leakage_suite()


COMMANDS: dict[str, Callable[[Run], int]] = {
    "status": status, "ingest": ingest, "validate": validate, "build-master": build_master, "build-universe": build_universe, "build-adjusted": build_adjusted,
    "build-labels": build_labels, "build-features": build_feature_tables, "fold-plan": fold_plan, "check-leakage": check_leakage,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="barleaf", description=__doc__.split("\n")[0])
    out.add_argument("--config")
    out.add_argument("--override", action="append", default=[])
    out.add_argument("--root", default=".")
    out.add_argument("--csv")
    out.add_argument("--zip")
    out.add_argument("--expect", help="expected values: JSON text, or a JSON or YAML file")
    out.add_argument("--log", help="a file that messages go to as well")
    out.add_argument("command", choices=sorted(COMMANDS))
    return out


def main(argv: list[str] | None = None) -> int:
    try:
        run = Run(parser().parse_args(argv))
        with logging_to(run.args.log):
            return COMMANDS[run.args.command](run)
    except (StageError, LockedTestError, LeakageError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

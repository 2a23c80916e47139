"""Command line: run, calibrate, inspect, centroid-test, verify, validate, repair, rewrite."""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spectrasieve import model, shared
from spectrasieve.functions import peaks
from spectrasieve.operators import calibrate, centroid, repair, report, verify
from spectrasieve.sources import mzml, mzml_sink


def session(threads: int | None = None) -> SparkSession:
    """A session; ``threads`` bounds those of a local one (on a cluster the cluster's settings do)."""
    made = SparkSession.builder.appName("spectrasieve").config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return (made.master(f"local[{threads}]") if threads else made).getOrCreate()


def run(spark: SparkSession, config: model.Config) -> list[str]:
    """Centroid all input files as one job, each by its own calibration, write them back and verify them; the files written, in order of the input."""
    files = mzml.files_of(list(config.input))
    cal = calibrate.calibrate_files(mzml.first(spark, files, config.n_calibration_spectra), config)
    found = centroid.centroid_files(mzml.read(spark, files), cal, config, ("file", "scan_number", "start"))
    if config.stats_output:  # the kernel runs once for the documents and the statistics
        found.write.parquet(at := f"{shared.folder(spark)}/centroids-{uuid.uuid4().hex}")
        found = spark.read.parquet(at)
        found.select("file", "scan_number", "stats.*").orderBy("file", "scan_number").write.mode("append").option("header", True).option("sep", "\t").csv(config.stats_output)
    of = {r.file: r.target for r in mzml_sink.write_centroided(found, config.output, config.keep_empty, files=files).collect()}
    return [of[f] for f in files]


def show_calibration(spark: SparkSession, path: str, n: int) -> dict:
    got = calibrate.calibrate(mzml.first(spark, path, n), model.Config(n_calibration_spectra=n))
    for level in (1, 2):
        s, h = got[f"sigma_ms{level}"], got[f"grid_spacing_ms{level}"]
        g = peaks.gram_row(s, h)
        rate = min(model.SCAN_RATES, key=lambda r: abs(r[4] - s))[0]
        print(f"MS{level}: sigma {s:.4f}, FWHM {2.355 * s:.4f}, spacing {h:.6f}, {s / h:.2f} points a sigma, neighbour correlation {g[1] / g[0]:.4f}, band {len(g)}, nearest rate {rate:.0f} kTh/s, n {got[f'n_peaks_ms{level}']}")
    return got


def inspect(spark: SparkSession, path: str, n: int) -> dict:
    rows = mzml.read(spark, path, mode="any", max_spectra=n).withColumn("spectrum_id", F.col("scan_number"))
    got = report.inspect(rows)
    got.orderBy("spectrum_id").show(5)
    one = report.summary(got).first().asDict() | {"mode": "centroid" if rows.where("mode = 'centroid'").head(1) else "profile"}
    print(one)
    return one


def centroid_test(spark: SparkSession, path: str, n: int, n_cal: int, config: model.Config) -> dict:
    cal = calibrate.calibrate(mzml.first(spark, path, n_cal), config)
    began = time.perf_counter()
    done = centroid.centroid(mzml.first(spark, path, n), config, (cal["sigma_ms1"], cal["sigma_ms2"]), (cal["grid_spacing_ms1"], cal["grid_spacing_ms2"]), ("scan_number",))
    rows = done.select("scan_number", "stats.*").orderBy("scan_number").collect()
    seconds = time.perf_counter() - began
    for i, r in enumerate(rows):
        if i < 20 or i % 100 == 0:
            print(r.asDict())
    out = {"spectra": len(rows), "centroids": sum(r.n_centroids for r in rows), "seconds": seconds, "ms_a_spectrum": 1000 * seconds / max(1, len(rows))}
    print(out)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("spectrasieve")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("run")
    r.add_argument("--config")
    r.add_argument("--input", nargs="+")
    for f in fields(model.Config):
        if f.name == "input":
            continue
        kind = next((t for t in (int, float) if t.__name__ in str(f.type)), str)
        name = "--" + f.name.replace("_", "-")
        r.add_argument(name, action=argparse.BooleanOptionalAction, default=None) if "bool" in str(f.type) else r.add_argument(name, type=kind)
    for name, counts in (("calibrate", {"n": 50}), ("inspect", {"n": 200}), ("centroid-test", {"n": 200, "n-cal": 50})):
        c = sub.add_parser(name)
        c.add_argument("path")
        for k, v in counts.items():
            c.add_argument(f"--{k}", type=int, default=v)
        if name == "centroid-test":
            c.add_argument("--lambda-factor", type=float, default=3.0)
    sub.add_parser("verify").add_argument("paths", nargs="+")
    v = sub.add_parser("validate")
    v.add_argument("paths", nargs="+")
    v.add_argument("--level", choices=("minimal", "standard", "strict"), default="standard")
    v.add_argument("--vocabulary", help="an OBO file")
    f = sub.add_parser("repair")
    f.add_argument("path")
    f.add_argument("--source")
    f.add_argument("--drop-empty", action="store_true")
    f.add_argument("--dry-run", action="store_true")
    w = sub.add_parser("rewrite")
    w.add_argument("path")
    w.add_argument("target")
    w.add_argument("--keep-empty", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    command = a.pop("command")
    try:
        if command == "run":
            config = model.Config.load(a.pop("config"), **a)
            began = time.perf_counter()
            written = run(session(config.threads), config)
            if not config.quiet:
                print("\n".join(written))
            if config.verbose:
                print(f"{len(written)} files in {time.perf_counter() - began:.1f} s, {config}", file=sys.stderr)
        elif command == "calibrate":
            show_calibration(session(), a["path"], a["n"])
        elif command == "inspect":
            inspect(session(), a["path"], a["n"])
        elif command == "centroid-test":
            centroid_test(session(), a["path"], a["n"], a["n_cal"], model.Config(lambda_factor=a["lambda_factor"]))
        elif command == "verify":
            rows = verify.verify(session(), a["paths"]).collect()
            for r in rows:
                print(r.file, "ok" if r.ok else f"{r.null_length} null bytes at byte {r.null_offset}")
            return int(not all(r.ok for r in rows))
        elif command == "validate":
            rows = verify.validate(session(), a["paths"], a["level"], a["vocabulary"]).orderBy(F.desc("severity"), "file", "check").collect()
            for r in rows:
                print(("info", "warning", "error")[r.severity], r.file, r.check, r.message, r.location)
            return int(any(r.severity == verify.ERROR for r in rows))
        elif command == "repair":
            print(repair.repair(a["path"], a["source"], a["drop_empty"], a["dry_run"]))
        elif command == "rewrite":
            print(mzml_sink.rewrite_clean(a["path"], os.path.abspath(a["target"]), a["keep_empty"]))
    except model.SieveError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

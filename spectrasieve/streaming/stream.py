"""Centroiding of arriving spectra with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spectrasieve import model
from spectrasieve.functions import peaks
from spectrasieve.operators import calibrate, centroid
from spectrasieve.sources import mzml


def centroid_stream(spectra: DataFrame, config: model.Config, sigma, spacing, keys=("spectrum_id",), **kw) -> DataFrame:
    """A stream of centroids. Every spectrum stands alone, so there is no state and no watermark."""
    return centroid.centroid(spectra, config, sigma, spacing, keys, **kw)


def centroid_all(spark: SparkSession, source: str, target: str, state: str, config: model.Config, sigma, spacing, keys=("spectrum_id",), **kw) -> DataFrame:
    """Centroid all spectra (parquet) that have arrived at ``source`` since the last call; the target table.

    Source and target offsets live in ``state``, so each file is taken once, also after a failure.
    """
    schema = spark.read.parquet(source).schema
    made = centroid_stream(spark.readStream.schema(schema).parquet(source), config, sigma, spacing, keys, **kw)
    drain(made, target, state)
    return centroid.rows(spark.read.parquet(target))


def drain(frame: DataFrame, target: str, state: str) -> None:
    """Write what has arrived on a stream since the last call to a parquet table. Offsets live in ``state``."""
    frame.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def landing(spark: SparkSession, folder: str, target: str, state: str, config: model.Config | None = None, settle: float = 1.0):
    """Start a query over a landing folder of mzML files: the spectra of all that have arrived are one job, each file's by its own calibration.

    A file's spectra are all in one batch. A batch is written to a folder of its number, so one that runs again replaces it.
    """
    config = config or model.Config()

    def batch(spectra: DataFrame, number: int) -> None:
        spectra.persist()
        cal = calibrate.calibrate_files(spectra, config)
        centroid.centroid_files(spectra, cal, config).write.mode("overwrite").parquet(f"{target}/batch={number}")
        spectra.unpersist()

    return mzml.arriving(spark, folder, settle=settle).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


_SPECTRUM = "scan_number long, ms_level int, code double, mz array<double>, intensity array<double>"
CENTROIDED = "file string, scan_number long, sigma double, mz array<double>, intensity array<double>"


class Calibrating(StatefulProcessor):
    """Keeps a file's spectra until as many have arrived as its calibration takes (or, with ``wait_ms``, none for so long), then centroids them and all that follow by it.

    The state of a file is those first spectra, then six numbers.
    """

    def __init__(self, config: model.Config, wait_ms: int | None):
        self.config, self.wait_ms = config, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", _SPECTRUM)
        self.seen = handle.getValueState("seen", "n int")
        self.known = handle.getValueState("known", calibrate.CALIBRATION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = [(int(r.scan_number), int(r.ms_level or 2), None if pd.isna(r.code) else float(r.code), *([] if v is None else np.asarray(v, float).tolist() for v in (r.mz, r.intensity))) for part in rows for r in part.itertuples(index=False)]
        if not arrived:
            return
        if self.known.exists():
            yield self._centroided(key, arrived)
            return
        n = (self.seen.get()[0] if self.seen.exists() else 0) + len(arrived)
        self.first.appendList(arrived)
        self.seen.update((n,))
        for t in list(self.handle.listTimers()) if self.wait_ms is not None else ():
            self.handle.deleteTimer(t)
        if n >= self.config.n_calibration_spectra:
            yield self._settle(key)
        elif self.wait_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.first.exists() and not self.known.exists():
            yield self._settle(key)

    def _settle(self, key) -> pd.DataFrame:
        held = sorted((tuple(r) for r in self.first.get()), key=lambda r: r[0])
        head = held[: self.config.n_calibration_spectra]
        arrays = [[np.asarray(r[i], float) for r in head] for i in (3, 4)]
        self.known.update(tuple(calibrate.of_first([r[1] for r in head], [r[2] for r in head], *arrays, self.config).values()))
        self.first.clear()
        return self._centroided(key, held)

    def _centroided(self, key, spectra) -> pd.DataFrame:
        one, h1, _, two, h2, _ = self.known.get()
        bases = centroid.Basis.of(one, h1, self.config.grid_offset or 0.0), centroid.Basis.of(two, h2, self.config.grid_offset or 0.0)
        got = centroid.centroid_batch([r[1] for r in spectra], *([np.asarray(r[i], float) for r in spectra] for i in (3, 4)), bases, self.config)
        return pd.DataFrame({"file": key[0], "scan_number": [r[0] for r in spectra], "sigma": [one if r[1] == 1 else two for r in spectra], "mz": [np.asarray(g[0], float) for g in got], "intensity": [np.asarray(g[1], float) for g in got]})

    def close(self) -> None:
        pass


def calibrated(spectra: DataFrame, config: model.Config, wait_ms: int | None = None) -> DataFrame:
    """A stream of CENTROIDED rows of a stream of spectra (file, scan_number, ms_level, filter_string, mz, intensity) of many files, whose
    spectra may come in any number of batches, interleaved: each file by the calibration of its own first spectra.

    A file with fewer spectra than a calibration takes waits for more; with ``wait_ms`` it comes when none has followed for so long, which
    needs a query that keeps running. State needs the session's spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    rows = spectra.select("file", F.col("scan_number").cast("long").alias("scan_number"), F.col("ms_level").cast("int").alias("ms_level"), peaks.filter_code_sigma(F.col("filter_string")).alias("code"), F.col("mz"), F.col("intensity").cast("array<double>").alias("intensity"))
    return rows.groupBy("file").transformWithStateInPandas(Calibrating(config, wait_ms), CENTROIDED, "Append", "None" if wait_ms is None else "ProcessingTime")

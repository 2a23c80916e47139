"""Rows that share a key meet: heavy keys dealt over cells, links gathered as forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common


def dealt(postings: DataFrame, keys: list[str], by: str, hot: int) -> DataFrame:
    """``postings`` with a column cell, so that any two rows of a key meet in a cell and no cell has more than about 2 ``hot`` rows.

    A key of more than ``hot`` rows has them dealt into s rows of a triangle by a hash of the column ``by``; those of
    row r go to the cells (r, j) and (j, r). Other keys have the one cell 0.
    """
    heavy = postings.groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > hot)
    heavy = common.cut(heavy.select(*keys, F.ceil(F.col("__c") / hot).cast("int").alias("__s")))
    own = postings.join(common.sized(heavy), keys, "left")
    row = F.pmod(F.xxhash64(by), F.col("__s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("__s") - 1), lambda j: F.least(row, j).cast("long") * F.lit(1 << 32) + F.greatest(row, j))
    return own.withColumn("cell", F.explode(F.when(F.col("__s").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells))).drop("__s")


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values of ``key`` ends (exclusive), for every place."""
    if not len(key):
        return np.zeros(0, np.int64)
    last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return np.repeat(last, np.diff(last, prepend=0))


class Forest:
    """Links among the numbers 0 to n - 1, kept as the least number each one reaches."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each round hooks the greater root of a link on the least root it meets and shortens all paths."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

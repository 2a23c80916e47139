"""URL filters: a bit-parallel wildcard automaton over canonical URLs."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common

SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_globs(rule: str) -> list[str]:
    """A host and path rule as globs over ``.host/path``: its host, any subdomain, any longer path."""
    host, _, path = rule.partition("/")
    return [f"*.{host}/{path}**"]


def host_word_globs(words: list[str]) -> list[str]:
    """Globs for hosts that hold one of the words between dots or hyphens."""
    return [f"*{a}{w}{b}**" for w in words for a in ".-" for b in ".-"]


class Automaton:
    """Multiword Shift-And over all globs at once.

    Each literal byte of a glob is a state. ``**`` (any bytes) and ``*`` (any bytes but /)
    become a self-loop on the state before them, ``?`` a state that any byte but / enters. The
    states of all globs lie side by side in 64-bit words. One byte of a URL advances every
    glob of every URL of a batch with a shift, an or and two ands a word; bit 63
    carries into the next word. A glob fits if its last state is set after the last byte.
    """

    def __init__(self, globs: list[str]):
        states: list[bytes | None] = []  # the byte that enters a state; b"" for start states
        anything, segment, first, last = set(), set(), [], []
        for g in globs:
            first.append(len(states))
            states.append(b"")
            for part in re.findall(rb"\*\*|[\s\S]", g.encode()):
                if part in (b"*", b"**"):
                    (segment if part == b"*" else anything).add(len(states) - 1)
                else:
                    states.append(None if part == b"?" else part)
            last.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.begin = self._mask(first)
        self.last = [(i // 64, np.uint64(i % 64)) for i in last]
        self.stay = np.tile(self._mask(anything | segment), (256, 1))
        self.stay[ord("/")] = self._mask(anything)
        self.enter = np.zeros((256, self.words), np.uint64)
        for i, b in enumerate(states):
            for c in (x for x in range(256) if x != ord("/")) if b is None else b:
                self.enter[c, i // 64] |= np.uint64(1) << np.uint64(i % 64)

    def _mask(self, states) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in states:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """fits[text, glob] of whole texts."""
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")  # so that the texts still running are a prefix
        flat = np.frombuffer(b"".join(texts[i] for i in order) + b"\0", np.uint8)
        size = size[order]
        start = np.cumsum(size) - size
        state = np.tile(self.begin, (n, 1))
        alive = n
        for at in range(int(size[0]) if n else 0):
            while alive and size[alive - 1] <= at:
                alive -= 1
            s = state[:alive]
            moved = s << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            c = flat[start[:alive] + at]
            state[:alive] = (moved & self.enter[c]) | (s & self.stay[c])
        out = np.zeros((n, len(self.last)), bool)
        for g, (w, b) in enumerate(self.last):
            out[order, g] = (state[:, w] >> b & np.uint64(1)).astype(bool)
        return out


def judge(pages: DataFrame, block: list[str], allow: list[str], block_globs: list[str], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: page_id, url, host, path, rule, verdict.

    ``block`` and ``allow`` are rules ``host/path``: a rule fits its host and all
    subdomains where the path starts with the rule's; the longest rule wins, of equally long ones the
    one with the longer host, then a blocking one. Where none fits, the verdict is ``block`` if any of ``block_globs`` fits the canonical URL
    (``.host/path`` with the query after it, fragment cut), else ``default``. Globs: see :class:`Automaton`.

    A null URL, an empty one and one without ``://`` have an empty host and path, fit no rule and get ``default`` unless
    a glob fits the empty text. Null ids stay null, repeated rows are judged alike, other
    columns are ignored. No shuffle; the automaton is built from the rules alone.
    """
    rules = [(r, "block") for r in block] + [(r, "allow") for r in allow]
    if len({r for r, _ in rules}) < len(rules):
        raise ValueError("a rule stands both for block and allow, or twice")
    rules.sort(key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[1] != "block"))
    globs = [g for r, _ in rules for g in rule_globs(r)]

    def task(batches):
        import pyarrow as pa

        rule_machine, glob_machine = Automaton(globs), Automaton(block_globs)
        step = max(16, min(4096, (4 << 20) // max(rule_machine.words, glob_machine.words)))  # states of at most 32 MB
        names = pa.array([r for r, _ in rules] + [None], pa.string())
        verdicts = np.array([v for _, v in rules] + [default], object)
        k = len(rules)
        for b in batches:
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                hosts, paths, tails = (part.column(c).to_pylist() for c in ("host", "path", "tail"))
                texts = [f".{h}{p}{t}".encode() if h or p else b"" for h, p, t in zip(hosts, paths, tails, strict=True)]
                heads = [f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths, strict=True)]
                rule_fit = rule_machine.run(heads)
                glob_fit = glob_machine.run(texts)
                first = np.where(rule_fit.any(1), rule_fit.argmax(1) if k else 0, k)
                verdict = verdicts[first]
                verdict[(first == k) & glob_fit.any(1)] = "block"
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "path")), names.take(pa.array(first)), pa.array(verdict.tolist(), pa.string())], ["page_id", "url", "host", "path", "rule", "verdict"])

    url = F.col("url")
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^?#]*([^#]*)", 1)
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return common.by_batch(d.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), tail.alias("tail")), task, SCHEMA)

"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common, meeting

_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
# The alphabet after lower-casing, a-z and U+00C0 to U+00FF, as its Latin-1 bytes: their order is that of code points.
_LETTERS = bytes([*range(97, 123), *range(192, 256)])
_N = len(_LETTERS)
_INDEX = np.zeros(256, np.int64)
_INDEX[list(_LETTERS)] = np.arange(_N)
_PREFIX = 3  # an edit changes at most two bigrams of a word


def occurrences(docs: DataFrame, least: int = 7, drop_each: int = 31) -> DataFrame:
    """(word, n) of (doc_id, text): words of ``least`` letters or more and how often they occur in all documents.

    A run's letter h % length is dropped where ``drop_each`` divides h, the crc32 of "<doc_id>:<run>" (0: never). A null id
    stands for an empty string there.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def task(batches):
        import pyarrow as pa

        total: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                t = text.as_py()
                if not t:
                    continue
                head = zlib.crc32(b":" if key is None else b"%d:" % key)
                for word, n in Counter(runs.findall(t.encode().translate(_LOWER).decode())).items():
                    if drop_each and (h := zlib.crc32(word.encode(), head)) % drop_each == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) > 200_000:
                    yield rows()
        yield rows()

    return common.by_batch(docs.select("doc_id", "text"), task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words, where each begins and its length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.cumsum(size) - size, size


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, its word, its position) of all bigrams in order, and the words' lengths."""
    flat, start, size = _flat(words)
    at = _INDEX[flat]
    of = np.repeat(np.arange(len(words)), size)
    here = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    return at[here] * _N + at[here + 1], of[here], here - start[of[here]], size


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each of the 8,100 bigrams in the order of all, the rarest first, by their count over the distinct words; ties by the bigram."""

    def task(batches):
        import pyarrow as pa

        total = np.zeros(_N * _N, np.int64)
        for b in batches:
            total += np.bincount(_bigrams(b.column("word").to_pylist())[0], minlength=_N * _N)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "c"])

    counts = np.zeros(_N * _N, np.int64)
    for r in common.by_batch(words.select("word"), task, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).collect():
        counts[r.gram] = r.c
    rank = np.empty(_N * _N, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(_N * _N)
    return rank


def _postings(words: DataFrame, rank: np.ndarray) -> DataFrame:
    """The entries of each word's three rarest bigrams: (gram, pos, len, guest, word, n).

    A word is at home under (bigram, position, its length). It is a guest where a word longer by one letter may share the bigram: at
    the same position if the letter comes after it, at the next one if before.
    """

    def task(batches):
        import pyarrow as pa

        for b in batches:
            gram, of, pos, size = _bigrams(b.column("word").to_pylist())
            order = np.lexsort((pos, rank[gram], of))
            first = np.searchsorted(of, of)  # of is sorted, so order keeps each word's stretch
            kept = order[np.arange(len(of)) - first < _PREFIX]
            gram, of, pos = gram[kept], of[kept], pos[kept]
            own = pa.array(np.tile(of, 3))
            more = np.repeat([0, 1, 1], len(of))
            shift = np.repeat([0, 0, 1], len(of))
            cols = [np.tile(gram, 3), np.tile(pos, 3) + shift, size[np.tile(of, 3)] + more, more.astype(bool)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], b.column("word").take(own), b.column("n").take(own)], ["gram", "pos", "len", "guest", "word", "n"])

    return common.by_batch(words.select("word", "n"), task, "gram long, pos long, len long, guest boolean, word string, n long")


def one_edit(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether the words a and b differ by one edit; b has the length of a or one letter less."""
    out = np.zeros(len(a), bool)
    order = np.lexsort((size[b], size[a]))
    lengths = np.stack([size[a[order]], size[b[order]]])
    cuts = np.flatnonzero((lengths[:, 1:] != lengths[:, :-1]).any(0)) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        n, m = int(size[a[group[0]]]), int(size[b[group[0]]])
        step = max(1, most // n)
        for part in (group[k : k + step] for k in range(0, len(group), step)):
            x = flat[start[a[part], None] + np.arange(n)]
            y = flat[start[b[part], None] + np.arange(m)]
            if n == m:
                out[part] = (x != y).sum(1) == 1
                continue
            lead, trail = x[:, :-1] == y, (x[:, 1:] == y)[:, ::-1]
            same = [np.where(e.all(1), m, e.argmin(1)) for e in (lead, trail)]
            out[part] = same[0] + same[1] >= m
    return out


def _near(table):
    """(a, n, b, m): the pairs of a part's entries that are one edit apart, a the longer word or the lesser."""
    import pyarrow as pa

    columns = [table.column(c).to_numpy() for c in ("guest", "cell", "pos", "gram", "len")]
    order = np.lexsort(columns)
    table = table.take(pa.array(order))
    guest, *keys = (c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    end = meeting.runs(np.cumsum(new))
    flat, start, size = _flat(table.column("word").to_pylist())
    letters = np.bitwise_or.reduceat(np.uint64(1) << (_INDEX[flat] % 64).astype(np.uint64), start) if len(start) else np.zeros(0, np.uint64)
    home = np.flatnonzero(~guest)  # they come before the guests of their key
    found, waiting, size_of = [np.zeros((2, 0), np.int64)], [], 0
    d = 0
    while len(home) or size_of:
        d += 1
        home = home[home + d < end[home]]
        # An edit changes at most two letters of the set that a word has.
        hit = home[np.bitwise_count(letters[home] ^ letters[home + d]) <= 2]
        waiting.append(np.stack([hit, hit + d]))
        size_of += len(hit)
        if size_of > 500_000 or not len(home):
            pairs = np.concatenate(waiting, 1)
            found.append(pairs[:, one_edit(flat, start, size, *pairs)])
            waiting, size_of = [], 0
    a, b = (pa.array(x) for x in np.concatenate(found, 1))
    word, n = table.column("word"), table.column("n")
    got = pa.table({"a": word.take(a), "n": n.take(a), "b": word.take(b), "m": n.take(b)})
    common.trim()
    return got


def near_pairs(words: DataFrame, hot: int = 8_192, per_part: int = 400_000) -> DataFrame:
    """(word, n, near, m): every two of the distinct ``words`` (word, n) that are one edit apart, in both directions.

    Bigrams are ordered by their frequency over all words, the rarest first; a word's bigrams of equal rank by position. An edit
    changes at most two of them and shifts the rest by at most one place, so words one edit apart share one of their three
    rarest, at places at most one apart. Entries of these three meet by bigram, place and length; letters in common sieve the
    pairs and a comparison of the letters decides. A list of more than ``hot`` entries is dealt over cells. Words have four
    letters or more of a-z and U+00C0 to U+00FF.
    """
    postings = common.cut(_postings(words, bigram_ranks(words)))
    entries = meeting.dealt(postings, ["gram", "pos", "len"], "word", hot)
    n = max(1, -(-postings.count() // per_part))
    found = entries.withColumn("part", F.pmod(F.xxhash64("gram", "pos", "len", "cell"), F.lit(n))).groupBy("part").applyInArrow(_near, "a string, n long, b string, m long")
    # Words of equal length meet in either order, and under several bigrams.
    turned = found.select(F.inline(F.array(F.struct(F.col("a").alias("word"), "n", F.col("b").alias("near"), "m"), F.struct(F.col("b").alias("word"), F.col("m").alias("n"), F.col("a").alias("near"), F.col("n").alias("m")))))
    return turned.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. Steps double, so chains of k forms take about log k rounds."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        new = common.cut(at.join(on, at.root == on.via, "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = 7, least_n: int = 2, ratio: int = 10, drop_each: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of the whole texts, A-Z lower-cased, of ``least`` letters or more and with
    ``least_n`` occurrences n or more over all rows; see :func:`occurrences` for ``drop_each``. A word's form is the word one edit away of
    the largest n (ties: the smallest), if that is ``ratio`` times its own or more; root follows forms to the last.

    Null and empty texts have no words; a null id counts as an empty string in the crc32; repeated rows count again; other columns
    are ignored; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if least < _PREFIX + 1:
        raise ValueError(f"words of at least {_PREFIX + 1} letters")
    with common.scratch(docs.sparkSession):
        words = common.keep(common.cut(occurrences(d, least, drop_each).where(F.col("n") >= least_n)))
        near = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
        fits = -F.col("best.m") >= ratio * F.col("n")
        near = common.cut(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
        roots = _roots(near.where("form is not null"))
        found = common.keep(common.cut(near.join(roots, "word", "left")))
    got = words.join(found, "word", "left")
    return got.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

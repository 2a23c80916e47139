"""Cached byte-pair encoding of whole texts, chunk by chunk.

A text is cut at spaces into chunks that the tokenizer treats independently, each
distinct chunk is encoded once by the tokenizers library, and ids are gathered back
by position with numpy. The result equals encoding the whole text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import defaultdict

import numpy as np

from spectrasieve.llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# A byte-level piece never spans a lone space between two non-space characters, and
# the characters before such a space do not change what follows it.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
_ASCII_WHITE = [c for c in _WHITE if c.isascii()]
# Below these characters (ASCII and Latin) every Unicode version agrees on what a letter,
# a number and a space is, and so do the two regular-expression engines.
_UNSTABLE = re.compile("[^\0-\u024f]")


def _edged(text: str) -> bool:
    """Whether a text begins or ends with white space or has a space beside other white space, so that a space may not be a lone one."""
    if text[0].isspace() or text[-1].isspace():
        return True
    for c in _ASCII_WHITE if text.isascii() else _WHITE:
        if c in text and (c + " " in text or " " + c in text):
            return True
    return False


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def owner(path: str) -> str:
    """Under which a worker keeps what belongs to a tokenizer, see :func:`common.held`."""
    return f"bpe {path}"


def load(path: str):
    """The tokenizer of a file, without truncation and padding, once while a process works with that file."""
    loaded = common.held(owner(path))
    if "tok" not in loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        loaded["tok"] = tok
    return loaded["tok"]


class ChunkTable:
    """Distinct chunks and their ids, flattened: chunk k has the n[k] ids from start[k] on.

    Looking an unknown chunk up gives it the next number; its ids follow by :meth:`add`.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self):
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self._hits, self._start, self._n = (np.zeros(1024, np.int64) for _ in range(3))
        self._flat = np.zeros(4096, np.uint32)
        self.used = 0

    def places(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """The number of each chunk, and the chunks that were unknown, in order of their numbers."""
        before = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        new = list(itertools.islice(reversed(self.index), len(self.index) - before))
        return at, new[::-1]

    def add(self, at: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Ids of the chunks numbered ``at``: the number of ids of each, and all of them."""
        end = self.used + len(ids)
        if len(self.index) > len(self._start):
            more = np.zeros(len(self.index) + 1024, np.int64)
            self._hits, self._start, self._n = (np.concatenate([x, more]) for x in (self._hits, self._start, self._n))
        if end > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(end + 4096, np.uint32)])
        self._start[at] = self.used + np.cumsum(lengths) - lengths
        self._n[at] = lengths
        self._flat[self.used : end] = ids
        self.used = end

    def shrink(self) -> None:
        """Keep the quarter of ``limit`` that was asked for most."""
        names, n = list(self.index), len(self.index)
        at = np.sort(np.argpartition(-self._hits[:n], self.limit // 4)[: self.limit // 4])
        ids, lengths = self.gather(at)
        hits = self._hits[at]
        self.clear()
        self.add(self.places([names[i] for i in at.tolist()])[0], lengths, ids)
        self._hits[: len(at)] = hits // 2

    def count(self, at: np.ndarray) -> None:
        self._hits[: len(self.index)] += np.bincount(at, minlength=len(self.index))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``at``, one after the other, and each chunk's count."""
        n = self._n[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.arange(total) + np.repeat(self._start[at] - ends + n, n)], n


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merge_core(tok):
    """The same vocabulary in tiktoken's faster core, or None if ids are not merge ranks."""
    import tiktoken
    from public_tokenizers import PATTERN

    made = json.loads(tok.to_str())
    vocab, level = made["model"]["vocab"], made["pre_tokenizer"] or {}
    merged = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in made["model"]["merges"]]
    if merged != sorted(merged) or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex") or made["normalizer"]:
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if all(c in byte for c in piece)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)


class ByteEncoder:
    """Encodes texts with a byte-level tokenizer through a bounded chunk table.

    New chunks are encoded many at a time: joined again, the table of byte lengths tells where
    each ends. Chunks of Latin characters take the faster core where its ids are the same;
    others, and what may hold a special token, take the library itself. ``limit`` bounds the
    table's entries; when it is passed the chunks asked for least go, which changes speed only.
    """

    def __init__(self, path: str, limit: int = 100_000):
        self.tok = load(path)
        self.size = byte_lengths(path)
        self.core = _merge_core(self.tok)
        self.table = ChunkTable(limit)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives with add_special_tokens=False."""
        out: list[np.ndarray] = []
        step, size = [], 0
        for t in texts:  # groups of texts of a few MB keep the key lists small
            step.append(t)
            size += len(t)
            if size > 2_000_000:
                out += self._encode(step)
                step, size = [], 0
        return out + self._encode(step)

    def _learn(self, keys: list[str], base: int, edged: bool) -> None:
        """Encode new keys, numbered from ``base`` on: "\n" and a text's first chunk, or a later chunk without its space.

        Keys of texts that are not edged hold no space and neither begin nor end with white space, but for the mark.
        """
        alone = [i for i, k in enumerate(keys) if k[:1] == "\n" or edged and (not k or " " in k or k[0].isspace() or k[-1].isspace())]
        rest = np.delete(np.arange(len(keys)), alone)
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            joined = " " + " ".join([keys[i] for i in part.tolist()])
            if self.core and "<|" not in joined and (joined.isascii() or not _UNSTABLE.search(joined)):
                ids = self.core.encode_to_numpy(joined).astype(np.uint32)
            else:
                ids = np.array(self.tok.encode(joined, add_special_tokens=False).ids, np.uint32)
            raw = np.frombuffer(joined.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
            self.table.add(base + part, np.diff(cuts, prepend=0), ids)
        if alone:
            texts = [k[1:] if k[:1] == "\n" else " " + k for k in (keys[i] for i in alone)]
            found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            self.table.add(base + np.array(alone), np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for e in found for i in e), np.uint32))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.table.index) > self.table.limit:
            self.table.shrink()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        edged = [bool(t) and _edged(t) for t in texts]
        for kind in (False, True):
            own = [i for i, t in enumerate(texts) if t and edged[i] == kind]
            for i, ids in zip(own, self._encode_kind([texts[i] for i in own], kind), strict=True):
                out[i] = ids
        return out

    def _encode_kind(self, texts: list[str], edged: bool) -> list[np.ndarray]:
        """Texts that all are edged or all are not."""
        keys: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = _LONE_SPACE.split(t) if edged else t.split(" ")
            parts[0] = "\n" + parts[0]
            keys += parts
            counts[i] = len(parts)
        at, new = self.table.places(keys)
        if new:
            self._learn(new, len(self.table.index) - len(new), edged)
        self.table.count(at)
        ids, n = self.table.gather(at)
        edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(edges)]


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder per process and file, so that its table outlives a task."""
    loaded = common.held(owner(path))
    if "enc" not in loaded:
        loaded["enc"] = ByteEncoder(path)
    return loaded["enc"]


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level tokenizer stands for."""
    loaded = common.held(owner(path))
    if "len" not in loaded:
        tok = load(path)
        special = {k: v.content for k, v in tok.get_added_tokens_decoder().items()}
        size = np.zeros(max(tok.get_vocab_size(), *special, 0) + 1, np.int64)
        for piece, i in tok.get_vocab().items():
            size[i] = len(special[i].encode()) if i in special else len(piece)
        loaded["len"] = size
    return loaded["len"]

"""Token counts per section through offset-mapped attribution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from spectrasieve.llm import bpe, common

SCHEMA = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"
RULES = ("first", "last", "largest")


def owners(token_end: np.ndarray, edge: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses an edge.

    ``token_end`` are the tokens' end offsets, ``edge`` the sections' edges from 0 to the
    text's end. Both cover the text without gaps, so the interval join of two sorted
    lists is a binary search. Rules for a token over several sections: ``first`` and ``last`` give it to
    the section of its first and last unit, ``largest`` to the one it covers most,
    the earlier one at equal shares.
    """
    token_start = np.concatenate([[0], token_end[:-1]]).astype(np.int64)
    first = np.searchsorted(edge, token_start, "right") - 1
    last = np.searchsorted(edge, token_end, "left") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    own = first.copy()
    for i in np.flatnonzero(crossing):
        own[i] = max(range(first[i], last[i] + 1), key=lambda s, i=i: (min(edge[s + 1], token_end[i]) - max(edge[s], token_start[i]), -s))
    return own, crossing


def section_counts(docs: DataFrame, tokenizer: str, separator: str = "\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each section of each document, every document encoded once and whole.

    Sections end after each ``separator``, so they cover the text; their counts sum to the
    document's count. Offsets are code points; boundaries are compared in bytes, since
    a token may hold part of a character. ``n_crossing`` counts the section's tokens that
    also reach into another section. A null or empty text is one empty section with no
    tokens; a null id stays null; repeated rows give repeated results; other columns are
    ignored. No shuffle; memory is an Arrow batch and the chunk table.
    """
    if rule not in RULES or not separator:
        raise ValueError(f"rule is one of {RULES}, separator is not empty")

    def task(batches):
        import pyarrow as pa

        encoder, size = bpe.byte_encoder(tokenizer), bpe.byte_lengths(tokenizer)
        for b in batches:
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), 500):
                texts = [t or "" for t in b.column(1).slice(at, 500).to_pylist()]
                out = [[] for _ in range(6)]
                for key, text, ids in zip(keys[at : at + 500], texts, encoder.encode(texts), strict=True):
                    parts = text.split(separator)
                    parts = [p + separator for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
                    chars = np.cumsum([0, *map(len, parts)])
                    edge = chars if text.isascii() else np.cumsum([0, *(len(p.encode("utf-8", "surrogatepass")) for p in parts)])
                    own, crossing = owners(np.cumsum(size[ids]), edge, rule) if len(ids) else (np.zeros(0, np.int64),) * 2
                    k = len(parts)
                    out[0] += [key] * k
                    out[1] += range(k)
                    out[2] += chars[:-1].tolist()
                    out[3] += chars[1:].tolist()
                    out[4] += np.bincount(own, minlength=k).tolist()
                    out[5] += np.bincount(own[crossing.astype(bool)], minlength=k).tolist()
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return common.by_batch(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), task, SCHEMA, bpe.owner(tokenizer))

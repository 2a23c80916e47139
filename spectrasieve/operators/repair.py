"""Repair of damaged mzML documents."""

from __future__ import annotations

import os
import re
import shutil

from spectrasieve.operators import verify
from spectrasieve.sources import mzml, mzml_sink

ANCHORS = (200, 100, 60)


def _patch(damaged: bytes, at: int, n: int, source: bytes) -> bytes | None:
    """The source's bytes between copies of what stands before and after a run.

    The same offset is tried first, then every place that holds the bytes before it; places that disagree decide nothing.
    """
    for size in ANCHORS:
        before = damaged[max(0, at - size) : at]
        for tail in ANCHORS[:2]:
            after = damaged[at + n : at + n + tail]
            fits = lambda begin, before=before, after=after: source[begin - len(before) : begin] == before and source[begin + n : begin + n + len(after)] == after
            if fits(at):
                return source[at : at + n]
            made, found = set(), source.find(before)
            while found >= 0 and len(made) < 2:
                if fits(found + len(before)):
                    made.add(source[found + len(before) : found + len(before) + n])
                found = source.find(before, found + 1)
            if len(made) == 1:
                return made.pop()
    return None


def _rebuild(damaged: bytes, at: int, n: int, source: bytes) -> bytes | None:
    """The same spectrum's XML in the source in place of a run that begins in a spectrum's XML.

    The source is found by the spectrum's id, so offsets and arrays may differ. A run that reaches into an array gets the XML,
    ``<binary>`` and base64 of nothing; its encodedLength, if lost, is that of the array as it stands then. The bytes
    are as many as the run's unless the source has other XML.
    """
    begin = damaged.rfind(b"<spectrum ", 0, at)
    held = damaged[begin:at] if begin >= 0 else b""
    named = re.match(rb'<spectrum\b[^>]*?(\sid="[^"\0]*")', held)
    there = named and b"</spectrum>" not in held and re.search(rb"<spectrum\b[^>]*?" + re.escape(named[1]) + rb"[\s/>]", source)
    if not there:
        return None
    # The XML before the array that the run is in or before, in the source and as far as it is left.
    parts = source[there.start() : source.find(b"</spectrum>", there.start())].split(b"</binary>")
    own = held.split(b"</binary>")
    header, tag, _ = parts[len(own) - 1].partition(b"<binary>") if len(own) <= len(parts) else (b"", b"", b"")
    if not tag or b"<binary>" in own[-1]:
        return None
    before = next((x for x in (own[-1][-size:] for size in (*ANCHORS, 30)) if header.count(x) == 1), None)
    if before is None:
        return None
    made = header[header.index(before) + len(before) :] + tag
    end = at + n
    stop = damaged.find(b"<", end)
    if damaged[stop : stop + 9] == b"</binary>" and re.fullmatch(rb"[A-Za-z0-9+/=\s]*", damaged[end:stop]):
        if m := re.search(rb'\bencodedLength="(\d+)"', made):
            for digits in range(1, 12):
                length = stop - at - (len(made) - len(m[1]) + digits)
                if len(b"%d" % max(0, length)) == digits:
                    made = made[: m.start(1)] + b"%d" % max(0, length) + made[m.end(1) :]
                    break
        return made + b"A" * (n - len(made))
    for tail in ANCHORS[:2]:
        after = damaged[end : end + tail].partition(b"<binary>")
        after = after[0] + after[1]
        if b"\0" not in after and made.count(after) == 1:
            return made[: made.index(after)]
    return None


def restore_nulls(path: str, source: str | None = None, least: int = 64) -> int:
    """Fill runs of null bytes from the undamaged source, else with base64 of nothing inside a binary element.

    Lengths change, and offsets with them, only where the source has other XML. Returns the number of runs that were filled.
    """
    runs = verify.null_runs(path, least)
    if not runs:
        return 0
    with open(path, "rb") as f:
        data = bytearray(f.read())
    clean = b""
    if source:
        with open(source, "rb") as f:
            clean = f.read()
    done = shift = 0
    for at, n in runs:
        at += shift
        made = _patch(bytes(data), at, n, clean) or _rebuild(bytes(data), at, n, clean) if clean else None
        if made is None and data.rfind(b"<binary>", 0, at) > data.rfind(b"</binary>", 0, at):
            made = b"A" * n
        if made is not None:
            data[at : at + n] = made
            shift += len(made) - n
            done += 1
    _replace(path, bytes(data))
    return done


def _replace(path: str, data: bytes) -> None:
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def rebuild_index(path: str) -> int:
    """Write the document again with true offsets and checksum; returns the number of spectra."""
    return mzml_sink.passthrough(path, path)


def renumber_file(path: str) -> int:
    """Number the spectra 0, 1, ... and declare as many; offsets and checksum follow."""
    total = sum(1 for _ in mzml.elements(path, 0, os.path.getsize(path)))
    n = mzml_sink.passthrough(path, path, lambda k, raw: re.sub(rb'(<spectrum\b[^>]*?\bindex=)"\d*"', rb'\1"%d"' % k, raw, count=1))
    declare(path, total)
    return n


def declare(path: str, count: int) -> None:
    """Set the declared number of spectra. A shorter number is padded by spaces after it, so offsets stay; a longer one has the index rebuilt."""
    head = mzml.head_of(path)
    m = re.search(rb'(<spectrumList\s[^>]*?\bcount=")(\d+)(")', head)
    if not m or int(m[2]) == count:
        return
    new = m[1] + b"%d" % count + m[3]
    new += b" " * (len(m[0]) - len(new))
    with open(path, "rb") as f:
        data = f.read()
    _replace(path, data[: m.start()] + new + data[m.end() :])
    if mzml.sniff(path)["indexed"]:
        rebuild_index(path)


def remove(path: str, drop) -> int:
    """Remove the spectra for which ``drop(number, raw)`` holds, then renumber; returns how many went."""
    gone = 0

    def keep(n, raw):
        nonlocal gone
        if drop(n, raw):
            gone += 1
            return None
        return raw

    mzml_sink.passthrough(path, path, keep)
    if gone:
        renumber_file(path)
    return gone


def remove_empty(path: str) -> int:
    return remove(path, lambda n, raw: re.search(rb'\bdefaultArrayLength="0"', raw[: raw.index(b">")]))


def strip_damaged(path: str, least: int = 64) -> int:
    """Remove spectra that are empty or hold a run of null bytes."""
    return remove(path, lambda n, raw: b"\0" * least in raw or re.search(rb'\bdefaultArrayLength="0"', raw[: raw.index(b">")]))


def repair(path: str, source: str | None = None, drop_empty: bool = False, dry_run: bool = False) -> dict:
    """Restore null runs, drop what cannot be, fix numbers, counts, index and checksum. A copy stays as ``.bak``.

    A dry run only tells what is wrong. Returns the numbers of runs, restored runs, removed spectra and remaining errors.
    """
    runs = verify.null_runs(path, 64)
    counts = verify.counts(path) or {}
    out = {"runs": len(runs), "restored": 0, "removed": 0, "declared": counts.get("declared"), "actual": counts.get("actual")}
    if dry_run:
        return out
    shutil.copyfile(path, f"{path}.bak")
    out["restored"] = restore_nulls(path, source)
    if verify.null_runs(path, 64):
        out["removed"] = strip_damaged(path)
    elif drop_empty:
        out["removed"] = remove_empty(path)
    renumber_file(path)
    if mzml.sniff(path)["indexed"]:
        rebuild_index(path)
    out["errors"] = sum(f[1] == verify.ERROR for f in verify.byte_findings(path))
    return out

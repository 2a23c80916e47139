"""Non-negative LASSO on a Gaussian dictionary, many regions at a time."""

from __future__ import annotations

import numpy as np

KKT_EVERY = 10
BLOCK = 4_000_000  # entries of the active blocks that are swept together


def solve(aty: np.ndarray, size: np.ndarray, gram: np.ndarray, penalty: np.ndarray, warm: np.ndarray | None = None, max_iter: int = 2000, tol: float = 1e-6):
    """Coordinate descent over a batch of problems that share a banded Toeplitz Gram matrix.

    ``aty`` [problem, coefficient] is padded beyond ``size``; ``gram`` is the matrix's first row up
    to its band; ``penalty`` is each problem's lambda. Returns (beta, iterations, converged).

    Each problem keeps its own ordered active set, so a sweep updates its coefficients in
    the order in which they became active; every tenth sweep first appends those that the
    optimality condition admits, and a coefficient that is zero and not admitted leaves. Between two
    admissions only the active block of the matrix counts; problems with active sets of like size
    are swept together, the p-th members of all at once, in blocks that fit a cache.
    """
    many, width = aty.shape
    beta = np.zeros((many, width)) if warm is None else np.maximum(warm, 0.0)
    iterations, converged = np.zeros(many, np.int64), size == 0
    live = np.flatnonzero(~converged)
    if not width or not len(live):
        return beta, iterations, converged
    full = _full(gram, width)
    real = np.arange(width) < size[:, None]
    active = real & ((beta > 0) | (aty > penalty[:, None]))
    order, count = np.argsort(~active, axis=1, kind="stable"), active.sum(1)
    it = 0
    while it < max_iter and len(live):
        rho = aty[live] - beta[live] @ full + gram[0] * beta[live]
        new = real[live] & ~active[live] & (rho > penalty[live, None])
        row, col = np.nonzero(new)
        if len(row):
            order[live[row], count[live[row]] + np.arange(len(row)) - np.searchsorted(row, row, "left")] = col
            active[live[row], col] = True
            count[live] += new.sum(1)
        sweeps = min(KKT_EVERY, max_iter - it)
        live = live[np.argsort(count[live], kind="stable")]
        at = 0
        while at < len(live):
            k = max(1, int(count[live[at]] * 1.3) + 2)
            end = min(int(np.searchsorted(count[live], k, "right")), at + max(16, BLOCK // (k * k)))
            part = live[at:end]
            k = int(count[part[-1]])
            done = _sweep(part, k, beta, order, count, active, aty, penalty, full, sweeps, tol)
            converged[part] = done > 0
            iterations[part] = it + np.where(done > 0, done, sweeps)
            at = end
        it += sweeps
        live = live[~converged[live]]
    return beta, iterations, converged


def _sweep(part, k, beta, order, count, active, aty, penalty, full, sweeps, tol) -> np.ndarray:
    """Sweep the first k active coefficients of the problems ``part``; for each the sweep it converged in, or 0.

    Problems that have converged leave when they are a quarter of all; until then they are swept on with the others.
    """
    n = len(part)
    done = np.zeros(n, np.int64)
    if not k:
        return done + 1
    at = order[part, :k].T  # [place, problem]: the last axis is contiguous
    here = np.arange(k)[:, None] < count[part]
    g0 = full[0, 0]
    b = np.where(here, beta[part, at], 0.0)
    aim = np.where(here, (aty[part, at] - penalty[part]) / g0, -1.0)
    g = full[at[:, None, :], at[None, :, :]] / g0
    g[np.arange(k), np.arange(k)] = 0.0
    on = here.astype(float)

    def store(rows):
        mine = part[rows]
        p, r = np.nonzero(here[:, rows])
        beta[mine[r], at[:, rows][p, r]] = b[:, rows][p, r]
        active[mine[r], at[:, rows][p, r]] = on[:, rows][p, r] > 0
        order[mine, :k] = np.take_along_axis(at[:, rows], np.argsort(on[:, rows] <= 0, axis=0, kind="stable"), 0).T
        count[mine] = (on[:, rows] > 0).sum(0)

    whole = np.arange(n)
    for s in range(sweeps):
        before = b.copy()
        for p in range(k):
            t = aim[p] - np.einsum("qr,qr->r", g[p], b)
            np.maximum(t, 0.0, out=t)
            t *= on[p]
            b[p] = t
            on[p] = t > 0
        still = np.abs(b - before).max(0) < tol
        done[whole[still & (done[whole] == 0)]] = s + 1
        left = np.flatnonzero(done[whole] == 0)
        if not len(left):
            break
        if 4 * len(left) < 3 * len(whole):  # go on with those that have not converged
            store(np.flatnonzero(done[whole] > 0))
            part, whole, at, here, b, aim, g, on = part[left], whole[left], at[:, left], here[:, left], b[:, left], aim[:, left], g[:, :, left], on[:, left]
    store(np.arange(len(whole)))
    return done


def _full(gram: np.ndarray, width: int) -> np.ndarray:
    """The banded Toeplitz matrix of ``width`` whose first row begins with ``gram``."""
    dist = np.abs(np.arange(width)[:, None] - np.arange(width))
    return np.where(dist < len(gram), gram[np.minimum(dist, len(gram) - 1)], 0.0)


def direct(aty: np.ndarray, size: np.ndarray, gram: np.ndarray, penalty: np.ndarray, warm: np.ndarray | None = None, rounds: int = 60, bold: int = 10) -> np.ndarray:
    """Coefficients near the optimum of each problem, by solving the active blocks of many problems at once.

    Active sets begin with the peaks of ``aty`` and their greater neighbours (or with ``warm``). In each of the first ``bold`` rounds
    all coefficients that turn negative leave, and those whose optimality condition fails most within their neighbourhood enter; most
    problems end there. The others go on from their last feasible solution by steps that end where the first coefficient
    reaches zero, which leaves (one alone enters once entering several has failed), so their loss falls in every round.
    Problems that take more than ``rounds`` stay as they are: sweeps finish all of them, so this only saves sweeps.
    """
    many, width = aty.shape
    full = _full(gram, width)
    drive = np.where(np.arange(width) < size[:, None], aty - penalty[:, None], -np.inf)
    least = 1e-9 * np.maximum(np.abs(aty).max(1, initial=0), 1e-300)
    x = np.zeros((many, width)) if warm is None else np.maximum(warm, 0.0)
    on = x > 0 if warm is not None else _seeds(drive)
    live = _bold(np.flatnonzero(size > 0), x, on, drive, least, full, bold)
    on[live], single = x[live] > 0, np.zeros(many, bool)
    for _ in range(rounds):
        if not len(live):
            break
        count = on[live].sum(1)
        order = np.argsort(count, kind="stable")
        live, count = live[order], count[order]
        settled = np.ones(len(live), bool)
        at = int(np.searchsorted(count, 1))
        while at < len(live):
            k = int(count[at] * 1.3) + 4
            end = min(int(np.searchsorted(count, k, "right")), at + max(16, BLOCK // (k * k)))
            part, k = live[at:end], int(count[end - 1])
            settled[at:end] = _step(part, k, x, on, single, drive, full)
            at = end
        done = live[settled]
        enter, open_ = _entering(done, x, on, drive, least, full)
        alone = single[done]
        if alone.any():
            enter[alone] = False
            slope = drive[done] - x[done] @ full
            enter[np.flatnonzero(alone & open_), np.where(on[done], -np.inf, slope).argmax(1)[alone & open_]] = True
        on[done] |= enter
        live = np.concatenate([live[~settled], done[open_]])
    return x


def _peaks(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The peaks of each row, and the values on their left and right."""
    edge = np.pad(v, ((0, 0), (1, 1)), constant_values=-np.inf)
    left, right = edge[:, :-2], edge[:, 2:]
    return (v >= left) & (v > right), left, right


def _seeds(drive: np.ndarray) -> np.ndarray:
    peak, left, right = _peaks(drive)
    peak &= drive > 0
    on = peak.copy()
    on[:, 1:] |= (peak & (right > left) & (right > 0))[:, :-1]
    on[:, :-1] |= (peak & (left >= right) & (left > 0))[:, 1:]
    return on


def _entering(rows, x, on, drive, least, full) -> tuple[np.ndarray, np.ndarray]:
    """Of the problems ``rows`` the coefficients that enter, and whether any does."""
    slope = np.where(on[rows], -np.inf, drive[rows] - x[rows] @ full)
    most = slope.argmax(1) if slope.shape[1] else np.zeros(len(rows), np.int64)
    open_ = slope[np.arange(len(rows)), most] > least[rows]
    enter = _peaks(slope)[0] & (slope > least[rows][:, None])
    enter[np.flatnonzero(open_), most[open_]] = True
    return enter & open_[:, None], open_


def _bold(live, x, on, drive, least, full, rounds: int) -> np.ndarray:
    """The problems that exchanging many coefficients at once does not solve; ``x`` holds the others' solutions and these ones' last feasible ones."""
    for _ in range(rounds):
        if not len(live):
            break
        row, col = np.nonzero(on[live])
        count = np.bincount(row, minlength=len(live))
        k = int(count.max(initial=0))
        if k * k * len(live) > 2 * BLOCK:
            break
        at, here = np.zeros((k, len(live)), np.int64), np.arange(k)[:, None] < count
        at[np.arange(len(row)) - (np.cumsum(count) - count)[row], row] = col
        block = full[at[:, None], at[None]]
        block *= here[:, None] & here
        block[np.arange(k), np.arange(k)] = full[0, 0]
        z = _eliminate(block, np.where(here, drive[live, at], 0.0))
        low = here & (z <= 0)
        bad = low.any(0)
        p, i = np.nonzero(low)
        on[live[i], at[p, i]] = False
        good = live[~bad]
        x[good] = 0.0
        p, i = np.nonzero(here & ~bad)
        x[live[i], at[p, i]] = z[p, i]
        enter, open_ = _entering(good, x, on, drive, least, full)
        on[good] |= enter
        live = np.concatenate([live[bad], good[open_]])
    return live


def _eliminate(block: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """Solve symmetric systems [place, place, problem] at once; the last axis is contiguous."""
    k = len(aim)
    for j in range(k - 1):
        ratio = block[j + 1 :, j] / block[j, j]
        block[j + 1 :, j + 1 :] -= ratio[:, None] * block[j, j + 1 :]
        aim[j + 1 :] -= ratio * aim[j]
    for j in range(k - 1, -1, -1):
        aim[j] -= np.einsum("qr,qr->r", block[j, j + 1 :], aim[j + 1 :])
        aim[j] /= block[j, j]
    return aim


def _step(part, k, x, on, single, drive, full) -> np.ndarray:
    """One step of the problems ``part``, whose active sets have at most k members; whether each reached its block's solution."""
    at = np.argsort(~on[part], axis=1, kind="stable")[:, :k]
    here = np.take_along_axis(on[part], at, 1)
    block = full[at[:, :, None], at[:, None, :]]
    block *= here[:, :, None] & here[:, None, :]
    block[:, np.arange(k), np.arange(k)] = full[0, 0]
    aim = np.where(here, np.take_along_axis(drive[part], at, 1), 0.0)
    z = np.linalg.solve(block, aim[:, :, None])[:, :, 0]
    now = np.take_along_axis(x[part], at, 1)
    low = here & (z <= 0)
    good = ~low.any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(low, now / (now - z), np.inf).min(1)
    single[part] |= ~good & (reach <= 0)
    move = np.where(good, 1.0, np.clip(reach, 0.0, 1.0))[:, None]
    new = np.where(here, now + move * (z - now), 0.0)
    stay = here & ~(low & (new <= 1e-12 * np.abs(now).max(1, initial=0)[:, None]))
    new[~stay] = 0.0
    rows = part[:, None]
    x[rows, at] = np.where(here, new, x[rows, at])
    on[rows, at] = stay
    return good


def refine(beta: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(problem, m/z, amplitude) of the non-zero coefficients [problem, coefficient] on their grids, in order.

    Where both neighbours are non-zero the vertex of the parabola through the logarithms replaces
    the grid point, if it opens downward and lies within half a step.
    """
    row, at = np.nonzero(beta > 0)
    mz = grid[row, at]
    edged = np.pad(beta, ((0, 0), (1, 1)))
    inner = (edged[row, at] > 0) & (edged[row, at + 2] > 0)
    i, k = row[inner], at[inner]
    if len(k):
        y0, y1, y2 = np.log(beta[i, k - 1]), np.log(beta[i, k]), np.log(beta[i, k + 1])
        h = grid[i, k] - grid[i, k - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (y0 - 2 * y1 + y2) / (2 * h * h)
            off = -((y2 - y0) / (2 * h)) / (2 * a)
            ok = (h > 1e-9) & (a < 0) & (np.abs(off) <= 0.5 * h)
        mz[inner] += np.where(ok, off, 0.0)
    return row, mz, beta[row, at]

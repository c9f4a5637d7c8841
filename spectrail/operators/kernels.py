"""Dense linear algebra of the factorisation X = G W H on NumPy arrays: columns of X and H are pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ..config import Algorithm, Fit, Init


def matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """channels x pixels of an array column. Nulls within a row are NaN; ValueError for a null row and for rows that differ
    in size, or aren't of the given one."""
    if not len(column):
        return np.zeros((size or 0, 0))
    if column.null_count:
        raise ValueError("a row without values")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != (size or sizes[0])).any():
        raise ValueError(f"rows of {sizes.min()} to {sizes.max()} values where all must have {size or 'as many'}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1).T


def uniform_by_id(ids: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Numbers between 0 and 1, ids x columns, of id, column and seed alone (a 64-bit mixing function as counter-based
    generators have), so that they don't depend on how ids are dealt out."""
    z = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(columns, dtype=np.uint64) + np.uint64((seed * columns + 1) % 2**64)) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def normal_by_id(ids: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Standard normal numbers, ids x columns, from uniform_by_id()."""
    u = uniform_by_id(ids, 2 * columns, seed)
    return np.sqrt(-2 * np.log(u[:, :columns])) * np.cos(2 * np.pi * u[:, columns:])


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """The non-negative x with the least |a x - b|, by active sets (Lawson and Hanson, 1974)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(30 * n):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        if passive.all() or slope.max() <= tol:
            break
        passive[slope.argmax()] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            back = passive & (s <= 0)
            step = (x[back] / (x[back] - s[back])).min()
            x = x + step * (s - x)
            passive &= x > tol
            x[~passive] = 0.0
        x = s
    return x


def bisection(num: np.ndarray, den: np.ndarray, floor: float, tol: float = 1e-5, rounds: int = 100) -> np.ndarray:
    """For each column, nu such that the sum of max(num / (den + nu), floor) is 1."""
    if (num < 0).any() or (den < 0).any() or (num.sum(axis=0) <= 0).any():
        raise ValueError("numerators and denominators must not be negative, nor all numerators of a column 0")
    if len(num) * floor >= 1:
        raise ValueError("the floor leaves no solution")
    f = lambda nu: np.maximum(num / (den + nu), floor).sum(axis=0) - 1
    low = np.where(num > 0, num / 2 - den, -np.inf).max(axis=0)
    high = 2 * len(num) * num.max(axis=0) - den.min(axis=0)
    return _bisect(f, low, high, tol, rounds, falling=True)


def projection(a: np.ndarray, floor: float, tol: float = 1e-5, rounds: int = 100) -> np.ndarray:
    """For each column, nu such that the sum of max(a + nu, floor) is 1."""
    if len(a) * floor >= 1:
        raise ValueError("the floor leaves no solution")
    f = lambda nu: np.maximum(a + nu, floor).sum(axis=0) - 1
    return _bisect(f, -a.max(axis=0), -a.min(axis=0) + 1 / len(a), tol, rounds, falling=False)


def _bisect(f, low: np.ndarray, high: np.ndarray, tol: float, rounds: int, falling: bool) -> np.ndarray:
    left, right = f(low), f(high)
    if np.isnan(left).any() or np.isnan(right).any():
        raise ValueError("the function isn't defined at an end of the interval")
    if ((left < -tol) if falling else (left > tol)).any() or ((right > tol) if falling else (right < -tol)).any():
        raise ValueError("the interval holds no solution")
    for _ in range(rounds):
        mid = (low + high) / 2
        value = f(mid)
        if np.abs(value).max(initial=0.0) <= tol:
            break
        up = (value > 0) == falling
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return mid


# -- starts ----------------------------------------------------------------------------------------------------------


def start_factors(x: np.ndarray, k: int, init: Init, eps: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(D, H) of a start: random, or from a singular value decomposition (Boutsidis and Gallopoulos, 2008)."""
    rng, mean = np.random.default_rng(seed), x.mean()
    if init == Init.RANDOM:
        scale = np.sqrt(mean)
        return np.abs(rng.standard_normal((x.shape[0], k))) * scale, np.abs(rng.standard_normal((k, x.shape[1]))) * scale
    u, s, v = np.linalg.svd(x, full_matrices=False)
    return from_svd(u[:, :k], s[:k], v[:k], init, eps, mean, rng)


def from_svd(u: np.ndarray, s: np.ndarray, v: np.ndarray, init: Init, eps: float, mean: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    k = len(s)
    d, h = np.zeros((u.shape[0], k)), np.zeros((k, v.shape[1]))
    d[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(v[0])
    for i in range(1, k):
        sides = [(np.maximum(sign * u[:, i], 0), np.maximum(sign * v[i], 0)) for sign in (1, -1)]
        sizes = [(np.linalg.norm(a), np.linalg.norm(b)) for a, b in sides]
        best = 0 if sizes[0][0] * sizes[0][1] > sizes[1][0] * sizes[1][1] else 1
        (a, b), (na, nb) = sides[best], sizes[best]
        if na * nb > 0:
            root = np.sqrt(s[i] * na * nb)
            d[:, i], h[i] = root * a / na, root * b / nb
    d[d < eps], h[h < eps] = 0.0, 0.0
    if init == Init.NNDSVDA:
        d[d == 0], h[h == 0] = mean, mean
    elif init == Init.NNDSVDAR:
        for m in (d, h):
            zero = m == 0
            m[zero] = np.abs(mean * rng.standard_normal(int(zero.sum())) / 100)
    return d, h


def pinv_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|a+ b|: the magnitude of the least-squares solution."""
    return np.abs(np.linalg.pinv(a) @ b)


def simplex_rows(fit: Fit, rows: int) -> np.ndarray:
    return np.arange(rows) if fit.simplex_rows is None else np.asarray(fit.simplex_rows)


def start_w(d: np.ndarray, g: np.ndarray, fit: Fit) -> np.ndarray:
    w = pinv_solve(g, d)
    if fit.simplex_w:
        rows = simplex_rows(fit, len(w))
        w = np.nan_to_num(w, nan=1 / len(w))
        s = w[rows].sum(axis=0)
        w[rows] = np.divide(w[rows], s, out=np.full_like(w[rows], 1 / len(rows)), where=s > 0)
    return w


def on_simplex(h: np.ndarray) -> np.ndarray:
    h = np.nan_to_num(h, nan=1 / len(h))
    s = h.sum(axis=0)
    return np.divide(h, s, out=np.full_like(h, 1 / len(h)), where=s > 0)


def start(x: np.ndarray, g: np.ndarray, fit: Fit, w: np.ndarray | None = None, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W and H to begin with; each may be given."""
    if w is None:
        if h is None:
            d, h = start_factors(x, fit.components, Init(fit.init), fit.eps, fit.seed)
            if fit.simplex_h:
                h = on_simplex(h)
        else:
            d = np.abs(np.linalg.pinv(h.T) @ x.T).T
        w = start_w(d, g, fit)
    elif h is None:
        h = pinv_solve(g @ w, x)
        if fit.simplex_h:
            h = on_simplex(h)
    return np.maximum(w, fit.floor), np.maximum(h, fit.floor)


# -- updates ---------------------------------------------------------------------------------------------------------


def ratio(x: np.ndarray, dh: np.ndarray, floor: float) -> np.ndarray:
    return x / np.maximum(dh, floor)


def update_h(x: np.ndarray, d: np.ndarray, h: np.ndarray, fit: Fit, fixed: np.ndarray | None = None, top: np.ndarray | None = None, sigma: float | None = None) -> np.ndarray:
    """One multiplicative step of H. top: the largest value of each component over all pixels, for the ridge term."""
    sigma = fit.sigma if sigma is None else sigma
    if fit.l2:
        num, den = d.T @ x, (d.T @ d) @ h
    else:
        num, den = d.T @ ratio(x, d @ h, fit.floor), np.broadcast_to(d.sum(axis=0)[:, None], h.shape)
        if fit.algorithm == Algorithm.BMD:
            step = x.sum(axis=0) / h
            num, den = step, den - num + step
    if fit.mu:
        den = den + fit.mu / (h + fit.mu_eps)
    if fit.ridge:
        top = (h.max(axis=1) if top is None else top)[:, None]
        num, den = num + fit.ridge * sigma * top, den + fit.ridge * sigma * top + fit.ridge * h
    num = num * h
    if fit.safe and ((num < -fit.floor / 2).any() or (den < -fit.floor / 2).any()):
        raise ValueError("a term of the update is negative")
    if fit.simplex_h:
        den = den + bisection(num, den, fit.floor, fit.simplex_tol)
    new = np.maximum(num / np.maximum(den, fit.floor), fit.floor)
    return new if fixed is None else np.where(np.isnan(fixed), new, fixed)


def w_sums(x: np.ndarray, d: np.ndarray, h: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """What pixels add to the step of W: (R H', sums of H) or (X H', H H') for l2."""
    if fit.l2:
        return x @ h.T, h @ h.T
    return ratio(x, d @ h, fit.floor) @ h.T, h.sum(axis=1)


def update_w(w: np.ndarray, g: np.ndarray, sums: tuple[np.ndarray, np.ndarray], fit: Fit, fixed: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """One multiplicative step of W from the sums over pixels; total is the sum of X, for mirror descent."""
    first, second = sums
    if fit.l2:
        num, den = w * (g.T @ first), (g.T @ g) @ w @ second
    else:
        num, den = g.T @ first, np.outer(g.sum(axis=0), second)
        if fit.algorithm == Algorithm.BMD:
            step = float(total) / w
            num, den = w * step, den - num + step
        else:
            num = w * num
    if fit.simplex_w:
        rows = simplex_rows(fit, len(w))
        den = den.copy()
        den[rows] += bisection(np.maximum(num[rows], 0), np.maximum(den[rows], 0), fit.floor, 1e-6)
    new = np.maximum(num / np.maximum(den, fit.floor), fit.floor)
    return new if fixed is None else np.where(np.isnan(fixed), new, fixed)


def grad_w(g: np.ndarray, sums: tuple[np.ndarray, np.ndarray], d: np.ndarray, fit: Fit) -> np.ndarray:
    first, second = sums
    if fit.l2:
        return 2 * g.T @ (d @ second - first)
    return g.T @ (second[None, :] - first)


def grad_h(x: np.ndarray, d: np.ndarray, h: np.ndarray, fit: Fit) -> np.ndarray:
    grad = d.T @ (d @ h - x) if fit.l2 else d.sum(axis=0)[:, None] - d.T @ ratio(x, d @ h, fit.floor)
    if fit.mu:
        grad = grad + fit.mu / (h + fit.mu_eps)
    return grad + fit.ridge * h if fit.ridge else grad


def lipschitz_w(x: np.ndarray, g: np.ndarray, k: int, floor: float) -> float:
    """The bound of W's step with all of W and H at the floor: all entries of a row of the product are alike."""
    dh = g.sum(axis=1) * floor * floor * k
    return float(((k * floor * x / np.maximum(dh * dh, 1e-300)[:, None]).sum(axis=1) * floor).max())


def lipschitz_h(x: np.ndarray, g: np.ndarray, k: int, fit: Fit) -> float:
    row = g.sum(axis=1) * fit.floor
    dh = row * fit.floor * k
    top = (row[:, None] * x / np.maximum(dh * dh, 1e-300)[:, None] * (k * row)[:, None]).sum(axis=0).max()
    return float(top + 2 * fit.ridge + fit.mu * fit.mu_eps)


def step_w(w: np.ndarray, grad: np.ndarray, gamma: float, fit: Fit, fixed: np.ndarray | None = None) -> np.ndarray:
    new = w - grad / gamma
    if fit.simplex_w:
        rows = simplex_rows(fit, len(w))
        new[rows] += projection(new[rows], fit.floor, fit.simplex_tol)
    new = np.maximum(new, fit.floor)
    return new if fixed is None else np.where(np.isnan(fixed), new, fixed)


def step_h(h: np.ndarray, grad: np.ndarray, gamma: float, fit: Fit, fixed: np.ndarray | None = None) -> np.ndarray:
    new = h - grad / gamma
    if fit.simplex_h:
        new = new + projection(new, fit.floor, fit.simplex_tol)
    new = np.maximum(new, fit.floor)
    return new if fixed is None else np.where(np.isnan(fixed), new, fixed)


def loss(x: np.ndarray, d: np.ndarray, h: np.ndarray, fit: Fit) -> float:
    """The sum over these pixels of the objective."""
    dh = d @ h
    if fit.l2:
        value = 0.5 * ((dh - x) ** 2).sum()
    else:
        xs, dh = np.maximum(x, fit.floor), np.maximum(dh, fit.floor)
        value = (dh - xs * np.log(dh) + xs * np.log(xs) - xs).sum()
    if fit.mu:
        value += fit.mu * np.log(h + fit.mu_eps).sum()
    return float(value + 0.5 * fit.ridge * (h * h).sum())


def rescale(gram: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Factors of components for which H's columns add up to 1 as nearly as can be, from H H' and the sums of H."""
    f = np.linalg.pinv(gram) @ sums
    if (f <= 0).any():
        vals, vecs = np.linalg.eigh(gram)
        root = np.sqrt(np.maximum(vals, 0))[:, None] * vecs.T
        f = np.maximum(nnls(root, np.linalg.pinv(root.T) @ sums), 1e-10)
    return f


def relative_change(new: np.ndarray, old: np.ndarray, tol: float) -> float:
    gap = np.abs(new - old)
    return float((gap / (new + tol * gap.mean())).max())


def surrogate_gap(old: np.ndarray, new: np.ndarray, sigma: float, weight: float) -> float:
    """The majoriser of the ridge less the ridge."""
    kl = (old * np.log(old / new) - old + new).sum(axis=1)
    value = 2 * (old * new).sum() - (old * old).sum() + sigma * (new.max(axis=1) * kl).sum()
    return float(weight / 2 * (value - (new * new).sum()))


def factorise(x: np.ndarray, g: np.ndarray, fit: Fit, w: np.ndarray | None = None, h: np.ndarray | None = None, fixed_w: np.ndarray | None = None, fixed_h: np.ndarray | None = None, refresh: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """W, H and a report of a fit that fits in memory, as a block's. refresh: what G becomes after each step of W."""
    if (x < 0).any():
        raise ValueError("negative values")
    x = np.asarray(x, float)
    if fit.safe:
        empty = (x.sum(axis=0) == 0)[None, :] | (x.sum(axis=1) == 0)[:, None]
        x = np.where(empty, fit.floor, x)
    factor = fit.components / (x.mean() * x.shape[0]) if fit.normalise and x.mean() > 0 else 1.0
    x = x * factor
    w, h = start(x, g, fit, w, h)
    gradient = fit.algorithm == Algorithm.PROJECTED_GRADIENT
    steps = [lipschitz_h(x, g, w.shape[1], fit), lipschitz_w(x, g, w.shape[1], fit.floor)] if gradient else [fit.sigma, 0.0]
    size, trace = x.size, []
    first = before = loss(x, g @ w, h, fit) / size
    before = np.inf
    why = "max_iter"
    for _ in range(fit.max_iter):
        old_w, old_h, d = w, h, g @ w
        if gradient:
            grad = grad_h(x, d, h, fit)
            h = step_h(h, grad, steps[0], fit, fixed_h)
            if fit.line_search:
                gap = h - old_h
                bound = loss(x, d, old_h, fit) + (gap * grad).sum() + steps[0] * (gap * gap).sum()
                steps[0] *= 1 / 1.05 if bound - loss(x, d, h, fit) > 0 else 1.5
            grad = grad_w(g, w_sums(x, d, h, fit), d, fit)
            w = step_w(w, grad, steps[1], fit, fixed_w)
            if fit.line_search:
                gap = w - old_w
                bound = loss(x, d, h, fit) + (gap * grad).sum() + steps[1] * (gap * gap).sum()
                steps[1] *= 1 / 1.05 if bound - loss(x, g @ w, h, fit) > 0 else 1.5
        else:
            h = update_h(x, d, h, fit, fixed_h, sigma=steps[0])
            if fit.line_search and fit.ridge:
                steps[0] *= 1 / 1.05 if surrogate_gap(old_h, h, steps[0], fit.ridge) > 0 else 1.5
            w = update_w(w, g, w_sums(x, d, h, fit), fit, fixed_w, x.sum())
        g = refresh(w) if refresh else g
        now = loss(x, g @ w, h, fit) / size
        trace.append(now)
        if not fit.no_stop and (why := stopped(relative_change(w, old_w, fit.tol), relative_change(h, old_h, fit.tol), before, now, first, fit.tol)):
            break
        why, before = "max_iter", now
    if not fit.simplex_w and not fit.simplex_h:
        f = rescale(h @ h.T, h.sum(axis=1))
        w, h = w / f, h * f[:, None]
    report = {"iterations": len(trace), "loss": loss(x, g @ w, h, fit) / size, "trace": trace, "stopped": why}
    return w / factor, h, report


def stopped(change_w: float, change_h: float, before: float, now: float, first: float, tol: float) -> str:
    """Why a fit ends here, or an empty text."""
    if np.isnan(now):
        return "nan"
    if max(change_w, change_h) < tol:
        return "factors settled"
    if np.isfinite(before) and first and abs((before - now) / first) < tol:
        return "loss settled"
    return "loss rose" if now > before else ""

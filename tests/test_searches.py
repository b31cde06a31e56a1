"""Regimes, filters, episode leaders and fronts against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import episodes, fronts, regimes, stats
from tapeworks.plans.series import Series


def walk(x, pi, a, mu, sd):
    """Scaled forward and backward recursions, row by row."""
    n = len(pi)
    b = np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
    al, c = np.zeros((len(x), n)), np.zeros(len(x))
    for t in range(len(x)):
        al[t] = (pi if t == 0 else al[t - 1] @ a) * b[t]
        c[t] = al[t].sum()
        al[t] /= c[t]
    be = np.ones((len(x), n))
    for t in range(len(x) - 2, -1, -1):
        be[t] = a @ (b[t + 1] * be[t + 1]) / c[t + 1]
    g = al * be
    g /= g.sum(axis=1, keepdims=True)
    xi = np.zeros((n, n))
    for t in range(len(x) - 1):
        z = al[t][:, None] * a * (b[t + 1] * be[t + 1])
        xi += z / z.sum()
    return np.log(c).sum(), g, xi


def slow_fit(x, n, tol, rounds):
    parts = np.array_split(np.sort(x), n)
    pi, a = np.ones(n) / n, np.ones((n, n)) / n
    mu, sd = np.array([p.mean() for p in parts]), np.array([p.std() + 1e-8 for p in parts])
    last = -np.inf
    for k in range(rounds):
        ll, g, xi = walk(x, pi, a, mu, sd)
        pi, a = g[0], xi / xi.sum(axis=1, keepdims=True)
        mu = (g * x[:, None]).sum(axis=0) / g.sum(axis=0)
        sd = np.sqrt((g * (x[:, None] - mu) ** 2).sum(axis=0) / g.sum(axis=0)) + 1e-8
        if abs(ll - last) < tol:
            break
        last = ll
    return np.concatenate([pi, a.ravel(), mu, sd]), ll, k + 1


def slow_path(x, flat, n):
    pi, a, mu, sd = flat[:n], flat[n:n + n * n].reshape(n, n), flat[n + n * n:2 * n + n * n], flat[2 * n + n * n:]
    lb = -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd * np.sqrt(2 * np.pi))
    with np.errstate(divide="ignore"):
        v, la = np.log(pi) + lb[0], np.log(a)
    back = []
    for t in range(1, len(x)):
        q = v[:, None] + la
        back.append(q.argmax(axis=0))
        v = q.max(axis=0) + lb[t]
    out = [int(v.argmax())]
    for p in reversed(back):
        out.append(int(p[out[-1]]))
    return out[::-1]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(3)
    data = {}
    for k, n in (("a", 220), ("b", 150), ("c", 40)):
        data[k] = np.concatenate([rng.normal(0, 1, n - n // 3), rng.normal(2.5, 0.4, n // 3)])
    rows = [(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)] + [("b", 9999, None)]
    return spark.createDataFrame(rows, "k string, t int, x double").repartition(4), data


@pytest.mark.parametrize("chunk", [512, 50])
def test_regimes_one_chunk_and_many(spark, noisy, chunk):
    df, data = noisy
    rows, models = regimes.regimes(Series.of(df, ["k"], ["t"]), "x", max_states=3, rounds=6, rows=chunk)
    got = {r.k: r for r in models.collect()}
    assert set(got) == {"a", "b"}
    for k, r in got.items():
        best = None
        for n in (2, 3):
            flat, ll, took = slow_fit(data[k], n, 1e-6, 6)
            bic = -2 * ll + (n * (n - 1) + 2 * n + n - 1) * np.log(len(data[k]))
            if best is None or bic < best[0]:
                best = bic, n, flat, ll, took
        assert r.states == best[1] and r.rounds == best[4] and abs(r.ll - best[3]) < 1e-6 and abs(r.score - best[0]) < 1e-6
        assert np.allclose(r.theta, best[2], atol=1e-7)
        states = [x.state for x in rows.where(F.col("k") == k).orderBy("t").collect()]
        assert states == slow_path(data[k], np.array(r.theta), r.states)
    assert [(x.states, x.state) for x in rows.where("k = 'c'").collect()] == [(1, 0)] * 40


def test_regime_likelihood_does_not_fall(spark, noisy):
    df, data = noisy
    s = Series.of(df.where("x is not null"), ["k"], ["t"])
    chunks = regimes.chunked(s, "x", 32)
    now = regimes.starts(s, "x", [2, 3]).select("k", "states", "theta", F.lit(None).cast("double").alias("ll"), F.lit(0).alias("rounds"))
    seen = []
    for _ in range(2):
        sums = {(r.k, r.states): r.sums for r in regimes._round(chunks, now, ["k"]).collect()}
        for (k, n), v in sums.items():
            assert abs(sum(v[:n]) - len(data[k])) < 1e-8 and abs(sum(v[3 * n:3 * n + n * n]) - len(data[k]) + 1) < 1e-8
        now = spark.createDataFrame([tuple(r) for r in regimes.step(chunks, now, ["k"]).drop("settled").collect()], "k string, states int, theta array<double>, ll double, rounds int")
        seen.append({(r.k, r.states): r.ll for r in now.collect()})
    assert len(seen[0]) == 6 and all(b[m] >= a[m] - 1e-9 for a, b in zip(seen, seen[1:]) for m in a)


def test_hedge_ratio_plain_and_sliced(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, n in (("p", 300), ("q", 7), ("z", 60)):
        x = 100 + np.cumsum(rng.normal(0, 1, n))
        y = 3 + 1.7 * x + rng.normal(0, 0.3, n)
        m, p = np.array([0.0, 1.0]), np.eye(2)
        out = []
        for a, b in zip(y, x):
            p = p + 1e-5 * np.eye(2)
            h = np.array([1.0, b])
            gain = p @ h / (h @ p @ h + 1e-2)
            m = m + gain * (a - h @ m)
            keep = np.eye(2) - np.outer(gain, h)
            p = keep @ p @ keep.T + 1e-2 * np.outer(gain, gain)
            out.append((m[1], m[0]))
        want[k] = out if n >= 10 else [(1.0, 0.0)] * n
        rows += [(k, t, float(a), float(b)) for t, (a, b) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "k string, t int, y double, x double").repartition(5)
    for limits in ({}, {"max_rows": 50, "block_rows": 40}):
        s = Series.of(df, ["k"], ["t"], **limits)
        assert s.blocked == bool(limits)
        got = stats.hedge_ratio(s, "y", "x").df.orderBy("k", "t").collect()
        assert np.allclose([(r.hedge_ratio, r.intercept) for r in got], [v for k in "pqz" for v in want[k]], rtol=1e-6, atol=1e-6)


def greedy(rows, threshold):
    heads, out = {}, {}
    for key, i, v in sorted(rows, key=lambda r: r[1]):
        x = np.array(v, float) if v is not None else np.zeros(1)
        size = np.linalg.norm(x)
        lead = i
        if size:
            lead = next((j for j, y in heads.get(key, []) if x @ y / size >= threshold), i)
        if lead == i and size:
            heads.setdefault(key, []).append((i, x / size))
        out[key, i] = lead
    return out


def test_leaders_are_the_greedy_ones(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=(25, 12))
    for i in range(500):
        v = base[rng.integers(25)] + rng.choice([0.0, 0.15, 0.3, 0.45]) * rng.normal(size=12)
        rows.append((int(rng.integers(2)), i, [float(x) for x in v]))
    rows += [(0, 500 + k, [1.0] * 12) for k in range(60)] + [(0, 600, None), (0, 601, [0.0] * 12), (1, 602, [0.0] * 12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, v array<double>").repartition(4)
    want = greedy(rows, 0.95)
    for block in (2048, 40):
        got = {(r.g, r.i): r.leader for r in episodes.leaders(df, "g", "i", "v", block=block).collect()}
        assert got == want
    assert len(set(want.values())) < 450 and episodes.recall(0.95, 12, 24) > 0.999
    assert episodes.leaders(df.limit(0), "g", "i", "v").count() == 0


def test_leader_candidates(spark):
    """Share of the pairs at the threshold that share a band."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack((a, b)))]
    keys = {r.i: set(r._b) for r in episodes.signatures(spark.createDataFrame(rows, "i int, v array<double>"), "v", 12, 24).collect()}
    found = sum(bool(keys[i] & keys[i + 1500]) for i in range(1500))
    assert found >= 0.99 * 1500


def test_merged_outcomes(spark):
    rows = [(0, 1, 1, {"p": 1.0, "q": 4.0}, ["x"], 1), (0, 2, 1, {"p": 3.0, "z": 9.0}, ["y", "x"], 2), (0, 5, 5, {}, [], 0)]
    df = spark.createDataFrame([(*r[:2], *r[3:]) for r in rows], "g int, i int, o map<string,double>, t array<string>, n int")
    led = spark.createDataFrame([r[:3] for r in rows], "g int, i int, leader int")
    got = {r.leader: r for r in episodes.merged(df, led, "g", "i", "o", "t", "n").collect()}
    assert got[1].o == {"p": 2.0, "q": 2.0} and got[1].t == ["x", "y"] and (got[1].members, got[1].n) == (2, 3)
    assert got[5].o is None and got[5].t == [] and got[5].members == 1


@pytest.mark.parametrize("goals, size", [(5, 2048), (5, 60), (2, 25)])
def test_front_numbers(spark, goals, size, monkeypatch):
    rng = np.random.default_rng(goals)
    x = rng.integers(0, 9, (260, goals)).astype(float)
    left, want, k = set(range(len(x))), {}, 0
    while left:
        k += 1
        top = {i for i in left if not any((x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in left)}
        want |= dict.fromkeys(top, k)
        left -= top
    names = [f"g{k}" for k in range(goals)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(-1, None, *[1.0] * (goals - 1))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{g} double" for g in names)).repartition(3)
    monkeypatch.setattr(fronts, "VISITORS", 16)
    got = {r.i: r.front for r in fronts.fronts(df, names, size).collect()}
    assert got == want | {-1: None}
    assert fronts.fronts(df.limit(0), names).count() == 0


@pytest.mark.parametrize("size", [5000, 60, 7])
def test_first_front_is_found_alone(spark, monkeypatch, size):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(0, 1, (500, 3)), 1)
    x[10] = x[20]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 9.0, 9.0), (901, float("nan"), 9.0, 9.0)]
    rounds = []
    whole = fronts._round
    monkeypatch.setattr(fronts, "_round", lambda *a: rounds.append(1) or whole(*a))
    names = ["p", "q", "r"]
    df = spark.createDataFrame(rows, "i int, p double, q double, r double").repartition(3)
    got = sorted(r.i for r in fronts.undominated(df, names, size).collect())
    assert got == [i for i in range(500) if not ((x >= x[i]).all(axis=1) & (x > x[i]).any(axis=1)).any()]
    assert len(rounds) <= 1 and fronts.undominated(df.limit(0), names).count() == 0


def test_fronts_take_steps_by_slices_not_by_fronts(spark, monkeypatch):
    jobs, store = [], fronts.checkpointed
    monkeypatch.setattr(fronts, "checkpointed", lambda df: jobs.append(1) or store(df))
    df = spark.createDataFrame([(float(i), float(i // 2)) for i in range(300)], "p double, q double").repartition(3)
    got = {r.p: r.front for r in fronts.fronts(df, ["p", "q"], 100).collect()}
    assert got == {float(i): 300 - i for i in range(300)} and len(jobs) <= 8


def test_unlike_candidates_are_told_by_their_signs(spark):
    rng = np.random.default_rng(16)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack((a, b)))]
    got = {r.i: r for r in episodes.signatures(spark.createDataFrame(rows, "i int, v array<double>"), "v", 12, 24).collect()}
    differ = lambda i, j: sum((p ^ q).bit_count() for p, q in zip(got[i]._s, got[j]._s))
    most = episodes.reach(0.95, 288)
    assert all(differ(i, i + 400) <= most for i in range(400))
    unlike = [differ(i, j) for i in range(400) for j in range(i) if set(got[i]._b) & set(got[j]._b)]
    assert len(unlike) > 50 and sum(d <= most for d in unlike) < 0.05 * len(unlike)


def test_readings_in_pieces_equal_sums_over_all_paths(monkeypatch):
    import itertools

    monkeypatch.setattr(regimes, "ROWS", 2)
    rng = np.random.default_rng(3)
    values, n = [rng.normal(size=k) for k in (4, 1, 5, 3, 2)], 2
    first = np.array([True, True, False, False, True])
    flat = np.hstack((np.full((5, n), 0.5), rng.dirichlet(np.ones(n), (5, n)).reshape(5, -1), rng.normal(size=(5, n)), rng.uniform(0.5, 2, (5, n))))
    th, before, after = regimes.Theta(flat, n), rng.dirichlet(np.ones(n), 5), rng.dirichlet(np.ones(n), 5)
    got = regimes.readings(regimes.Chunks(values, first), th, before, after)
    for s, x in enumerate(values):
        dens = np.exp(-0.5 * ((x[:, None] - th.mu[s]) / th.sd[s]) ** 2) / th.sd[s] / np.sqrt(2 * np.pi)
        begin = th.pi[s] if first[s] else before[s] @ th.a[s]
        g, moves, start, all_, plain = np.zeros((len(x), n)), np.zeros((n, n)), np.zeros(n), 0.0, 0.0
        for path in itertools.product(range(n), repeat=len(x)):
            w = begin[path[0]] * np.prod([dens[t, k] for t, k in enumerate(path)]) * np.prod([th.a[s][i, j] for i, j in itertools.pairwise(path)])
            plain, w = plain + w, w * after[s][path[-1]]
            all_ += w
            for t, k in enumerate(path):
                g[t, k] += w
            for i, j in itertools.pairwise(path):
                moves[i, j] += w
        g, moves = g / all_, moves / all_
        if first[s]:
            start = g[0]
        else:
            pair = before[s][:, None] * th.a[s] * (g[0] / begin)
            moves += pair
        d = x[:, None] - th.mu[s]
        want = np.concatenate((g.sum(axis=0), (g * d).sum(axis=0), (g * d * d).sum(axis=0), moves.ravel(), start, [np.log(plain)]))
        assert np.allclose(got[s], want, rtol=1e-9)

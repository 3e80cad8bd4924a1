import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textorigin.operators import dynamics as D, scale as S, surprise as L, transition as X

RNG = np.random.default_rng(11)
SEQS = {"const": [2.0] * 25, "empty": [], "one": [1.5], "two": [1.0, 3.0], "n19": RNG.random(19).tolist(), "n20": RNG.random(20).round(3).tolist(), "ties": [1.0, 2.0, 1.0, 2.0, 2.0, 0.0] * 6, "long": (RNG.random(300) * 4).round(4).tolist()}


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(k, v) for k, v in SEQS.items()], "id string, x array<double>").cache()


def profile(states, n):
    """Transition profile by direct counting."""
    if not len(states):
        return {}
    pairs = Counter(zip(states, states[1:]))
    total = max(len(states) - 1, 0)
    d = np.diff(states)
    entropy = lambda counts: -sum(c / sum(counts) * math.log2(c / sum(counts)) for c in counts if c)
    runs, cur = {0: [], n - 1: []}, {0: 0, n - 1: 0}
    for s in list(states) + [None]:
        for k in runs:
            if s == k:
                cur[k] += 1
            elif cur[k]:
                runs[k].append(cur[k])
                cur[k] = 0
    m = np.zeros((n, n))
    for (a, b), c in pairs.items():
        m[a, b] = c
    rows = m.sum(1, keepdims=True)
    mod = np.sort(np.abs(np.linalg.eigvals(np.divide(m, rows, out=np.zeros_like(m), where=rows > 0))))
    out = {f"trans_{i}_to_{j}": pairs[(i, j)] / total if total else None for i in range(n) for j in range(n)}
    out |= {"transition_entropy": entropy(list(pairs.values())) if total else None, "self_transition_rate": (d == 0).mean() if total else None, "large_jump_rate": (abs(d) >= 2).mean() if total else None,
            "high_loss_burst_density": np.mean(np.array(states) == n - 1), "low_loss_run_length_mean": np.mean(runs[0]) if runs[0] else 0.0, "high_loss_run_length_mean": np.mean(runs[n - 1]) if runs[n - 1] else 0.0,
            "state_sequence_entropy": entropy(list(Counter(states).values())), "transition_spectral_gap": 1 - mod[-2], "token_count": float(len(states))}
    return out


def check(row, prefix, want):
    for k, v in want.items():
        got = row[f"{prefix}_{k}"]
        assert (got is None and v is None) or math.isclose(got, v, abs_tol=1e-7), (row["id"], prefix, k, got, v)


def test_transition_profiles(spark, seqs):
    bins = {n: np.quantile(np.concatenate([v for v in SEQS.values() if v]), [i / n for i in range(1, n)]).tolist() for n in (3, 5, 7)}
    fitted = X.fit_bins(seqs.select(F.explode("x").alias("v")), ["v"])["v"]
    assert all(np.allclose(fitted[n], bins[n]) for n in bins)
    rows = {r["id"]: r for r in X.formal_profiles(seqs, "x", bins, "m").collect()}
    for k, v in SEQS.items():
        for n in (3, 5, 7):
            check(rows[k], f"m_lossq{n}", profile(np.clip(np.searchsorted(bins[n], v, side="right"), 0, n - 1).tolist() if v else [], n))
            rank = pd.Series(v, dtype=float).mul(-1).rank(pct=True)
            check(rows[k], f"m_probrank{n}", profile(np.clip(np.floor(rank * n), 0, n - 1).astype(int).tolist(), n))
    assert rows["empty"]["m_lossq3_token_count"] is None and rows["one"]["m_lossq3_trans_0_to_0"] is None


def test_profiles_can_be_filtered(spark, seqs):
    """Conditions on profile columns, which the optimiser moves as far down as it can."""
    bins = {"raw": {n: [1.0] * (n - 1) for n in (3, 5, 7)}, "zscore": {n: [0.0] * (n - 1) for n in (3, 5, 7)}}
    tables = {
        "m_raw_lossq3_token_count": X.full_profiles(seqs, "x", bins, "m"), "m_lossq5_token_count": X.formal_profiles(seqs, "x", bins["raw"], "m"),
        "m_lossq_token_count": X.own_profiles(seqs, "x", "m"), "v_q5_token_count": X.profiles(seqs, {"v_q5": (X.states_from_bins(F.col("x"), [1.0]), 5)}),
        "w_q3_token_count": X.long_profiles(seqs.select("id", F.posexplode("x").alias("pos", "v")), "id", "pos", "v", {3: [0.5, 1.0]}, "w"),
    }
    for c, table in tables.items():
        gap = c.replace("token_count", "transition_spectral_gap")
        assert table.filter((F.col(c) > 19) & (F.col(gap) >= 0)).select("id").count() == 4, c
        assert table.filter(F.col(c).isNull()).count() == (0 if c.startswith("w") else 1)


def test_profiles_by_definition(spark, seqs):
    cuts = {"a": [0.5, 1.0, 1.5, 2.0, 2.5, 3.0], "b": [1.0, 1.1, 1.2, 1.3, 1.4, 1.5]}
    bins = {d: {k: {n: c[: n - 1] for n in (3, 5, 7)} for k in ("raw", "zscore")} for d, c in cuts.items()}
    got = X.full_profiles_by_definition(seqs, "x", bins, "m")
    show = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for d, b in bins.items():
        assert show(got.filter(F.col("train_name") == d).drop("train_name")) == show(X.full_profiles(seqs, "x", b, "m"))


def test_own_quantile_states(spark, seqs):
    rows = {r["id"]: r["s"] for r in seqs.select("id", X.states_from_own_quantiles(F.col("x"), 5).alias("s")).collect()}
    for k, v in SEQS.items():
        want = [] if not v else [0] * len(v) if max(v) == min(v) else np.searchsorted(np.quantile(v, [0.2, 0.4, 0.6, 0.8]), v, side="right").tolist()
        assert rows[k] == want


def test_long_table_profile_equals_array_profile_even_when_split(spark, seqs):
    long = seqs.select("id", F.posexplode("x").alias("pos", "v"))
    bins = {5: [0.5, 1.0, 2.0, 3.0]}
    arrays = {r["id"]: r.asDict() for r in X.profiles(seqs, {"v_q5": (X.states_from_bins(F.col("x"), bins[5]), 5)}).collect()}
    for _ in (1,):
        for r in X.long_profiles(long, "id", "pos", "v", bins, "v").collect():
            for k, v in r.asDict().items():
                assert v == arrays[r["id"]][k] or math.isclose(v, arrays[r["id"]][k], abs_tol=1e-12)


def koopman(v, mode, bins):
    """One observable's operator features straight from the matrix definitions."""
    s = pd.Series(v, dtype=float)
    if mode == D.NORMAL:
        sd = s.std(ddof=0)
        s = (s - s.mean()) / (sd if sd > 0 else 1)
    if mode.startswith("state"):
        n = len(bins) + 1
        st = np.searchsorted(bins, v, side="right")
        delta = np.diff(st, prepend=st[0])
        z = np.vstack([np.eye(n)[st].T, delta, abs(delta)])
    else:
        roll = lambda w: [s.rolling(w, min_periods=1, center=True).mean(), s.rolling(w, min_periods=2, center=True).std().fillna(0)]
        delta = np.diff(s, prepend=s.iloc[0])
        z = np.vstack([s, delta, abs(delta), *roll(5), *roll(11)])
    x, y = z[:, :-1], z[:, 1:]
    k = (y @ x.T) @ np.linalg.pinv(x @ x.T + 1e-3 * np.eye(len(z)))
    err, eig, sv = y - k @ x, np.abs(np.linalg.eigvals(k)), np.linalg.svd(k, compute_uv=False)
    vel = np.linalg.norm(np.diff(z, axis=1), axis=0)
    return {"spectral_radius": eig.max(), "eig_abs_q75": np.quantile(eig, 0.75), "koopman_trace": np.trace(k), "koopman_nuclear_norm": sv.sum(), "low_rank_energy_ratio": (sv[:2] ** 2).sum() / (sv**2).sum(),
            "one_step_reconstruction_mse": np.mean(err**2), "one_step_reconstruction_mae": np.abs(err).mean(), "normalized_reconstruction_error": np.linalg.norm(err) / np.linalg.norm(y),
            "reconstruction_error_std": np.linalg.norm(err, axis=0).std(), "mean_state_velocity": vel.mean(), "std_state_acceleration": np.linalg.norm(np.diff(z, n=2, axis=1), axis=0).std(), "token_count": float(len(v)), "observable_dim": float(len(z))}


def test_koopman_features(spark, seqs):
    bins = {5: [0.5, 1.0, 2.0, 3.0], 7: [0.5, 1.0, 1.5, 2.0, 2.5, 3.0]}
    df = D.koopman_features(seqs, "x", "m", bins).cache()
    assert len(df.columns) == 1 + 4 * 39
    rows = {r["id"]: r for r in df.collect()}
    for mode in (D.RAW, D.NORMAL, "state_onehot5_observable", "state_onehot7_observable"):
        n = int(mode[12]) if mode.startswith("state") else 5
        for k in ("n20", "long", "ties"):
            for name, v in koopman(SEQS[k], mode, bins[n]).items():
                assert math.isclose(rows[k][f"koopman_m_{mode}_{name}"], v, rel_tol=1e-5, abs_tol=1e-6), (k, mode, name)
        for k in ("empty", "two", "n19"):
            assert rows[k][f"koopman_m_{mode}_spectral_radius"] is None and rows[k][f"koopman_m_{mode}_mean_state_velocity"] is None
            assert rows[k][f"koopman_m_{mode}_token_count"] == len(SEQS[k])
    info = D.koopman_manifest(df, f"koopman_m_{D.RAW}_token_count")
    assert info["short_sequence_count"] == 4 and info["n_features"] == 156
    assert D.short_ids(df, f"koopman_m_{D.RAW}_token_count").count() == 4


def test_global_operator_matches_least_squares(spark, seqs):
    long = D.deep_observable(seqs, "x", [0.5, 1.0, 2.0, 3.0])
    scaled = D.scaled_steps(long, D.fit_scaler(long, D.DEEP)).cache()
    docs = {r["id"]: np.array(r["x"]) for r in scaled.collect() if r["x"] is not None}
    assert set(docs) == {"n20", "ties", "long", "const"} and scaled.count() == len(SEQS)
    zx, zy = np.vstack([D.lift(x)[:-1] for x in docs.values()]), np.vstack([D.lift(x)[1:] for x in docs.values()])
    k = D.global_operator(scaled)
    assert np.allclose(k, zy.T @ zx @ np.linalg.pinv(zx.T @ zx + 1e-3 * np.eye(65)), atol=1e-5)
    r = {x["id"]: x for x in D.residual_features(scaled, k).collect()}
    z = D.lift(docs["long"])
    assert math.isclose(r["long"]["deep_dmd_multistep_prediction_mse_k4"], np.mean((z[4:] - z[:-4] @ np.linalg.matrix_power(k, 4).T) ** 2), rel_tol=1e-6)
    assert math.isclose(r["long"]["deep_dmd_latent_norm_mean"], np.linalg.norm(z, axis=1).mean(), rel_tol=1e-9)


def test_scale_response_with_missing_scales(spark):
    rows = [("all", 4.0, 3.0, 3.5, 1.0), ("gap", 4.0, None, 3.5, None), ("lone", None, 2.0, None, None), ("none", None, float("nan"), None, float("inf")), ("three", 1.0, 2.0, None, 4.0), ("flat", 2.0, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, ng1__ppl double, ng2__ppl double, ng3__ppl double, ng4__ppl double")
    got = {r["id"]: r for r in S.scale_response(df, metrics=["ppl"]).collect()}
    for name, *ys in rows:
        pts = [(x, y) for x, y in enumerate(ys) if y is not None and np.isfinite(y)]
        xs, v = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float)
        g = lambda k: got[name][f"scale_ppl_{k}"]
        if len(v) >= 2:
            slope, icept = np.polyfit(xs, v, 1)
            assert math.isclose(g("global_slope"), slope, abs_tol=1e-9) and math.isclose(g("global_intercept"), icept, abs_tol=1e-9)
            assert math.isclose(g("response_area"), np.sum((v[1:] + v[:-1]) / 2 * np.diff(xs)), abs_tol=1e-9)
            assert math.isclose(g("monotonic_decrease_ratio"), (np.diff(v) < 0).mean())
        else:
            assert g("global_slope") is None and g("response_area") is None
        if len(v) >= 3:
            assert math.isclose(g("response_curvature"), np.gradient(np.gradient(v, xs), xs).mean(), abs_tol=1e-9)
        else:
            assert g("response_curvature") is None
        assert (g("min_scale_index"), g("max_scale_index")) == ((xs[np.argmin(v)], xs[np.argmax(v)]) if len(v) else (None, None))
    assert got["all"]["scale_ppl_num_direction_changes"] == 2 and got["flat"]["scale_ppl_num_direction_changes"] is None and got["flat"]["scale_ppl_global_r2"] is None
    assert math.isclose(got["all"]["scale_ppl_saturation_ratio_ng3_ng4"], 2.5 / (1.0 + 1e-8)) and got["gap"]["scale_ppl_slope_ng1_to_ng2"] is None


def test_gram_model_against_counts(spark):
    texts = {"1": "a b a b c", "2": "a b d", "3": "z", "4": "b a q b"}
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    train = df.filter("id < '3'")
    got = {r["id"]: r for r in L.GramModel.fit(train).losses(df).collect()}
    words = [t.split() for k, t in texts.items() if k < "3"]
    grams = lambda n: Counter(tuple(w[i - n + 1 : i + 1]) for w in words for i in range(n - 1, len(w)))
    counts = {n: grams(n) for n in (1, 2, 3, 4)}
    for k, t in texts.items():
        w = t.split()
        for n in (1, 2, 3, 4):
            want = []
            for i in range(1, len(w)):
                p = 0.01 / (len(counts[1]) + 1)
                for m in range(1, n + 1):
                    if i >= m - 1:
                        g = tuple(w[i - m + 1 : i + 1])
                        total = sum(c for x, c in counts[m].items() if x[:-1] == g[:-1])
                        p += 0.99 * 2 ** (m - 1) / (2**n - 1) * (counts[m][g] / total if total else 0)
                want.append(round(-math.log(p), 6))
            assert np.allclose(got[k][f"ng{n}"], want) if want else got[k][f"ng{n}"] == []
    s = {r["id"]: r for r in L.loss_statistics(L.GramModel.fit(train).losses(df)).collect()}
    assert s["3"]["ng1_ppl"] is None and s["1"]["ng1_token_count_used"] == 4
    v = np.array(got["1"]["ng3"])
    assert math.isclose(s["1"]["ng3_loss_skewness"], (((v - v.mean()) / v.std()) ** 3).mean(), abs_tol=1e-9)


def test_document_operators_solve_their_equations(seqs):
    rows = {r["id"]: r for r in D.document_operators(seqs, "x").collect()}
    grams = {r["id"]: r for r in D.gram_sums(seqs, "x").collect()}
    for k, v in SEQS.items():
        r = rows[k]
        assert r["steps"] == len(v)
        if len(v) < 20:
            assert r["operator"] is None and r["residual"] is None
            continue
        m, xx, yx = (np.reshape(a, (7, 7)) for a in (r["operator"], grams[k]["xx"], grams[k]["yx"]))
        want = np.linalg.solve(xx + 1e-3 * np.eye(7), yx.T).T
        assert np.allclose(m, want, atol=1e-5) and r["residual"] < 1e-6
    wrong = D.residual_share(np.zeros((7, 7)), np.eye(7), np.eye(7))
    assert wrong == 1.0


@pytest.mark.parametrize("frequent", [1, 1 << 16])
def test_scores_do_not_depend_on_the_broadcast_table(spark, monkeypatch, frequent):
    """All n-grams looked up from the broadcast table, or only words that are all words; one hot word, repeats, a long and two short texts."""
    texts = ["the " * 50, "the cat the dog the cat", "", "one", "a b", " ".join(f"{chr(97 + i % 26)}x the" for i in range(900))]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    monkeypatch.setattr(L, "FREQUENT", frequent)
    got = {r["id"]: r for r in L.GramModel.fit(df).losses(df).collect()}
    words = [t.split() for t in texts]
    counts = {n: Counter(tuple(w[i - n + 1 : i + 1]) for w in words for i in range(n - 1, len(w))) for n in range(1, 5)}
    total, prefixes = sum(counts[1].values()), {n: Counter() for n in range(2, 5)}
    for n in prefixes:
        for g, c in counts[n].items():
            prefixes[n][g[:-1]] += c
    p = lambda g: counts[len(g)][g] / (total if len(g) == 1 else prefixes[len(g)][g[:-1]])
    for i, w in enumerate(words):
        if not w:
            assert str(i) not in got
            continue
        for n in range(1, 5):
            want = []
            for at in range(1, len(w)):
                mixed = L.FLOOR / (len(counts[1]) + 1)
                for k in range(1, n + 1):
                    if at >= k - 1:
                        mixed += (1 - L.FLOOR) * 2 ** (k - 1) / (2**n - 1) * p(tuple(w[at - k + 1 : at + 1]))
                want.append(-math.log(mixed))
            assert np.allclose(got[str(i)][f"ng{n}"], want, atol=1e-6) and len(got[str(i)][f"ng{n}"]) == len(want)

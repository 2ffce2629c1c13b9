"""DuckDB twins of the clustering operators: Lloyd's algorithm, silhouette and
principal components as SQL over a table of points."""

from __future__ import annotations

# Fixed values of the twin: seeds 42 to 51, k up to 6, forty Lloyd steps.
SEEDS, K_MAX, STEPS = (42, 52), 6, 40


def _off(a: str, b: str, cols: list[str]) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def kmeans_ctes(points: str, key: str, cols: list[str]) -> list[tuple[str, str]]:
    """CTEs that end in ``sweep`` (k, inertia), ``chosen`` (k) and ``labels``
    (key, regime of the chosen k); ``points`` names a table of key and cols."""
    vals, same = ", ".join(cols), "k, seed, j"
    ctes = [
        ("runs", f"SELECT CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS seed FROM range(1, least({K_MAX}, greatest(1, (SELECT count(*) FROM {points}) - 1)) + 1) a(k), "
                 f"range({SEEDS[0]}, {SEEDS[1]}) b(s)"),
        ("c0", f"SELECT k, seed, j, {vals} FROM (SELECT k, seed, row_number() OVER (PARTITION BY k, seed ORDER BY md5(concat(seed, ':', {key}))) AS j, "
               f"{vals} FROM runs, {points}) r WHERE j <= k")]
    for i in range(STEPS):
        near = (f"SELECT c.k, c.seed, p.{key}, arg_min(c.j, ({_off('c', 'p', cols)}, c.j)) AS j FROM c{i} c, {points} p "
                f"GROUP BY c.k, c.seed, p.{key}")
        ctes.append((f"m{i}", f"SELECT {same}, " + ", ".join(f"avg({c}) AS {c}" for c in cols)
                     + f" FROM ({near}) n JOIN {points} USING ({key}) GROUP BY {same}"))
        ctes.append((f"c{i + 1}", f"SELECT {same}, " + ", ".join(f"coalesce(m.{c}, c.{c}) AS {c}" for c in cols)
                     + f" FROM c{i} c LEFT JOIN m{i} m USING ({same})"))
    last = f"c{STEPS}"
    return ctes + [
        ("costs", f"SELECT k, seed, sum(d) AS inertia FROM (SELECT c.k, c.seed, p.{key}, min({_off('c', 'p', cols)}) AS d "
                  f"FROM {last} c, {points} p GROUP BY c.k, c.seed, p.{key}) d GROUP BY k, seed"),
        ("won", "SELECT k, arg_min(seed, (round(inertia, 9), seed)) AS seed, arg_min(inertia, (round(inertia, 9), seed)) AS inertia FROM costs GROUP BY k"),
        ("sweep", "SELECT k, inertia FROM won"),
        ("drops", "SELECT k, inertia - lag(inertia) OVER (ORDER BY k) AS fall FROM sweep"),
        ("chosen", "SELECT CASE WHEN count(fall) >= 2 AND count(*) >= 3 THEN least(arg_min(k, (fall, k)) FILTER (WHERE k IN (2, 3)), 4) ELSE 3 END AS k FROM drops"),
        ("centres", f"SELECT row_number() OVER (ORDER BY {vals}) - 1 AS label, {vals} FROM {last} JOIN won USING (k, seed) WHERE k = (SELECT k FROM chosen)"),
        ("labels", f"SELECT p.{key}, CAST(arg_min(c.label, ({_off('c', 'p', cols)}, c.label)) AS INTEGER) AS regime FROM centres c, {points} p GROUP BY p.{key}"),
    ]


def silhouette_sql(points: str, key: str, cols: list[str]) -> str:
    """One row ``silhouette`` of the labels under Euclidean distance."""
    return (f"SELECT avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / NULLIF(greatest(a, b), 0), 0) END) AS silhouette FROM ("
            f"SELECT {key}, max(CASE WHEN mine = other THEN n END) AS n, max(CASE WHEN mine = other THEN total / NULLIF(n - 1, 0) END) AS a, "
            f"min(CASE WHEN mine <> other THEN total / n END) AS b FROM (SELECT l.{key}, l.regime AS mine, m.regime AS other, "
            f"sum(sqrt({_off('p', 'q', cols)})) AS total, count(*) AS n FROM labels l JOIN {points} p USING ({key}), "
            f"labels m JOIN {points} q ON m.{key} = q.{key} GROUP BY l.{key}, l.regime, m.regime) x GROUP BY {key}) s")


def chained(ctes: list[tuple[str, str]], body: str) -> str:
    """WITH text whose steps are each computed once."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if '(' in n else 'MATERIALIZED '}({q})" for n, q in ctes) + "\n" + body


def pca_ctes(points: str, cols: list[str], steps: int = 400) -> list[tuple[str, str]]:
    """CTEs ``pc1v``, ``pc2v`` (loadings) and ``spread`` (variances): power
    iteration on the covariance matrix, the second after deflation."""
    cov = [(f"cov_{i}_{j}", f"covar_samp({a}, {b})") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    n = range(len(cols))
    ctes = [("cov1", "SELECT " + ", ".join(f"{e} AS {name}" for name, e in cov) + f" FROM {points}")]
    for which, matrix in (("1", "cov1"), ("2", "cov2")):
        step = [" + ".join(f"m.cov_{i}_{j} * v{j}" for j in n) for i in n]
        ctes.append((f"it{which}(s, " + ", ".join(f"v{i}" for i in n) + ")",
                     "SELECT 0, " + ", ".join(f"CAST({1.0 + 0.37 * i} AS DOUBLE)" for i in n) + " UNION ALL SELECT s + 1, "
                     + ", ".join(f"w{i} / sqrt({' + '.join(f'w{j} * w{j}' for j in n)})" for i in n)
                     + " FROM (SELECT s, " + ", ".join(f"{e} AS w{i}" for i, e in enumerate(step)) + f" FROM it{which}, {matrix} m WHERE s < {steps}) w"))
        big = "greatest(" + ", ".join(f"abs(v{i})" for i in n) + ")"
        sign = "CASE " + " ".join(f"WHEN abs(v{i}) = {big} THEN sign(v{i})" for i in n) + " END"
        ctes.append((f"pc{which}v", "SELECT " + ", ".join(f"v{i} * ({sign}) AS v{i}" for i in n)
                     + ", " + " + ".join(f"v{i} * ({e})" for i, e in enumerate(step)) + f" AS spread FROM it{which}, {matrix} m WHERE s = {steps}"))
        if which == "1":
            ctes.append(("cov2", "SELECT " + ", ".join(f"cov_{i}_{j} - spread * v{i} * v{j} AS cov_{i}_{j}" for i in n for j in n) + " FROM cov1, pc1v"))
    ctes.append(("whole", "SELECT " + " + ".join(f"cov_{i}_{i}" for i in n) + " AS total FROM cov1"))
    return ctes

"""DuckDB twin of the tree trainer: the same boosting written as SQL.

A small configuration (two rounds of depth 2, eight bins, no draws) is trained
by CTEs over a training table, one CTE a step: cut points, whole-number
gradients, split sums, best splits, row paths, leaf values.  Nothing is taken
from the trainer but the parameters, which are repeated here.
"""

from __future__ import annotations

# Fixed values of the twin's configuration.
ROUNDS, DEPTH, BINS, RATE, L1, L2, LEAST = 2, 2, 8, 0.05, 0.1, 1.0, 3


def _soft(g: str) -> str:
    return f"(sign({g}) * greatest(abs({g}) - CAST('{L1}' AS DOUBLE), CAST(0 AS DOUBLE)))"


def _part(g: str, h: str) -> str:
    return f"({_soft(g)} * {_soft(g)} / ({h} + CAST('{L2}' AS DOUBLE)))"


def training_ctes(rows: str, features: list[str]) -> list[tuple[str, str]]:
    """CTEs that end in ``best`` (tree, path, f, cut, gain), ``ends`` (tree,
    path, value, n_rows: all nodes) and ``base``; ``rows`` selects company,
    year, the features and the target ``y`` of the training rows."""
    cuts = " UNION ALL ".join(
        f"SELECT {i} AS f, unnest(list_sort(list_distinct(quantile_disc({c}, [{', '.join(str(q / BINS) for q in range(1, BINS))}])))) "
        f"AS cut, max({c}) AS most FROM tr" for i, c in enumerate(features, 1))
    ctes = [
        ("tr", f"SELECT row_number() OVER (ORDER BY company, year) AS rid, * FROM ({rows}) r"),
        ("cuts", f"SELECT f, cut FROM ({cuts}) c WHERE cut < most"),
        ("k", "SELECT CAST(1073741824 AS DOUBLE) / max(abs(y)) AS scale FROM tr"),
        ("base", "SELECT CAST(sum(CAST(round_even(y * scale, 0) AS BIGINT)) AS DOUBLE) / any_value(scale) / count(*) AS base FROM tr, k"),
        ("s0", "SELECT rid, y, base AS pred, [" + ", ".join(features) + "] AS x FROM tr, base"),
    ]
    for t in range(ROUNDS):
        ctes.append((f"n{t}_0", f"SELECT rid, x, '' AS path, CAST(round_even((pred - y) * scale, 0) AS BIGINT) AS g FROM s{t}, k"))
        for d in range(DEPTH):
            now = f"n{t}_{d}"
            ctes.append((f"h{t}_{d}",
                         f"SELECT path, f, cut, sum(CASE WHEN x[f] <= cut THEN g ELSE 0 END) / any_value(scale) AS gl, "
                         f"CAST(count_if(x[f] <= cut) AS DOUBLE) AS hl, sum(CASE WHEN x[f] <= cut THEN 0 ELSE g END) / any_value(scale) AS gr, "
                         f"CAST(count_if(x[f] > cut) AS DOUBLE) AS hr, sum(g) / any_value(scale) AS g, CAST(count(*) AS DOUBLE) AS h "
                         f"FROM {now}, cuts, k WHERE length(path) = {d} GROUP BY path, f, cut"))
            ctes.append((f"b{t}_{d}",
                         f"SELECT {t} AS tree, path, f, cut, gain FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, cut) AS o "
                         f"FROM (SELECT path, f, cut, {_part('gl', 'hl')} + {_part('gr', 'hr')} - {_part('g', 'h')} AS gain FROM h{t}_{d} "
                         f"WHERE hl >= {LEAST} AND hr >= {LEAST}) c WHERE gain > 1e-12) c WHERE o = 1"))
            ctes.append((f"n{t}_{d + 1}",
                         f"SELECT n.rid, n.x, n.path || CASE WHEN b.f IS NULL THEN '' WHEN n.x[b.f] <= b.cut THEN 'L' ELSE 'R' END AS path, n.g "
                         f"FROM {now} n LEFT JOIN b{t}_{d} b ON n.path = b.path"))
        every = " UNION ALL ".join(f"SELECT DISTINCT rid, path, g FROM n{t}_{d}" for d in range(DEPTH + 1))
        value = f"-CAST('{RATE}' AS DOUBLE) * {_soft('sg')} / (n + CAST('{L2}' AS DOUBLE))"
        ctes.append((f"e{t}", f"SELECT {t} AS tree, path, {value} AS value, n AS n_rows FROM (SELECT path, sum(g) / any_value(scale) AS sg, "
                              f"count(*) AS n FROM (SELECT DISTINCT * FROM ({every}) u) u, k GROUP BY path) v"))
        ctes.append((f"s{t + 1}", f"SELECT s.rid, s.y, s.pred + e.value AS pred, s.x FROM s{t} s JOIN n{t}_{DEPTH} n USING (rid) "
                                  f"JOIN e{t} e ON e.path = n.path"))
    ctes.append(("best", " UNION ALL ".join(f"SELECT * FROM b{t}_{d}" for t in range(ROUNDS) for d in range(DEPTH))))
    ctes.append(("ends", " UNION ALL ".join(f"SELECT * FROM e{t}" for t in range(ROUNDS))))
    return ctes


def predicted_ctes(source: str, features: list[str], name: str = "walked") -> list[tuple[str, str]]:
    """CTE with ``source``'s rows and their ``predicted`` value under the
    ensemble of :func:`training_ctes`; missing values count as 0."""
    x = "[" + ", ".join(f"coalesce({c}, 0)" for c in features) + "]"
    ctes = [(f"{name}_x", f"SELECT *, {x} AS x, " + ", ".join("'' AS p%d" % t for t in range(ROUNDS)) + f" FROM {source}")]
    last = f"{name}_x"
    for t in range(ROUNDS):
        for d in range(DEPTH):
            now = f"{name}_{t}_{d}"
            ctes.append((now, f"SELECT s.* REPLACE (s.p{t} || CASE WHEN b.f IS NULL THEN '' WHEN s.x[b.f] <= b.cut THEN 'L' ELSE 'R' END AS p{t}) "
                              f"FROM {last} s LEFT JOIN best b ON b.tree = {t} AND b.path = s.p{t}"))
            last = now
    joins = " ".join(f"JOIN ends e{t} ON e{t}.tree = {t} AND e{t}.path = s.p{t}" for t in range(ROUNDS))
    ctes.append((name, f"SELECT s.*, base + {' + '.join(f'e{t}.value' for t in range(ROUNDS))} AS predicted FROM {last} s {joins}, base"))
    return ctes

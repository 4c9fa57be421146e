"""SQL for methods that iterate or solve systems, written out round by round and column by column.

Each function returns the text of common table expressions over the segments
``s`` (id, k, segment_id, t, f, masked) that end in ``r`` (id, segment_id, f,
trend0). Rounds that a method may stop early carry a flag for each segment.
"""

from __future__ import annotations

import math

SEG = "PARTITION BY k, segment_id"


def orthogonal(name: str, source: str, width: int) -> str:
    """Modified Gram-Schmidt: from ``source`` (id, k, segment_id, f, w, b0, b1, ...) to ``name`` (id, fit), the weighted least-squares fit of f."""
    out, last = [], source
    for j in range(width):
        rest = [f"b{i}" for i in range(j + 1, width)] + ["y"]
        y = "f" if j == 0 else "y"
        value = lambda c, y=y: y if c == "y" else c
        sums = ", ".join([f"sum(w * b{j} * b{j}) OVER ({SEG}) AS norm", *(f"sum(w * b{j} * {value(c)}) OVER ({SEG}) AS p_{c}" for c in rest)])
        less = ", ".join(f"{value(c)} - CASE WHEN norm > 1e-25::DOUBLE THEN p_{c} / norm ELSE 0 END * b{j} AS {c}" for c in rest)
        out.append(f"{name}_{j} AS MATERIALIZED (SELECT id, k, segment_id, f, w, {less} FROM (SELECT *, {sums} FROM {last}))")
        last = f"{name}_{j}"
    out.append(f"{name} AS MATERIALIZED (SELECT id, f - y AS fit FROM {last})")
    return ",\n".join(out)


#: Rows with their segment's first and last time.
SPANS = f"d AS MATERIALIZED (SELECT *, min(t) OVER ({SEG}) AS t0, max(t) OVER ({SEG}) AS t1 FROM s)"


def fourier(window: float, degree: int) -> str:
    """``b``: a constant, the time (centred: the same span), and the half sine and cosine waves of each degree up to int(span / window)."""
    waves = [f"CASE WHEN {k} <= floor((t1 - t0) / {window}::DOUBLE) THEN {fn}({k} * pi() * (t - t0) / (t1 - t0)) ELSE 0 END" for k in range(1, degree + 1) for fn in ("sin", "cos")]
    columns = ["1::DOUBLE", "(t - (t0 + t1) / 2) / (t1 - t0)", *waves]
    return SPANS + ",\nb AS MATERIALIZED (SELECT id, k, segment_id, f, CASE WHEN masked THEN 0::DOUBLE ELSE 1::DOUBLE END AS w, " + ", ".join(f"{c} AS b{i}" for i, c in enumerate(columns)) + " FROM d)"


def cosine(window: float = 6, degree: int = 4) -> str:
    return ",\n" + ",\n".join([fourier(window, degree), orthogonal("q", "b", 2 * degree + 2), "r AS (SELECT s.id, segment_id, f, fit AS trend0 FROM s JOIN q USING (id))"])


def cosine_robust(window: float = 6, degree: int = 4, rounds: int = 10) -> str:
    """Low outliers lose their weight for good; a segment stops when their number stays the same."""
    width = 2 * degree + 2
    keep = ", ".join(f"b{i}" for i in range(width))
    out, last = [fourier(window, degree), f"v0 AS MATERIALIZED (SELECT *, false AS done, 0::DOUBLE AS trend, -1::BIGINT AS seen FROM b)"], "v0"
    for n in range(1, rounds + 1):
        out.append(orthogonal(f"q{n}", last, width))
        out.append(f"u{n} AS (SELECT v.* EXCLUDE (trend), CASE WHEN done THEN trend ELSE fit END AS trend FROM {last} v JOIN q{n} USING (id))")
        out.append(f"l{n} AS (SELECT *, 1 - f / trend > 2 * stddev_pop(f / trend) OVER ({SEG}) AS low FROM u{n})")
        out.append(f"c{n} AS (SELECT *, count(*) FILTER (low) OVER ({SEG}) AS many FROM l{n})")
        out.append(f"v{n} AS MATERIALIZED (SELECT id, k, segment_id, f, CASE WHEN low AND NOT done THEN 1e-20::DOUBLE ELSE w END AS w, {keep}, done OR many = seen AS done, trend, many AS seen FROM c{n})")
        last = f"v{n}"
    return ",\n" + ",\n".join(out) + f",\nr AS (SELECT id, segment_id, f, trend AS trend0 FROM {last})"


def rspline(window: float = 6, knots: int = 2, rounds: int = 10) -> str:
    """A cubic and a truncated cube for each inner knot, refitted to what isn't a low outlier; the knots follow the points kept."""
    width, out, last = 4 + knots, [SPANS, "v0 AS MATERIALIZED (SELECT *, f AS flat, NOT masked AS kept FROM d)"], "v0"
    for n in range(1, rounds + 1):
        out.append(f"k{n} AS MATERIALIZED (SELECT id, k, segment_id, t, f, t0, t1, flat, kept AND 1 - flat < 2 * stddev_pop(flat) FILTER (kept) OVER ({SEG}) AS kept FROM {last})")
        out.append(f"e{n} AS (SELECT *, min(t) FILTER (kept) OVER ({SEG}) AS x0, max(t) FILTER (kept) OVER ({SEG}) AS x1, count(*) FILTER (kept) OVER ({SEG}) AS many, floor((t1 - t0) / {window}::DOUBLE) AS n FROM k{n})")
        out.append(f"x{n} AS (SELECT *, (t - x0) / (x1 - x0) AS x FROM e{n})")
        bases = ["1::DOUBLE", "x", "x * x", "x * x * x", *(f"CASE WHEN {i} <= n - 2 AND x > {i} / (n - 1) THEN pow(x - {i} / (n - 1), 3) ELSE 0 END" for i in range(1, knots + 1))]
        out.append(f"b{n} AS MATERIALIZED (SELECT id, k, segment_id, f, CASE WHEN kept THEN 1::DOUBLE ELSE 0::DOUBLE END AS w, " + ", ".join(f"{c} AS b{i}" for i, c in enumerate(bases)) + f" FROM x{n})")
        out.append(orthogonal(f"q{n}", f"b{n}", width))
        out.append(f"v{n} AS MATERIALIZED (SELECT e.id, k, segment_id, t, f, t0, t1, many, q{n}.fit, f / q{n}.fit AS flat, kept FROM e{n} e JOIN q{n} USING (id))")
        last = f"v{n}"
    return ",\n" + ",\n".join(out) + f",\nr AS (SELECT id, segment_id, f, CASE WHEN many >= 5 THEN fit END AS trend0 FROM {last})"


def gaussians(window: float = 6, most: int = 4) -> str:
    """``x``: centred Gaussian features g0, g1, ... and the centred values y; n of them, the others 0."""
    at = [f"CASE WHEN {i} < n THEN exp(-0.5::DOUBLE * pow((t - t0 - {i} * (t1 - t0) / (n - 1)) / (2 * (t1 - t0) / (n - 1)), 2)) ELSE 0 END AS h{i}" for i in range(most)]
    centred = [f"h{i} - avg(h{i}) OVER ({SEG}) AS g{i}" for i in range(most)]
    return f"{SPANS},\nh AS (SELECT *, {', '.join(at)} FROM (SELECT *, floor((t1 - t0) / {window}::DOUBLE) AS n FROM d)),\nx AS MATERIALIZED (SELECT *, {', '.join(centred)}, avg(f) OVER ({SEG}) AS middle, f - avg(f) OVER ({SEG}) AS y FROM h)"


def moments(most: int) -> str:
    """``m``: the sums of products of the features and values, by segment."""
    pairs = [f"sum(g{i} * g{j}) AS a{i}_{j}" for i in range(most) for j in range(i + 1)]
    return f"m AS MATERIALIZED (SELECT k, segment_id, count(*) AS many, sum(y * y) AS square, {', '.join(pairs)}, {', '.join(f'sum(g{i} * y) AS r{i}' for i in range(most))} FROM x GROUP BY k, segment_id)"


def solved(name: str, source: str, most: int, damp: str) -> str:
    """``name``: ``source`` (a0_0, a1_0, ..., r0, ...) with the solution c0, c1, ... of the damped normal equations, by elimination."""
    out, last, a = [], source, lambda i, j: f"a{max(i, j)}_{min(i, j)}"
    out.append(f"{name}_0 AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'a{i}_{i} + {damp} AS a{i}_{i}' for i in range(most))}) FROM {last})")
    for j in range(most - 1):
        new = [f"{a(i, m)} - {a(i, j)} * {a(m, j)} / {a(j, j)} AS {a(i, m)}" for i in range(j + 1, most) for m in range(j + 1, i + 1)] + [f"r{i} - {a(i, j)} * r{j} / {a(j, j)} AS r{i}" for i in range(j + 1, most)]
        out.append(f"{name}_{j + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{j})")
    last = f"{name}_{most - 1}"
    for i in reversed(range(most)):
        less = "".join(f" - {a(m, i)} * c{m}" for m in range(i + 1, most))
        out.append(f"{name}_c{i} AS MATERIALIZED (SELECT *, (r{i}{less}) / {a(i, i)} AS c{i} FROM {last})")
        last = f"{name}_c{i}"
    return ",\n".join(out) + f",\n{name} AS (SELECT * FROM {last})"


def ridge(most: int = 4) -> str:
    fit = " + ".join(f"g{i} * c{i}" for i in range(most))
    return ",\n" + ",\n".join([gaussians(most=most), moments(most), solved("sol", "m", most, "1"), f"r AS (SELECT id, x.segment_id, f, middle + {fit} AS trend0 FROM x JOIN sol ON x.k = sol.k AND x.segment_id = sol.segment_id)"])


def elastic(ratio: float, most: int = 4) -> str:
    """The exact minimum: of all patterns of signs, those whose solution has these signs, and of them the one that costs least."""
    l1, l2 = f"{1e-6 * ratio!r}::DOUBLE * many", f"{1e-6 * (1 - ratio)!r}::DOUBLE * many"
    signs = ", ".join(f"range(-1, 2) p{i}(s{i})" for i in range(most))
    part = [f"CASE WHEN s{i} = 0 THEN 1 ELSE a{i}_{i} + {l2} END AS a{i}_{i}" for i in range(most)]
    part += [f"CASE WHEN s{i} = 0 OR s{j} = 0 THEN 0 ELSE a{i}_{j} END AS a{i}_{j}" for i in range(most) for j in range(i)]
    right = [f"CASE WHEN s{i} = 0 THEN 0 ELSE r{i} - {l1} * s{i} END AS {name}{i}" for i in range(most) for name in ("r", "e")]
    fits = " AND ".join(f"sign(c{i}) = s{i}" for i in range(most))
    best = ", ".join(f"arg_min(c{i}, -({' + '.join(f'c{j} * e{j}' for j in range(most))})) AS c{i}" for i in range(most))
    fit = " + ".join(f"g{i} * c{i}" for i in range(most))
    return ",\n" + ",\n".join([
        gaussians(most=most), moments(most), f"ps AS MATERIALIZED (SELECT k, segment_id, {', '.join(f's{i}' for i in range(most))}, {', '.join(part + right)} FROM m, {signs})",
        solved("sol", "ps", most, "0"), f"best AS (SELECT k, segment_id, {best} FROM sol WHERE {fits} GROUP BY k, segment_id)",
        f"r AS (SELECT id, x.segment_id, f, middle + {fit} AS trend0 FROM x JOIN best ON x.k = best.k AND x.segment_id = best.segment_id)",
    ])


def lowess(window: float = 6, rounds: int = 30) -> str:
    """Local lines over the k nearest points by count, with bisquare weights of the round before; a segment stops when its trend stays within 1e-6."""
    out = [
        f"i AS MATERIALIZED (SELECT *, row_number() OVER ({SEG} ORDER BY t, id) - 1 AS nth, count(*) OVER ({SEG}) AS n FROM (SELECT * FROM d))",
        f"j AS MATERIALIZED (SELECT *, least(floor({window}::DOUBLE / (t1 - t0) * n), n)::BIGINT AS kn FROM i)",
        f"j2 AS MATERIALIZED (SELECT *, lead(t, kn::INT) OVER ({SEG} ORDER BY nth) AS far FROM j)",
        "lf AS MATERIALIZED (SELECT p.id, count(q.id) AS lft FROM j2 p LEFT JOIN j2 q ON p.k = q.k AND p.segment_id = q.segment_id AND q.far IS NOT NULL AND (q.t + q.far) / 2 < p.t GROUP BY p.id)",
        "pr AS MATERIALIZED (SELECT p.id AS pid, p.t AS pt, q.id AS qid, q.t AS qt, q.f AS qf, q.nth - lft AS place, p.kn AS kn FROM j2 p JOIN lf USING (id) JOIN j2 q ON p.k = q.k AND p.segment_id = q.segment_id AND q.nth BETWEEN lft AND lft + p.kn - 1)",
        "ra AS (SELECT pid, greatest(max(CASE WHEN place = 0 THEN pt - qt END), max(CASE WHEN place = kn - 2 THEN qt - pt END)) AS radius FROM pr GROUP BY pid)",
        "tc AS MATERIALIZED (SELECT pr.*, pow(1 - pow(abs(qt - pt) / radius, 3), 3) AS tri FROM pr JOIN ra USING (pid))",
        "v0 AS MATERIALIZED (SELECT id, k, segment_id, f, t, masked, false AS done, 1::DOUBLE AS trend, 0::DOUBLE AS robust FROM j2)",
    ]
    for n in range(1, rounds + 1):
        last = f"v{n - 1}"
        out += [
            f"w{n} AS MATERIALIZED (SELECT tc.*, CASE WHEN bool_or(robust <> 0) OVER (PARTITION BY pid) THEN tri * robust ELSE tri END AS raw FROM tc JOIN {last} ON qid = {last}.id)",
            f"x{n} AS (SELECT *, raw / sum(raw) OVER (PARTITION BY pid) AS weight FROM w{n})",
            f"y{n} AS (SELECT *, sum(weight * (qt - pt)) OVER (PARTITION BY pid) AS middle FROM x{n})",
            f"z{n} AS (SELECT *, sum(weight * pow(qt - pt - middle, 2)) OVER (PARTITION BY pid) AS spread FROM y{n})",
            f"f{n} AS MATERIALIZED (SELECT pid AS id, sum(weight * (1 - middle * (qt - pt - middle) / spread) * qf) AS fit FROM z{n} GROUP BY pid)",
            f"o{n} AS MATERIALIZED (SELECT v.* EXCLUDE (trend), trend AS before, CASE WHEN done THEN trend ELSE fit END AS trend FROM {last} v JOIN f{n} USING (id))",
            f"h{n} AS (SELECT k, segment_id, median(abs(f - trend)) AS mid, max(abs(trend - before)) < 1e-6::DOUBLE AS still FROM o{n} GROUP BY k, segment_id)",
            f"v{n} AS MATERIALIZED (SELECT o.id, o.k, o.segment_id, f, t, masked, done OR still AS done, trend, CASE WHEN masked THEN 0 ELSE pow(1 - pow(least(abs(f - trend) / (6 * mid + 1e-100::DOUBLE), 1), 2), 2) END AS robust FROM o{n} o JOIN h{n} h ON o.k = h.k AND o.segment_id = h.segment_id)",
        ]
    return ",\n" + SPANS + ",\n" + ",\n".join(out) + f",\nr AS (SELECT id, segment_id, f, trend AS trend0 FROM v{rounds})"


def supersmoother(window: float = 6) -> str:
    """Running lines over the nearest points by rank: three spans, the best at each point by smoothed leave-one-out residuals."""

    def running(name: str, value: str, span: str, source: str, leave: bool = False) -> str:
        """``name`` (id, fit): local lines of ``value`` over round(span * n) points of ``source`` (id, k, segment_id, nth, n, t, whole, ...)."""
        k = f"least(n, greatest(3, round_even({span} * n, 0)))::BIGINT"
        own = "CASE WHEN q.id = p.id THEN 0 ELSE 1 END" if leave else "1"
        return (
            f"{name}_k AS (SELECT *, {k} AS kk, {value} AS y FROM {source}), {name}_s AS MATERIALIZED (SELECT *, greatest(0, least(nth - kk // 2, n - kk)) AS first FROM {name}_k),\n"
            f"{name}_t AS (SELECT p.id, p.t AS pt, sum({own}) AS m, sum(({own}) * (q.t - p.t)) AS sx, sum(({own}) * q.y) AS sy, sum(({own}) * pow(q.t - p.t, 2)) AS sxx, sum(({own}) * (q.t - p.t) * q.y) AS sxy FROM {name}_s p JOIN {name}_s q ON p.k = q.k AND p.segment_id = q.segment_id AND q.nth BETWEEN p.first AND p.first + p.kk - 1 GROUP BY p.id, p.t),\n"
            f"{name} AS MATERIALIZED (SELECT id, sy / m - CASE WHEN abs(m * sxx - sx * sx) > 1e-12::DOUBLE THEN (m * sxy - sx * sy) / (m * sxx - sx * sx) ELSE 0 END * sx / m AS fit FROM {name}_t)"
        )

    win, wide, mid = f"({window}::DOUBLE / whole)", f"(3 * ({window}::DOUBLE / whole))", f"(2 * ({window}::DOUBLE / whole))"
    parts = [
        f"g0 AS MATERIALIZED (SELECT *, row_number() OVER ({SEG} ORDER BY t, id) - 1 AS nth, count(*) OVER ({SEG}) AS n, max(t) OVER (PARTITION BY k) - min(t) OVER (PARTITION BY k) AS whole FROM s)",
        running("a1", "f", win, "g0"), running("a3", "f", wide, "g0"), running("l1", "f", win, "g0", True), running("l3", "f", wide, "g0", True),
        "g1 AS MATERIALIZED (SELECT g0.*, a1.fit AS one, a3.fit AS three, abs(f - l1.fit) AS e1, abs(f - l3.fit) AS e3 FROM g0 JOIN a1 USING (id) JOIN a3 USING (id) JOIN l1 USING (id) JOIN l3 USING (id))",
        running("s1", "e1", wide, "g1"), running("s3", "e3", wide, "g1"),
        f"g2 AS MATERIALIZED (SELECT g1.*, CASE WHEN s3.fit < s1.fit THEN {wide} ELSE {win} END AS best FROM g1 JOIN s1 USING (id) JOIN s3 USING (id))",
        running("sb", "best", wide, "g2"),
        f"g3 AS MATERIALIZED (SELECT g2.*, one + (least(greatest(sb.fit, {win}), {wide}) - {win}) / ({wide} - {win}) * (three - one) AS mixed FROM g2 JOIN sb USING (id))",
        running("fin", "mixed", mid, "g3"),
    ]
    return ",\n" + ",\n".join(parts) + ",\nr AS (SELECT s.id, segment_id, f, fit AS trend0 FROM s JOIN fin USING (id))"


def savgol5() -> str:
    """Quadratics over five samples; the two at either end from the first and last five's."""
    def dot(x: str, *c: int) -> str:
        return "(" + " + ".join(f"{v} * {x}[{i + 1}]" for i, v in enumerate(c)) + ") / 35"

    rows = f"OVER ({SEG} ORDER BY t, id"
    whole = [
        f"i AS (SELECT *, row_number() {rows}) AS nth, count(*) OVER ({SEG}) AS n, list(f) {rows} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x, list(f) {rows} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ahead, list(f) {rows} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS behind FROM s)",
        f"j AS (SELECT *, first_value(ahead) {rows}) AS head, last_value(behind) {rows} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM i)",
        f"r AS (SELECT id, segment_id, f, CASE WHEN n < 5 THEN NULL WHEN nth = 1 THEN {dot('head', 31, 9, -3, -5, 3)} WHEN nth = 2 THEN {dot('head', 9, 13, 12, 6, -5)} WHEN nth = n THEN {dot('tail', 3, -5, -3, 9, 31)} WHEN nth = n - 1 THEN {dot('tail', -5, 6, 12, 13, 9)} ELSE {dot('x', -3, 12, 17, 12, -3)} END AS trend0 FROM j)",
    ]
    return ",\n" + ",\n".join(whole)


def reweighted(weight: str) -> str:
    """The fold of an iteratively reweighted mean over the window's list x; the state is [mean, the one before, whether it stopped]. Z: the scaled residual's size."""
    s = "(list_median(list_transform(x, lambda q: abs(q - c[1]))) / 0.6744897501960817::DOUBLE)"
    w = weight.replace("Z", f"greatest(abs((q - c[1]) / {s}), 1e-300::DOUBLE)")
    norm, new = f"list_sum(list_transform(x, lambda q: {w}))", f"list_sum(list_transform(x, lambda q: ({w}) * q)) / list_sum(list_transform(x, lambda q: {w}))"
    step = f"CASE WHEN c[3] > 0 OR {s} = 0 OR {norm} = 0 THEN [c[1], c[2], 1::DOUBLE] WHEN abs({new} - c[2]) < 1e-8::DOUBLE THEN [{new}, c[1], 1::DOUBLE] ELSE [{new}, {new}, 0::DOUBLE] END"
    return f"CASE WHEN n > 1 THEN list_reduce(list_transform(range(51), lambda i: [list_avg(x), 1e300::DOUBLE, 0::DOUBLE]), lambda c, i: {step})[1] END"


def proposal2(c: float = 1.5, rounds: int = 1000) -> str:
    """Huber's joint estimate as a fold; the state is [location, scale, 0 while going on, 1 if converged, 2 if given up]."""
    import math

    inside = math.erf(c / math.sqrt(2))
    gamma = inside + c * c * (1 - inside) - 2 * c * math.exp(-c * c / 2) / math.sqrt(2 * math.pi)
    new = f"list_avg(list_transform(x, lambda q: greatest(least(q, c[1] + {c}::DOUBLE * c[2]), c[1] - {c}::DOUBLE * c[2])))"
    near = f"list_filter(x, lambda q: abs((q - c[1]) / c[2]) <= {c}::DOUBLE)"
    below = f"((n - 1) * {gamma!r}::DOUBLE - (n - len({near})) * {c * c}::DOUBLE)"
    scale = f"sqrt(coalesce(list_sum(list_transform({near}, lambda v: pow(v - {new}, 2))), 0) / {below})"
    step = f"CASE WHEN c[3] > 0 THEN c WHEN NOT c[2] > 0 OR {below} <= 0 THEN [c[1], c[2], 2::DOUBLE] WHEN abs(c[2] - {scale}) <= {scale} * 1e-6::DOUBLE AND abs(c[1] - {new}) <= {scale} * 1e-6::DOUBLE THEN [{new}, {scale}, 1::DOUBLE] ELSE [{new}, {scale}, 0::DOUBLE] END"
    fold = f"list_reduce(list_transform(range({rounds + 1}), lambda i: [med, mad / 0.6744897501960817::DOUBLE, 0::DOUBLE]), lambda c, i: {step})"
    return f"CASE WHEN n > 1 THEN CASE WHEN {fold}[3] = 1 THEN {fold}[1] ELSE med END END"


def pspline(count: int = 12, rounds: int = 3, cut: int = 2) -> str:
    """A uniform cubic B-spline with a second-difference penalty, its weight by generalised cross-validation; outliers on both sides go before each fit.

    Ends in ``fits`` (id, k, segment_id, f, fit, edof) and ``r``. A row for each
    segment and penalty weight is solved by elimination, with the products of
    the basis as further right sides, whose trace is the degrees of freedom.
    """
    basis, sides = range(count), [f"y{i}" for i in range(count)]
    diff = [[0] * j + [1, -2, 1] + [0] * (count - 3 - j) for j in range(count - 2)]
    pen = lambda i, j: sum(d[i] * d[j] for d in diff)
    a = lambda i, j: f"a{max(i, j)}_{min(i, j)}"
    u = "(t - low) / step"
    cell = f"least(greatest(floor({u}), 0), {count - 4})"
    pieces = ["pow(1 - v, 3) / 6", "(3 * pow(v, 3) - 6 * pow(v, 2) + 4) / 6", "(-3 * pow(v, 3) + 3 * pow(v, 2) + 3 * v + 1) / 6", "pow(v, 3) / 6"]
    out, last = [f"v0 AS MATERIALIZED (SELECT *, f / median(f) OVER ({SEG}) AS flat, true AS kept FROM s)"], "v0"
    for n in range(1, rounds + 1):
        own = [
            f"k{n} AS MATERIALIZED (SELECT id, k, segment_id, t, f, kept AND abs(1 - flat) < {cut} * stddev_pop(flat) FILTER (kept) OVER ({SEG}) AS kept FROM {last})",
            f"e{n} AS (SELECT *, min(t) FILTER (kept) OVER ({SEG}) AS low, max(t) FILTER (kept) OVER ({SEG}) AS high FROM k{n})",
            f"g{n} AS (SELECT *, (high - low) / {count - 3} AS step FROM e{n})",
            f"h{n} AS (SELECT *, {cell} AS cell, {u} - {cell} AS v FROM g{n})",
            f"b{n} AS MATERIALIZED (SELECT id, k, segment_id, f, kept, " + ", ".join(f"CASE {i} - cell " + " ".join(f"WHEN {j} THEN {p}" for j, p in enumerate(pieces)) + f" ELSE 0 END AS b{i}" for i in basis) + f" FROM h{n})",
            f"m{n} AS MATERIALIZED (SELECT k, segment_id, " + ", ".join([*(f"sum(b{i} * b{j}) AS g{i}_{j}" for i in basis for j in range(i + 1)), *(f"sum(b{i} * f) AS r{i}" for i in basis)]) + f" FROM b{n} WHERE kept GROUP BY k, segment_id)",
        ]
        start = [f"g{i}_{j} + {pen(i, j)} * lam + {'1e-9::DOUBLE' if i == j else '0'} AS a{i}_{j}" for i in basis for j in range(i + 1)]
        start += [f"g{max(i, j)}_{min(i, j)} AS y{j}_{i}" for i in basis for j in basis]
        own.append(f"l{n}_0 AS MATERIALIZED (SELECT k, segment_id, lam, " + ", ".join([*start, *(f"r{i}" for i in basis)]) + f" FROM m{n}, (SELECT pow(10::DOUBLE, -3 + 0.6::DOUBLE * i) AS lam FROM range(11) x(i)))")
        right = ["r", *(f"{y}_" for y in sides)]
        for j in range(count - 1):
            new = [f"{a(i, m)} - {a(i, j)} * {a(m, j)} / {a(j, j)} AS {a(i, m)}" for i in range(j + 1, count) for m in range(j + 1, i + 1)]
            new += [f"{q}{i} - {a(i, j)} * {q}{j} / {a(j, j)} AS {q}{i}" for i in range(j + 1, count) for q in right]
            own.append(f"l{n}_{j + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM l{n}_{j})")
        prior = f"l{n}_{count - 1}"
        for i in reversed(basis):
            new = [f"({q}{i}" + "".join(f" - {a(m, i)} * {q}{m}" for m in range(i + 1, count)) + f") / {a(i, i)} AS {q}{i}" for q in right]
            own.append(f"x{n}_{i} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM {prior})")
            prior = f"x{n}_{i}"
        fit = " + ".join(f"b{i} * r{i}" for i in basis)
        own += [
            f"w{n} AS MATERIALIZED (SELECT k, segment_id, lam, {' + '.join(f'y{i}_{i}' for i in basis)} AS edof, {', '.join(f'r{i}' for i in basis)} FROM {prior})",
            f"t{n} AS MATERIALIZED (SELECT b.id, b.k, b.segment_id, f, kept, lam, edof, {fit} AS fit FROM b{n} b JOIN w{n} w ON b.k = w.k AND b.segment_id = w.segment_id)",
            f"c{n} AS (SELECT k, segment_id, lam, count(*) * sum(pow(f - fit, 2)) / pow(greatest(count(*) - 1.4::DOUBLE * any_value(edof), 1e-9::DOUBLE), 2) AS score FROM t{n} WHERE kept GROUP BY k, segment_id, lam)",
            f"o{n} AS (SELECT k, segment_id, arg_min(lam, score) AS lam FROM c{n} GROUP BY k, segment_id)",
            f"z{n} AS MATERIALIZED (SELECT t{n}.* FROM t{n} JOIN o{n} ON t{n}.k = o{n}.k AND t{n}.segment_id = o{n}.segment_id AND t{n}.lam = o{n}.lam)",
            f"v{n} AS MATERIALIZED (SELECT s.*, z{n}.fit, z{n}.edof, s.f / z{n}.fit AS flat, kept FROM s JOIN z{n} USING (id))",
        ]
        out += own
        last = f"v{n}"
    return ",\n" + ",\n".join(out) + f",\nr AS (SELECT id, segment_id, f, fit AS trend0 FROM {last})"


def hspline(rounds: int = 200, epsilon: float = 1.35, alpha: float = 1e-4) -> str:
    """Huber regression on the cubic basis of four knots (spans of four to five windows), by reweighting: a recursion with a row for each segment."""
    cs = [f"c{i}" for i in range(5)]
    basis = ["pow(1 - u, 3)", "3 * u * pow(1 - u, 2)", "3 * u * u * (1 - u)", "u * u * u", "1::DOUBLE"]
    fit = " + ".join(f"b{i} * c{i}" for i in range(5))
    a = lambda i, j: f"a{max(i, j)}_{min(i, j)}"

    def solution(rows: str, keep: str) -> str:
        """Nested selections that solve the weighted, damped normal equations of ``rows`` (k, segment_id, w, f, b0, ...)."""
        sums = [f"sum(w * b{i} * b{j}) + {alpha if i == j < 4 else 0}::DOUBLE AS a{i}_{j}" for i in range(5) for j in range(i + 1)] + [f"sum(w * b{i} * f) AS r{i}" for i in range(5)]
        text = f"SELECT k, segment_id, {keep}, {', '.join(sums)} FROM ({rows}) GROUP BY k, segment_id"
        for j in range(4):
            new = [f"{a(i, m)} - {a(i, j)} * {a(m, j)} / {a(j, j)} AS {a(i, m)}" for i in range(j + 1, 5) for m in range(j + 1, i + 1)] + [f"r{i} - {a(i, j)} * r{j} / {a(j, j)} AS r{i}" for i in range(j + 1, 5)]
            text = f"SELECT * REPLACE ({', '.join(new)}) FROM ({text})"
        for i in reversed(range(5)):
            text = f"SELECT *, (r{i}" + "".join(f" - {a(m, i)} * c{m}" for m in range(i + 1, 5)) + f") / {a(i, i)} AS c{i} FROM ({text})"
        return text

    residual = f"SELECT b.*, n, s, abs(f - ({fit})) AS e FROM b JOIN it ON b.k = it.k AND b.segment_id = it.segment_id WHERE n < {rounds}"
    scaled = f"SELECT *, sqrt(sum(CASE WHEN e > {epsilon}::DOUBLE * s THEN 0 ELSE e * e END) OVER ({SEG}) / (count(*) OVER ({SEG}) - count(*) FILTER (e > {epsilon}::DOUBLE * s) OVER ({SEG}) * {epsilon**2!r}::DOUBLE)) AS z FROM ({residual})"
    weighed = f"SELECT * EXCLUDE (w), CASE WHEN e > {epsilon}::DOUBLE * z THEN {epsilon}::DOUBLE / e ELSE 1 / z END AS w FROM ({scaled})"
    parts = [
        SPANS,
        f"u AS (SELECT *, (t - t0) / (t1 - t0) AS u FROM d)",
        "b AS MATERIALIZED (SELECT id, k, segment_id, f, 1::DOUBLE AS w, " + ", ".join(f"{p} AS b{i}" for i, p in enumerate(basis)) + " FROM u)",
        f"i0 AS MATERIALIZED ({solution('SELECT * FROM b', '0 AS n')})",
        f"s0 AS MATERIALIZED (SELECT b.k, b.segment_id, stddev_pop(f - ({fit})) AS s FROM b JOIN i0 ON b.k = i0.k AND b.segment_id = i0.segment_id GROUP BY b.k, b.segment_id)",
        f"it AS (SELECT i0.k, i0.segment_id, 0 AS n, s, {', '.join(cs)} FROM i0 JOIN s0 ON i0.k = s0.k AND i0.segment_id = s0.segment_id UNION ALL SELECT k, segment_id, n, s, {', '.join(cs)} FROM ({solution(weighed, 'any_value(n) + 1 AS n, any_value(z) AS s')}))",
        f"r AS (SELECT id, b.segment_id, f, {fit} AS trend0 FROM b JOIN it ON b.k = it.k AND b.segment_id = it.segment_id AND n = {rounds})",
    ]
    return ",\n" + ",\n".join(parts)


def matern(size: float, noise: float = 1e-10) -> str:
    """A Matérn 3/2 process of a fixed length, as two recursions over each segment's points: a filter forwards, and its correction by what is to come backwards. Needs WITH RECURSIVE. Steps are at most 0.5 * size."""
    n = f"{noise!r}::DOUBLE"
    rise = " + ".join(f"pow(2 * z, {j}) / {math.factorial(j)}::DOUBLE" for j in range(3, 16))  # exp(2 z) - 1 - 2 z - 2 z^2
    seen = f"y - m AS v, p + {n} AS tot"
    after = f"CASE WHEN y IS NULL THEN m ELSE m + p / tot * v END AS um, CASE WHEN y IS NULL THEN g ELSE g + b * p / tot * v END AS ug, CASE WHEN y IS NULL THEN p ELSE p * {n} / tot END AS up"
    kept = "k, segment_id, i, id, y, m, p, b, c, v, tot, a11, a12, a22"
    minors = "up * fc * e2 * e2 + up * q * pow(x1 * sl - y1, 2) + up * rest * x1 * x1 + fc * q * pow(a12 * sl - a22, 2) + fc * rest * a12 * a12 + q * rest"
    return f""",
o AS (SELECT *, median(f) FILTER (NOT masked) OVER ({SEG}) AS mid FROM s),
y0 AS (SELECT *, stddev_pop(f - mid) FILTER (NOT masked) OVER ({SEG}) AS sd, row_number() OVER ({SEG} ORDER BY t, id) AS i, coalesce(t - lag(t) OVER ({SEG} ORDER BY t, id), 0) * sqrt(3::DOUBLE) / {size!r}::DOUBLE AS z FROM o),
y1 AS (SELECT k, segment_id, id, i, mid, z, exp(-z) AS e1, exp(-2 * z) AS e2, {rise} AS rise, CASE WHEN NOT masked AND mid - f < 2 * sd THEN f - mid END AS y FROM y0),
y2 AS (SELECT *, e1 * (1 + z) AS a11, e1 * z AS a12, e1 * (1 - z) AS a22, e2 * rise AS q, CASE WHEN z > 0 THEN 2 * z * z / rise ELSE 0 END AS sl, e2 * (4 * z + rise) AS q22 FROM y1),
pts AS MATERIALIZED (SELECT *, greatest(q22 - 2 * z * z * e2 * sl, 0) AS rest, count(y) OVER ({SEG}) AS many, max(i) OVER ({SEG}) AS n FROM y2),
fw AS (
  SELECT {kept}, {after} FROM (SELECT *, {seen} FROM (SELECT *, 0::DOUBLE AS m, 0::DOUBLE AS g, 1::DOUBLE AS p, 0::DOUBLE AS b, 1::DOUBLE AS c FROM pts WHERE i = 1))
  UNION ALL
  SELECT {kept}, {after} FROM (SELECT *, {seen} FROM (
    SELECT *, fp AS p, cross_ / fp AS b, minors_ / fp AS c FROM (
      SELECT *, up * x1 * x1 + fc * a12 * a12 + q AS fp, up * x1 * y1 + fc * a12 * a22 + q * sl AS cross_, {minors} AS minors_ FROM (
        SELECT r.*, r.a11 * um + r.a12 * ug AS m, r.a22 * ug - r.a12 * um AS g, up, fw.c AS fc, r.a11 + r.a12 * fw.b AS x1, r.a22 * fw.b - r.a12 AS y1
        FROM fw JOIN (SELECT k, segment_id, i, id, y, a11, a12, a22, q, sl, rest, e2 FROM pts) r ON r.k = fw.k AND r.segment_id = fw.segment_id AND r.i = fw.i + 1))))),
fs AS MATERIALIZED (SELECT * FROM fw),
bw AS (
  SELECT k, segment_id, i, id, m + p * (r1 + b * r2) AS fit, a11 * r1 - a12 * r2 AS n1, a12 * r1 + a22 * r2 AS n2 FROM (
    SELECT f.*, CASE WHEN y IS NULL THEN 0 ELSE v / tot END AS r1, 0::DOUBLE AS r2 FROM fs f JOIN (SELECT k, segment_id, max(i) AS i FROM fs GROUP BY ALL) l USING (k, segment_id, i))
  UNION ALL
  SELECT k, segment_id, i, id, m + p * (r1 + b * r2), a11 * r1 - a12 * r2, a12 * r1 + a22 * r2 FROM (
    SELECT f.*, CASE WHEN f.y IS NULL THEN n1 ELSE f.v / f.tot + (1 - f.p / f.tot) * n1 - f.b * f.p / f.tot * n2 END AS r1, n2 AS r2
    FROM bw JOIN fs f ON f.k = bw.k AND f.segment_id = bw.segment_id AND f.i = bw.i - 1)),
r AS (SELECT s.id, s.segment_id, s.f, CASE WHEN pts.many > 0 THEN fit + mid END AS trend0 FROM s JOIN pts USING (id) JOIN bw USING (id))"""

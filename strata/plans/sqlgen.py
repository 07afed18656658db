"""DuckDB text for the oracle side of metric / report queries.

These builders only produce the *oracle* statements; the Spark side is the operator
library.  Keys are a comma-separated column list (e.g. ``environment, model``).
"""

from __future__ import annotations


def cls(c: str) -> str:
    return f"CAST(round_even(greatest(-3.0::double, least(3.0::double, {c})), 0) AS INTEGER)"


def reg_exprs(t="y_true", p="y_pred", tol=0.5, rnd=True) -> dict:
    e = f"({t} - {p})"
    ex = {
        "RMSE": f"sqrt(avg({e}*{e}))",
        "MAE": f"avg(abs({e}))",
        "R2": f"CASE WHEN var_pop({t}) < 1e-12 THEN NULL ELSE 1.0::double - sum({e}*{e}) / (var_pop({t}) * count(*)) END",
        "Accuracy": f"coalesce(avg(CASE WHEN abs({e}) <= {tol}::double THEN 1.0::double ELSE 0.0::double END), 0.0::double)",
        "Residual_STD": f"stddev_pop({e})",
        "MBE": f"avg({e})",
    }
    if rnd:
        ex = {k: f"round({v}, 6)" for k, v in ex.items()}
    return ex


def reg_select(keys: str, src: str, t="y_true", p="y_pred", tol=0.5) -> str:
    ex = reg_exprs(t, p, tol)
    return f"SELECT {keys}, " + ", ".join(f"{v} AS {k}" for k, v in ex.items()) + f" FROM {src} GROUP BY {keys}"


def ordinal_ctes(keys: str, src: str, pre: str = "o_", t="y_true", p="y_pred") -> str:
    """CTEs ending in ``{pre}res`` with keys + Accuracy_exact, F1_macro, Kappa,
    Kappa_quadratic, Kendall_tau_b (unrounded)."""
    kl = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in kl)
    ka = ", ".join(f"a.{k}" for k in kl)
    kct = ", ".join(f"ct.{k}" for k in kl)
    return f"""
{pre}ct AS (SELECT {keys}, {cls(t)} AS tc, {cls(p)} AS pc, count(*) AS cnt FROM {src} GROUP BY ALL),
{pre}tot AS (SELECT {keys}, CAST(sum(cnt) AS double) AS n,
             CAST(sum(CASE WHEN tc = pc THEN cnt ELSE 0 END) AS double) AS diag FROM {pre}ct GROUP BY ALL),
{pre}tm AS (SELECT {keys}, tc AS c, CAST(sum(cnt) AS double) AS t_n FROM {pre}ct GROUP BY ALL),
{pre}pm AS (SELECT {keys}, pc AS c, CAST(sum(cnt) AS double) AS p_n FROM {pre}ct GROUP BY ALL),
{pre}tp AS (SELECT {keys}, tc AS c, CAST(cnt AS double) AS tp FROM {pre}ct WHERE tc = pc),
{pre}m0 AS (SELECT {keys}, c, coalesce(t_n, 0.0) AS t_n, coalesce(p_n, 0.0) AS p_n
            FROM {pre}tm FULL OUTER JOIN {pre}pm USING ({keys}, c)),
{pre}mg AS (SELECT m.*, coalesce(tp, 0.0) AS tp,
            CAST(dense_rank() OVER (PARTITION BY {", ".join("m." + k for k in kl)} ORDER BY m.c) - 1 AS double) AS idx
            FROM {pre}m0 m LEFT JOIN {pre}tp USING ({keys}, c)),
{pre}ms AS (SELECT {keys}, avg(2.0::double * tp / (t_n + p_n)) AS F1_macro, sum(t_n * p_n) AS tp_sum,
            sum(t_n * idx * idx) AS ti2, sum(p_n * idx * idx) AS pi2, sum(t_n * idx) AS ti, sum(p_n * idx) AS pi_,
            sum(t_n * (t_n - 1) / 2) AS n1, sum(p_n * (p_n - 1) / 2) AS n2 FROM {pre}mg GROUP BY ALL),
{pre}qo AS (SELECT {kct}, sum(ct.cnt * (a.idx - b.idx) * (a.idx - b.idx)) AS qobs
            FROM {pre}ct ct JOIN {pre}mg a ON {on("a", "ct")} AND a.c = ct.tc
            JOIN {pre}mg b ON {on("b", "ct")} AND b.c = ct.pc GROUP BY ALL),
{pre}pr AS (SELECT {ka}, CAST(sum(CASE WHEN a.pc < b.pc THEN a.cnt * b.cnt ELSE 0 END) AS double) AS con,
            CAST(sum(CASE WHEN a.pc > b.pc THEN a.cnt * b.cnt ELSE 0 END) AS double) AS dis
            FROM {pre}ct a JOIN {pre}ct b ON {on("a", "b")} AND a.tc < b.tc GROUP BY ALL),
{pre}res AS (SELECT {", ".join("t." + k for k in kl)}, t.diag / t.n AS Accuracy_exact, s.F1_macro,
   CASE WHEN t.n - s.tp_sum / t.n = 0 THEN NULL ELSE 1.0::double - (t.n - t.diag) / (t.n - s.tp_sum / t.n) END AS Kappa,
   CASE WHEN s.ti2 + s.pi2 - 2.0::double * s.ti * s.pi_ / t.n = 0 THEN NULL
        ELSE 1.0::double - q.qobs / (s.ti2 + s.pi2 - 2.0::double * s.ti * s.pi_ / t.n) END AS Kappa_quadratic,
   CASE WHEN (t.n * (t.n - 1) / 2 - s.n1) * (t.n * (t.n - 1) / 2 - s.n2) <= 0 THEN NULL
        ELSE (coalesce(pr.con, 0.0) - coalesce(pr.dis, 0.0))
             / sqrt((t.n * (t.n - 1) / 2 - s.n1) * (t.n * (t.n - 1) / 2 - s.n2)) END AS Kendall_tau_b
   FROM {pre}tot t JOIN {pre}ms s ON {on("s", "t")} JOIN {pre}qo q ON {on("q", "t")}
   LEFT JOIN {pre}pr pr ON {on("pr", "t")})"""


def eval_ctes(keys: str, src: str, name: str = "ev") -> str:
    """CTE ``name`` with keys + the 6 regression and 5 ordinal metrics (unrounded)."""
    kl = [k.strip() for k in keys.split(",")]
    reg = reg_exprs(rnd=False)
    return ordinal_ctes(keys, src, pre=f"{name}_") + f""",
{name}_reg AS (SELECT {keys}, {", ".join(f"{v} AS {k}" for k, v in reg.items())} FROM {src} GROUP BY {keys}),
{name} AS (SELECT r.*, o.Accuracy_exact, o.F1_macro, o.Kappa, o.Kappa_quadratic, o.Kendall_tau_b
           FROM {name}_reg r JOIN {name}_res o ON {" AND ".join(f"r.{k} = o.{k}" for k in kl)})"""


def r6(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)

"""SQL of effective sample sizes (L2) and PSIS (M1) over any number of chains and draws: lists by chain and iteration."""

from __future__ import annotations

Views = tuple[dict[str, str], dict[str, list[str]]]


def ess_views(prefix: str, keys: str, series: str, value: str) -> Views:
    """Effective sample size ``ess`` by ``keys`` of ``value`` in the view ``series`` (with Chain and Sim), in the view
    ``<prefix>_e``; the draws themselves are in ``<prefix>_x``: x, s draws of m chains."""
    p = prefix
    views = {
        f"{p}_l": f"select {keys}, Chain, list({value} order by Sim) as c from {series} group by all",
        f"{p}_x": f"""
select {keys}, list(c order by Chain) as cs, flatten(list(c order by Chain)) as x, count(*) as m, min(len(c)) as n, sum(len(c))::bigint as s
from {p}_l group by {keys}""",
        f"{p}_m": f"select *, list_transform(cs, lambda c: list_avg(c)) as ms from {p}_x",
        f"{p}_c": f"""
select {keys}, m, n, s, ms, list_transform(range(1, m + 1), lambda j: list_transform(cs[j], lambda v: v - ms[j])) as cs from {p}_m""",
        f"{p}_a": f"""
select {keys}, m, n, s, coalesce(list_var_samp(ms), 0.0e0) as vm, list_transform(range(0, n), lambda t:
       list_sum(list_transform(cs, lambda c: list_dot_product(c[1:n - t], c[t + 1:n])))/(m*n)) as a
from {p}_c""",
        f"{p}_r": f"""
select {keys}, n, s, total, list_transform(range(1, n + 1), lambda t: case when t = 1 then 1.0 else 1.0 - (a[1]*n/(n - 1.0) - a[t])/total end) as r
from (select *, a[1] + vm as total from {p}_a) q""",
        f"{p}_p": f"select {keys}, s, total, k, r[2*k + 1] + r[2*k + 2] as p from (select *, unnest(range(0, n // 2)) as k from {p}_r) q",
        f"{p}_q": f"""
select {keys}, s, total, k, bool_and(p >= 0) over w as up, min(p) over w as low from {p}_p
window w as (partition by {keys} order by k)""",
        f"{p}_e": f"""
select {keys}, any_value(s) as s, case when not (isfinite(any_value(total)) and any_value(total) > 0) then null
                    when not bool_or(up and k = 0) or 2*sum(case when up then low else 0 end) - 1 <= 0 then any_value(s)::double
                    else any_value(s)::double/(2*sum(case when up then low else 0 end) - 1) end as ess
from {p}_q group by {keys}""",
    }
    deps = {f"{p}_l": [series], f"{p}_x": [f"{p}_l"], **{f"{p}_{b}": [f"{p}_{a}"] for a, b in zip("xmcarpq", "mcarpqe", strict=True)}}
    return views, deps


_LSE = "ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) + list_max({x})"


def psis_views(name: str, keys: str, series: str) -> Views:
    """The view ``name``: pointwise PSIS by ``keys`` (elpd_loo, p_loo, looic, pareto_k, r_eff) of ``ll`` in ``series``."""
    p = f"{name}_ess"
    views, deps = ess_views(p, keys, series, "ll")
    steps = [
        f"""
select x.*, list_reverse_sort(x.x) as y, list_min(x.x) as mn, coalesce(e.ess, x.s)/x.s as r_eff,
       cast(ceil(least(0.2e0*x.s, 3.0e0*sqrt(x.s/(coalesce(e.ess, x.s)/x.s)))) as int) as t
from {p}_x x join {p}_e e using ({keys})""",
        """
select *, exp(mn - y[s - t]) as cut, list_transform(y[s + 1 - t:s], lambda v: exp(mn - v) - exp(mn - y[s - t])) as tail,
       30 + cast(floor(sqrt(t)) as int) as g from {}""",
        """
select *, list_transform(range(1, g + 1), lambda j: 1.0e0/tail[t] + (1.0e0 - sqrt(g/(j - 0.5e0)))/(3.0e0*tail[cast(floor(t/4.0e0 + 0.5e0) as int)])) as theta
from {}""",
        "select *, list_transform(theta, lambda th: list_avg(list_transform(tail, lambda v: ln(1.0e0 - th*v)))) as shape from {}",
        "select *, list_transform(range(1, g + 1), lambda j: t*(ln(-theta[j]/shape[j]) - shape[j] - 1.0e0)) as fit from {}",
        """
select *, list_dot_product(theta, list_transform(fit, lambda a: 1.0e0/list_sum(list_transform(fit, lambda b: exp(b - a))))) as th from {}""",
        "select *, list_avg(list_transform(tail, lambda v: ln(1.0e0 - th*v))) as k0 from {}",
        "select *, -k0/th as sigma, case when t < 5 then cast('inf' as double) else (k0*t + 5.0e0)/(t + 10.0e0) end as k from {}",
        """
select *, case when t < 5 then list_transform(y, lambda v: mn - v) else list_concat(list_transform(y[1:s - t], lambda v: mn - v), list_transform(range(1, t + 1), lambda j:
       least(0.0e0, ln(sigma*(pow(1.0e0 - (j - 0.5e0)/t, -k) - 1.0e0)/k + cut)))) end as lw from {}""",
    ]
    before = None
    for n, sql in enumerate(steps, 1):
        views[f"{name}_{n}"] = sql.format(before) if before else sql
        deps[f"{name}_{n}"] = [before] if before else [f"{p}_x", f"{p}_e"]
        before = f"{name}_{n}"
    views[name] = f"""
select {keys}, elpd_loo, lpd - elpd_loo as p_loo, -2.0e0*elpd_loo as looic, k as pareto_k, r_eff
from (select *, {_LSE.format(x='z')} - ({_LSE.format(x='lw')}) as elpd_loo, {_LSE.format(x='y')} - ln(s) as lpd
      from (select *, list_transform(range(1, s + 1), lambda j: lw[j] + y[j]) as z from {before}) q) u"""
    deps[name] = [before]
    return views, deps

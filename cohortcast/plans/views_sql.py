"""DuckDB SQL for the fixture views (oracle side).  Only the base tables are
registered in the oracle, so each query's SQL carries the views it needs as CTEs.

The constants come from the same ``CohortConfig`` the Spark side uses.
"""

from __future__ import annotations

from ..config import FIXTURE, CohortConfig
from ..sources.fixtures import SIGMA_OF


def _u(j: int, at: str) -> str:
    return (f"(((Chain*7919 + ({at})*104729 + rk*15485863 + {j}*1299709 + Iter*6185 + mass % 97) % 10007)/10007.0e0)")


def view_defs(cfg: CohortConfig = FIXTURE) -> dict[str, str]:
    c = cfg
    per_chain = c.iters_per_chain
    v: dict[str, str] = {}
    v["cells"] = """
select r_name as Country, cast(year(o_orderdate) as int) as Year, cast(l_quantity as int)+5 as Age,
       cast(year(o_orderdate) as int)-(cast(l_quantity as int)+5) as Cohort,
       cast(count(*) as double) as Births,
       cast(sum(cast(round(l_extendedprice*100) as bigint)) as double)/500000.0e0 as Exposure
from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
     join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
group by r_name, cast(year(o_orderdate) as int), cast(l_quantity as int)+5"""
    v["rates"] = """
select e.Country, e.Year, e.Age, e.Cohort, e.Exposure, b.Births, b.Births/e.Exposure as Rate
from cells e left join cells b on e.Country=b.Country and e.Year=b.Year and e.Age=b.Age and e.Cohort=b.Cohort"""
    v["draw_keys"] = f"""
select r_name as Country, r_regionkey as rk, a.Sim, 1 + cast(floor(a.Sim/{per_chain}) as int) as Chain,
       1 + a.Sim % {per_chain} as Iter, coalesce(m.mass, 0) as mass
from region cross join (select range as Sim from range(0,{c.n_draws})) a
     left join (select r_name as mc, l_orderkey % {c.n_draws} as Sim,
                       cast(count(*) + sum(cast(l_quantity as int)) as bigint) as mass
                from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey
                     join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
                group by r_name, l_orderkey % {c.n_draws}) m on m.mc = r_name and m.Sim = a.Sim"""
    v["draws"] = f"""
select Country, Sim, Chain, Iter, Cohort,
  1.5e0 + {_u(1, 'Cohort')} + (case when rk = 1 and Chain = 4 then 0.5e0 when rk = 2 and Chain >= 3 then 0.5e0
                                    when rk = 4 then Chain*0.25e0 else 0e0 end) as CEB,
  5e0 + 3e0*{_u(2, 'Cohort')} as mode_age_gap,
  52e0 + 6e0*{_u(3, 'Cohort')} as mode_age_sum,
  4e0 + 2e0*{_u(4, 'Cohort')} as sd_1,
  4e0 + 2e0*{_u(5, 'Cohort')} as sd_2,
  2e0*{_u(6, 'Cohort')} - 1e0 as logit_mixture
from draw_keys cross join (select range as Cohort from range({c.first_full_cohort}, {c.first_full_cohort + c.T_total})) b"""
    v["dispersion"] = f"""
select Country, Sim, Age, 2e0 + 20e0*{_u(7, 'Age')} as Dispersion
from draw_keys cross join (select range as Age from range({c.first_data_age}, {c.last_data_age + 1})) b"""
    v["sampler_params"] = f"""
select Country, Chain, Iter,
  case when rk = 3 and {_u(8, '1')} < 0.05e0 then 1 else 0 end as divergent__,
  cast(6 + floor(7e0*{_u(9, '1')}) as int) as treedepth__,
  50e0 + 10e0*{_u(10, '1')} as energy__
from draw_keys"""
    v["sigmas"] = "select Country, Sim, " + ", ".join(
        f"0.5e0 + 2e0*{_u(11 + j, '1')} as sigma_{p}" for j, p in enumerate(SIGMA_OF)) + " from draw_keys"
    v["log_dispersion"] = f"select Country, Sim, cast(Age - {c.first_data_age - 1} as int) as k, Dispersion/22.0e0 as beta from dispersion"
    v["posterior_quantiles"] = f"""
select Country, Cohort, Age as ARDY, Year, Births/Exposure as ASFR,
  (Births/Exposure)*(0.9e0 + 0.2e0*((Age*31+Cohort*17) % 11)/10e0) as ASFR_prediction,
  (Births/Exposure)*(0.9e0 + 0.2e0*((Age*31+Cohort*17) % 11)/10e0)*0.92e0 as p5,
  (Births/Exposure)*(0.9e0 + 0.2e0*((Age*31+Cohort*17) % 11)/10e0)*0.97e0 as p25,
  (Births/Exposure)*(0.9e0 + 0.2e0*((Age*31+Cohort*17) % 11)/10e0)*1.03e0 as p75,
  (Births/Exposure)*(0.9e0 + 0.2e0*((Age*31+Cohort*17) % 11)/10e0)*1.08e0 as p95,
  Year <= {c.jump_off} as V_ind
from cells"""
    # --- model inputs ---------------------------------------------------------
    fda, lda = c.first_data_age, c.last_data_age
    v["births_c"] = f"""
select Country, Cohort, greatest(least(Age, {lda}), {fda}) as Age, sum(Births) as Births
from cells group by Country, Cohort, greatest(least(Age, {lda}), {fda})"""
    v["fitwin"] = f"""
select Country, Cohort, Age, Age - {fda - 1} as Age_i, Cohort + Age as Year,
       Cohort - min(Cohort) over (partition by Country) + 1 as Time,
       cast(round_even(Births, 0) as bigint) as births
from births_c where Cohort >= {c.first_full_cohort} and Cohort + Age <= {c.last_year - c.T_holdback}"""
    v["obs"] = """
select f.Country, cast(row_number() over (partition by f.Country order by f.Cohort, f.Age) as int) as i,
       f.Cohort, f.Age, f.Age_i, f.Year, f.Time,
       cast(case when f.Age_i = 1 then d.n_ages_obs + f.Time
            when f.Age_i = d.n_ages_obs then d.n_ages_obs + d.T_insample + f.Time
            else f.Age_i end as int) as disp_ind,
       f.births, d.n_ages_obs, d.T_insample
from fitwin f join (select Country, count(distinct Age_i) as n_ages_obs, count(distinct Time) as T_insample
                    from fitwin group by Country) d on f.Country = d.Country"""
    jo = c.last_year - c.T_holdback
    v["expo_grid"] = f"""
select g.Country, g.Age, g.Cohort, cast(g.Cohort - {c.first_full_cohort - 1} as int) as Time, coalesce(e.Exposure, 0.0e0) as Exposure
from (select Country, cast(a.range as int) as Age, cast(b.range as int) as Cohort
      from (select distinct Country from cells) cc
      cross join range({c.minimum_age}, {c.maximum_age + 1}) a
      cross join range({c.first_full_cohort}, {c.last_insample_cohort + 1}) b) g
left join (select Country, Age, Cohort, Exposure from cells
           where Cohort + Age <= {jo} and Cohort <= {jo - fda} and Cohort >= {c.first_full_cohort}
             and Age >= {c.minimum_age} and Age <= {c.maximum_age}) e
  on g.Country = e.Country and g.Age = e.Age and g.Cohort = e.Cohort"""
    return v


VIEW_DEPS = {
    "cells": [],
    "rates": ["cells"],
    "draw_keys": [],
    "draws": ["draw_keys"],
    "dispersion": ["draw_keys"],
    "sampler_params": ["draw_keys"],
    "sigmas": ["draw_keys"],
    "log_dispersion": ["dispersion"],
    "posterior_quantiles": ["cells"],
    "births_c": ["cells"],
    "fitwin": ["births_c"],
    "obs": ["fitwin"],
    "expo_grid": ["cells"],
}


def with_views(sql: str, views: list[str], cfg: CohortConfig = FIXTURE, extra: dict[str, str] | None = None,
               extra_deps: dict[str, list[str]] | None = None) -> str:
    """Prefix ``sql`` with the CTEs for ``views`` (and their dependencies) in order."""
    defs = view_defs(cfg)
    deps = dict(VIEW_DEPS)
    if extra:
        defs.update(extra)
    if extra_deps:
        deps.update(extra_deps)
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in deps.get(name, []):
            visit(d)
        order.append(name)

    for v in views:
        visit(v)
    ctes = ",\n".join(f"{name} AS ({defs[name]}\n)" for name in order)
    return f"WITH {ctes}\n{sql}"

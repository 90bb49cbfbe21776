"""Spark query vs DuckDB oracle (same comparison as the driver's gate) on the smallest
scale factor; the full list runs at sf0.01 with ``python -m cohortcast.plans.oracle_check``."""

import pytest

from cohortcast.plans.oracle_check import compare, duck_connection
from cohortcast.plans.registry import all_queries

from .conftest import SF_CHECK, SF_SMALL

FAST = [
    "empirical_rate", "birth_totals_clamped", "completed_family_size", "period_total_rate", "fit_window_obs",
    "period_window_obs", "dispersion_index", "exposure_grid", "exposure_pivot", "spline_basis", "run_spec_grid",
    "freeze_forecast", "freeze_summary", "freeze_by_age", "slope_fit_age", "slope_fit_time", "slope_sigma2",
    "slope_quantiles", "interval_scores", "run_config", "fit_window_by_config", "exposure_by_config", "freeze_by_config",
    "lexis_extracts", "axis_window_obs", "period_exposure", "axis_totals", "calibration_panel",
    "last_complete_cohort", "draw_names_parse", "draws_pivot_sd", "locations", "mixture_weight", "parameter_fans",
    "log_prior_rw", "split_rhat", "rhat_drop_chain", "rhat_chain_pairs", "parameter_summary", "sampler_flags",
    "energy_flags", "ess", "psis_loo", "psis_summary", "loo_diagnostics", "lko_distance", "lko_folds", "lko_runs",
    "loglik_keep", "corrected_looic", "looic_report", "looic_grid", "run_spec_csv", "sampler_csv", "latest_run", "landed_rates", "loglik_variable",
    "loglik_poisson", "log_score", "predictive_rank_exact", "central_errors", "error_summary", "is_loo",
    "refit_lpd", "cohort_profiles", "chain_choice", "assessment_collate", "rmse_table", "coverage_table", "dispersion_by_age",
    "dispersion_from_basis", "loo_compare", "parameter_summary_by_chain", "divergent_chains", "run_assessment", "rw_extension",
    "predictive_sampled", "loglik_var_unsmooth", "loglik_spline", "loglik_log_constant", "predictive_spline", "log_prior_sigmas",
    "reweighted_summary", "rate_draws_registered", "log_score_draws", "loglik_constant", "predictive_constant",
]


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    q = all_queries()[name]
    r = compare(spark, q, SF_SMALL, con)
    assert r["status"] == "ok", r
    assert r["spark_rows"] > 0


@pytest.mark.parametrize("name", ["slope_rmse", "slope_coverage"])
def test_query_matches_oracle_on_more_cells(spark, name):
    """At the smallest scale cells are missing, so the trend's variance is NULL and there is nothing to score."""
    r = compare(spark, all_queries()[name], SF_CHECK, duck_connection(SF_CHECK))
    assert r["status"] == "ok" and r["spark_rows"] > 0, r


def test_every_query_has_an_oracle():
    assert [n for n, q in all_queries().items() if q.oracle() is None] == []

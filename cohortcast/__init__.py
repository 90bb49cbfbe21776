"""cohortcast: cohort fertility forecasting and forecast assessment as Spark jobs.

Sub-packages
------------
sources    landed inputs (births / exposure extracts, posterior draws, sampler output,
           run specifications) and the derived fixture views over the test tables.
functions  Column-expression helpers: IEEE-style division and logs, log-gamma,
           count likelihoods, the parametric age densities and the B-spline basis.
operators  the domain operators (rates, model inputs, rate reconstruction,
           likelihood, scoring, convergence diagnostics, LOO, comparators, reports).
plans      the query registry used by the driver contract and the batch pipeline.
"""

__version__ = "0.1.0"

from pyspark.sql import functions as F

from cohortcast.config import FIXTURE
from cohortcast.operators import likelihood as lk
from cohortcast.plans import q_scoring as qs
from cohortcast.sources import fixtures as fx

from .conftest import SF_SMALL


def _collect(df, keys):
    return sorted(tuple(r) for r in df.select(*keys).collect())


def test_predictive_sampling_independent_of_partitioning(spark):
    cfg = FIXTURE.with_(n_draws=20)
    from cohortcast.operators import scoring as sc
    from cohortcast.plans.q_prep import emp_rates

    obs = emp_rates(spark, SF_SMALL)
    out = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        pred = sc.predictive_table(fx.draws(spark, SF_SMALL, cfg), fx.dispersion(spark, SF_SMALL, cfg), obs, cfg,
                                   qs.PF)
        out.append(_collect(sc.predictive_sampled(pred, cfg), ["Country", "Sim", "Cohort", "Age", "PP_births"]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1]


def test_rw_extension_independent_of_partitioning(spark):
    cfg = FIXTURE.with_(n_draws=40)
    out = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out.append(_collect(lk.rw_extension(fx.draws(spark, SF_SMALL, cfg), cfg), ["Country", "Sim", "Cohort", "CEB"]))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1] and len(out[0]) > 0

"""Pay features and the regressions on them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.operators.percentiles import histogram, percentiles

DAYS_PER_YEAR = 365.25


def _years_before(reference: date, day: str) -> Column:
    return F.date_diff(F.lit(reference), F.col(day)) / F.lit(DAYS_PER_YEAR)


def pay_features(employment: DataFrame, persona: DataFrame, reference: date) -> DataFrame:
    """Employments with the person's age and the years in the job, within plausible ranges."""
    persons = persona.select("bsn", F.floor(_years_before(reference, "geboortedatum")).cast("int").alias("age"), "geslacht")
    jobs = employment.select(
        "bsn", "loon_bruto_jaar", _years_before(reference, "aanvang_dienstverband").alias("tenure_years")
    ).filter((F.col("loon_bruto_jaar") > 0) & (F.col("tenure_years") > 0))
    return jobs.join(persons.filter(F.col("age").between(18, 67)), "bsn")


def feature_describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, min, p25, p50, p75, max) per column.

    All but the quartiles come from one aggregate of the columns; the quartiles from a histogram of the values.
    """
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    one_row = wide.agg(*[F.struct(F.lit(c).alias("feature"), *[f(c).alias(name) for name, f in measures.items()]).alias(c) for c in columns])
    described = one_row.select(F.inline(F.array(*columns)))
    values = histogram(wide.unpivot([], list(columns), "feature", "v").filter(F.col("v").isNotNull()), ["feature"], "v")
    quartiles = percentiles(values, ["feature"], {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return described.join(quartiles, "feature").select("feature", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def regression_simple(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares with one feature."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def regression_two_features(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares with two features, from one aggregate of means, variances and covariances.

    Centred sums (not raw products) keep the normal equations well conditioned for large values.
    """
    a, b, c = F.col(x1).cast("double"), F.col(x2).cast("double"), F.col(y).cast("double")
    complete = df.filter(a.isNotNull() & b.isNotNull() & c.isNotNull())
    s = complete.agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(c).alias("mc"),
        F.var_pop(a).alias("vaa"), F.var_pop(b).alias("vbb"), F.var_pop(c).alias("vcc"),
        F.covar_pop(a, b).alias("vab"), F.covar_pop(a, c).alias("vac"), F.covar_pop(b, c).alias("vbc"),
    )
    determinant = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    solved = s.select(
        "*",
        F.try_divide(F.col("vac") * F.col("vbb") - F.col("vbc") * F.col("vab"), determinant).alias("coef_1"),
        F.try_divide(F.col("vbc") * F.col("vaa") - F.col("vac") * F.col("vab"), determinant).alias("coef_2"),
    )
    return solved.select(
        "coef_1",
        "coef_2",
        (F.col("mc") - F.col("coef_1") * F.col("ma") - F.col("coef_2") * F.col("mb")).alias("intercept"),
        F.try_divide(F.col("coef_1") * F.col("vac") + F.col("coef_2") * F.col("vbc"), F.col("vcc")).alias("r2"),
    )


def logistic_effect(
    df: DataFrame, outcome: str, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Logit model of a yes/no outcome: (feature, coefficient, std_error, z, p).

    Each category gets indicator columns but for its alphabetically first level. Fitting is Spark
    ML's reweighted least squares: every round is one aggregate over the partitions.
    """
    # The encoder leaves out the last level, so the order is reversed.
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetDesc") for c in categorical
    ]
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_flags" for c in categorical])
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_flags" for c in categorical]], outputCol="features")
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label", maxIter=50, tol=1e-10)
    stages = [*indexers, *([encoder] if categorical else []), assembler, model]
    rows = df.select(F.col(outcome).cast("double").alias("label"), *numeric, *categorical).na.drop()
    fitted = Pipeline(stages=stages).fit(rows)
    names = list(numeric)
    for name, indexer in zip(categorical, fitted.stages[: len(indexers)], strict=True):
        names += [f"{name}_{level}" for level in indexer.labels[:-1]]
    summary, last = fitted.stages[-1].summary, fitted.stages[-1]
    coefficients = [*last.coefficients.tolist(), last.intercept]
    table = zip(
        [*names, "const"], coefficients, summary.coefficientStandardErrors, summary.tValues, summary.pValues, strict=True
    )
    return df.sparkSession.createDataFrame(
        [(n, float(c), float(e), float(z), float(p)) for n, c, e, z, p in table],
        "feature string, coefficient double, std_error double, z double, p double",
    )

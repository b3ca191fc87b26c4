"""What-if projections: an SEIR fold for each row of a scenario table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpost.functions.scoring import clamp, rounded, transmission_multiplier


def _curve(beta: Column, sigma: Column, gamma: Column, n: Column, i0: Column, vaccinated: Column, days: Column) -> Column:
    """Infected with one decimal for each day from 0, and the last susceptible, folded over the days of one row."""
    start_v = vaccinated * (n - i0 - i0)
    start = F.struct((n - i0 - i0 - start_v).alias("s"), i0.alias("e"), i0.alias("i"), start_v.alias("r"), F.array(rounded(i0, 1)).alias("curve"))

    def day(x, _):
        exposed, infectious, recovered = beta * x["s"] * x["i"] / n, sigma * x["e"], gamma * x["i"]
        i = F.greatest(F.lit(0.0), x["i"] + infectious - recovered)
        return F.struct(F.greatest(F.lit(0.0), x["s"] - exposed).alias("s"), F.greatest(F.lit(0.0), x["e"] + exposed - infectious).alias("e"), i.alias("i"), (x["r"] + recovered).alias("r"), F.concat(x["curve"], F.array(rounded(i, 1))).alias("curve"))

    return F.aggregate(F.sequence(F.lit(1), days), start, day)


def scenario_projection(scenarios: DataFrame) -> DataFrame:
    """For each scenario (district_id, disease, population, r0, incubation_days, infectious_days, r0_multiplier,
    school_closure, masking, travel_restriction, vaccination_rate, days): peaks with their first day, effective R, cases averted."""
    n = F.col("population").cast("double")
    r0 = F.col("r0") * F.greatest(F.lit(0.1), F.col("r0_multiplier"))
    sigma, gamma = 1 / F.greatest("incubation_days", F.lit(0.5)), 1 / F.greatest("infectious_days", F.lit(0.5))
    beta, i0 = r0 / F.col("infectious_days"), F.greatest(F.lit(20.0), n * 2e-5)
    multiplier, vaccinated = transmission_multiplier("school_closure", "masking", "travel_restriction"), clamp("vaccination_rate")
    with_levers = scenarios.withColumns({"_n": n, "_r0": r0, "_sigma": sigma, "_gamma": gamma, "_beta": beta, "_i0": i0, "_mult": multiplier, "_vacc": vaccinated})
    c = F.col
    run = with_levers.withColumns({
        "_base": _curve(c("_beta"), c("_sigma"), c("_gamma"), c("_n"), c("_i0"), F.lit(0.0), c("days")),
        "_inter": _curve(c("_beta") * c("_mult"), c("_sigma"), c("_gamma"), c("_n"), c("_i0"), c("_vacc"), c("days")),
    })
    peak = lambda x: F.array_max(F.col(f"{x}.curve"))
    cases_base, cases_inter = c("_n") - rounded("_base.s", 1), c("_n") * (1 - c("_vacc")) - rounded("_inter.s", 1)
    return run.select(
        *scenarios.columns,
        rounded(c("_r0") * c("_mult") * (1 - c("_vacc")) * (1 - c("_i0") / c("_n")), 3).alias("effective_r"),
        peak("_base").alias("peak_baseline"), (F.array_position("_base.curve", peak("_base")) - 1).cast("int").alias("peak_day_baseline"),
        peak("_inter").alias("peak_intervention"), (F.array_position("_inter.curve", peak("_inter")) - 1).cast("int").alias("peak_day_intervention"),
        rounded(F.greatest(F.lit(0.0), cases_base - cases_inter), 1).alias("cases_averted"),
    )

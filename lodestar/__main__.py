"""python -m lodestar PANEL OUT: walk-forward forecasts of a panel by several models, with reports.

PANEL is a Parquet table of (run, grp, series, ts, value, y).
"""

from __future__ import annotations

import argparse


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    from .operators.portfolio import TIERS
    from .operators.walkforward import MODELS

    p = argparse.ArgumentParser("lodestar", description="Walk-forward forecasts of a panel by several models, with reports.")
    p.add_argument("panel")
    p.add_argument("out")
    p.add_argument("--models", nargs="+", default=["linear"], choices=sorted(MODELS))
    p.add_argument("--window", type=int, default=120, help="rows of the first fold")
    p.add_argument("--step", type=int, default=1)
    p.add_argument("--least-t", type=float, default=0.75)
    p.add_argument("--factors", type=int, default=10)
    p.add_argument("--floor-zero", action="store_true")
    p.add_argument("--predict-next", action="store_true")
    p.add_argument("--sweep", action="store_true", help="all combinations of leverage instead of the one given")
    p.add_argument("--max-long", type=float, default=1.5)
    p.add_argument("--max-short", type=float, default=0.5)
    p.add_argument("--margin-rate", type=float, default=0.05)
    p.add_argument("--drawdown-limit", type=float, default=0.25)
    p.add_argument("--year", type=int, default=12, help="rows of a year")
    p.add_argument("--conviction", type=float, default=0.0)
    p.add_argument("--tier", choices=sorted(TIERS), help="costs of this account tier")
    p.add_argument("--run", default="latest", help="name under which the results are kept")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import factor_model, metrics, portfolio
    from .plans.outlook import COMBOS
    from .plans.reports import write_markdown
    from .sources.files import write_partitions

    a = arguments(argv)
    spark = SparkSession.builder.getOrCreate()
    found = factor_model.forecasts(spark.read.parquet(a.panel), a.models, a.window, a.step, a.least_t, a.factors, floor_zero=a.floor_zero, ahead=a.predict_next)
    # fitted once: everything else reads the stored forecasts
    write_partitions(found.withColumn("name", F.lit(a.run)), f"{a.out}/forecasts", ["name"])
    found = spark.read.parquet(f"{a.out}/forecasts").where(F.col("name") == a.run).drop("name")
    past = found.where("actual IS NOT NULL")
    write_markdown(metrics.accuracy(past, ["run", "model"]), f"{a.out}/accuracy-{a.run}", ["run", "model"])
    write_markdown(factor_model.failures(found), f"{a.out}/failures-{a.run}", ["run", "model"])
    signal = past.select(F.concat_ws("/", "run", "model").alias("series"), "ts", "pred", F.col("actual").alias("ret"))
    if a.conviction:
        signal = portfolio.conviction(signal, a.conviction).withColumn("pred", F.col("kept_pred")).drop("kept_pred")
    sized = portfolio.swept(signal, COMBOS if a.sweep else ((a.max_long, a.max_short),), a.drawdown_limit)
    write_markdown(portfolio.sweep_report(sized, a.margin_rate, year=a.year), f"{a.out}/sweep-{a.run}", ["series", "max_long", "max_short"])
    if a.tier:
        write_markdown(portfolio.cost_report(portfolio.costed(signal, portfolio.bps(a.tier)), ["series"]), f"{a.out}/costs-{a.run}", ["series"])
    if a.predict_next:
        write_markdown(found.where("ahead").select("run", "model", "ts", "pred", "bench"), f"{a.out}/next-{a.run}", ["run", "model"])


if __name__ == "__main__":
    main()

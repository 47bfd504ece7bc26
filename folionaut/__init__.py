"""Portfolio analytics as Spark jobs: NAVs, returns, risk, drawdowns and their kin for any number of series."""

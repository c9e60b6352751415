"""DataFrame -> DataFrame operators: quantiles, ranks, profiling, outliers,
filters, correlations (Pearson/Spearman/Kendall), tests, chart data."""

"""larkspur: DataFrame operators for social text, link graphs and event metrics."""

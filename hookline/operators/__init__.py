"""DataFrame operators: DataFrame in, DataFrame or model out."""

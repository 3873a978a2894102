"""DataFrame operators: f(df, ...) -> DataFrame, lazy."""

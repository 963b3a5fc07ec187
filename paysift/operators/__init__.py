"""DataFrame operators: ``f(df, columns..., config) -> DataFrame``."""

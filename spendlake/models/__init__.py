"""Models on Spark ML: ``fit(df, ...) -> model``, ``score(df, model) -> DataFrame``."""

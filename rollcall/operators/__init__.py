"""Analytics operators: ``op(presence, parameters) -> DataFrame``."""

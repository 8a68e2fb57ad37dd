"""The data products: each a function ``report(transactions) -> DataFrame``."""

"""Market-by-order analytics on Spark: order books, microstructure features, regimes and their diagnostics."""

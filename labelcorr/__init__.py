"""Label analytics for short texts on Spark: clean, encode, split, classify, correlate."""

"""weft: text, JSON, record and version analytics on Spark DataFrames."""

"""Block-structured, retractable data on Spark: decode, join, finality and sinks."""

"""Spark-first analytics for paired-end alignments, with the relational operators underneath usable on any table."""

"""Postings analytics on Spark: extract, qualify, score, keep once, report."""

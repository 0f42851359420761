"""Receivables analytics as Spark DataFrame operators and one report."""

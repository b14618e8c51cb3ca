"""Layered warehouse loads and load analytics as Spark DataFrame operators."""

"""Tidewell: data-quality, cleaning and analytics operators as Spark DataFrame transforms."""

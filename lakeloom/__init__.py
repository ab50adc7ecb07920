"""lakeloom: corpus hygiene, retrieval evaluation and graph analytics as Spark DataFrame operators."""

__version__ = "0.1.0"

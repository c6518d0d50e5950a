"""Land-suitability and solar-energy analytics as Spark DataFrame operators."""

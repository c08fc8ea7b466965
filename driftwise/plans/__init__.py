"""Query plans: composite pipelines, the registered queries and their SQL oracles."""

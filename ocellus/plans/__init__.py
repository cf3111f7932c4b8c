"""The prediction engine and the registered queries."""

"""Query plans over tables: the registered queries and the report."""

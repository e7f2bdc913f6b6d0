"""Sources: driver tables, derived input tables, the ``pysource`` file scan."""

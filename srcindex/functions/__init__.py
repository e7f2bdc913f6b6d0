"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from srcindex.functions.text import is_blank, pystrip, truncate_chars, with_dedent  # noqa: F401

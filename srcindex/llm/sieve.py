"""The Bloom filter lives in ``srcindex.functions.sieve``; the index store uses it too."""

from srcindex.functions.sieve import sieve  # noqa: F401

"""Plans: the catalogue of queries with their SQL, and staged pipelines."""

from glyphmill.plans import catalogue, formats, histories  # noqa: F401  (all register queries)

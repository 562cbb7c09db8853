"""All registered queries of the library's own operators."""

from tidemark.plans import analytics, catalogue, claimed, cleaned, curation, linking, passages, pinpointed, quality, registry, rules, searching, storing

assert analytics and claimed and cleaned and curation and linking and passages and pinpointed and quality and registry and rules and searching and storing  # importing them registers their queries
QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL

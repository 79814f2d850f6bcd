"""All queries but those of the llm package; importing this package registers them."""

from quillspark.plans import candidates, changes, corpus, guard, jobs, leftovers, more, names, pages, pairs, relational, reviews, sites
from quillspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "candidates", "changes", "corpus", "guard", "jobs", "leftovers", "more", "names", "pages", "pairs", "relational", "reviews", "sites"]

"""Full-text search over files and DataFrames, expressed as Spark jobs."""

from .operators.conditions import (all_of, any_of, exclude, fuzzy, match_all, match_field, match_path,
                                   near, phrase, regex, term, wildcard)
from .plans.collection import Collection
from .plans.store import CollectionStore

__all__ = ["all_of", "any_of", "exclude", "fuzzy", "match_all", "match_field", "match_path", "near",
           "phrase", "regex", "term", "wildcard", "Collection", "CollectionStore"]

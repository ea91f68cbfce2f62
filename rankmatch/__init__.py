"""Ranked fuzzy text search over DataFrames."""

from .functions.options import DEFAULT, PATHS, Case, ClosedCorpusError, KeyKind, Mode, Norm, Preset, Scoring, SearchError, SearchKey, SearchOptions, Unicode
from .operators.search import match_indices, match_score
from .sources.corpus import Corpus, One, build_async

__all__ = ["DEFAULT", "PATHS", "Case", "ClosedCorpusError", "Corpus", "KeyKind", "Mode", "Norm", "One", "Preset", "Scoring", "SearchError", "SearchKey", "SearchOptions", "Unicode", "build_async", "match_indices", "match_score"]

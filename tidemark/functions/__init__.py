"""The library's column functions in one place, for use in ``select`` and ``filter``."""

from tidemark.operators.chunks import approximate_tokens, chunk_id, last_space, named_uuid, trim_to_sentences
from tidemark.operators.near import similarity
from tidemark.operators.quantities import equivalent, parse_quantity
from tidemark.operators.registry import keyword_class, worst
from tidemark.operators.scans import box_iou, confidence, indian_number, masked_sample, span_iou, terms, word_error_rate
from tidemark.operators.search import authority_boost, centrality_boost, conflict_margin, effective_date, entitlement
from tidemark.operators.sentences import hidden_classes, osa_distance, without_hidden
from tidemark.operators.texts import collapsed, fingerprint, main_text, masked, sentences, slug

__all__ = [
    "approximate_tokens", "authority_boost", "box_iou", "centrality_boost", "chunk_id", "collapsed", "confidence", "conflict_margin", "effective_date", "entitlement",
    "equivalent", "fingerprint", "hidden_classes", "indian_number", "keyword_class", "last_space", "main_text", "masked", "masked_sample", "named_uuid",
    "osa_distance", "parse_quantity", "sentences", "similarity", "slug", "span_iou", "terms", "trim_to_sentences", "without_hidden", "word_error_rate",
    "worst",
]

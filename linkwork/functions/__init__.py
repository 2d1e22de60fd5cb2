"""Column functions (all JVM-side expressions)."""

from .text import html_escape, html_unescape_basic, py_title, split_ws, strip_ws
from .titles import clean_title, format_label, jaccard, levenshtein_ratio, preview, title_similarity, token_set
from .titles import with_clean_title
from .urls import with_normalized_url, with_sanitized_url
from .urls import (
    default_url, domain_of_sanitized, extract_domain, is_dangerous_url, normalize_url, path_identifier,
    sanitize_url,
)

__all__ = [
    "clean_title", "default_url", "domain_of_sanitized", "extract_domain", "format_label", "html_escape",
    "html_unescape_basic", "is_dangerous_url", "jaccard", "levenshtein_ratio", "normalize_url",
    "path_identifier", "preview", "py_title", "sanitize_url", "split_ws", "strip_ws", "title_similarity",
    "token_set", "with_clean_title", "with_normalized_url", "with_sanitized_url",
]

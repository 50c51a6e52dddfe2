"""Column-expression building blocks."""

from adlens.functions.arrays import any_of, top_tokens, with_token_counts
from adlens.functions.text import (keyword_tokens, label_line, label_name, letter_tokens,
                                   parse_label, rule_tag, strip_ws, vector_tokens)
from adlens.functions.time import bucket, bucket_key, period_unit
from adlens.functions.vector import cosine, dot, norm

__all__ = [
    "any_of", "top_tokens", "with_token_counts", "keyword_tokens", "label_line", "label_name",
    "letter_tokens", "parse_label", "rule_tag", "strip_ws", "vector_tokens", "bucket",
    "bucket_key", "period_unit", "cosine", "dot", "norm",
]

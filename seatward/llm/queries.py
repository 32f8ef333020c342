"""Importing the operator modules fills the registry."""

from seatward.llm import (  # noqa: F401
    bpe, dedup, jaccard, language, mixing, prefix_trie, quality, resampling, resharding, secrets, suffix_tree, token_files, warc,
)
from seatward.llm.common import ORACLES, QUERIES  # noqa: F401

"""All queries of the training-data operators, by name, and their SQL."""

from vigilframe.llm import chat, decontaminate, jaccard_join, licenses, mixing, pii, prefix_trie, quality, repair, suffix_dedup, token_counts, token_output, urls  # noqa: F401  (register their queries)
from vigilframe.llm.common import QUERIES, SQL  # noqa: F401

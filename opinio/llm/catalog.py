"""All queries of the corpus operators."""

from opinio.llm import collocations, licenses, mixing, multiset, negatives, packing, privacy, quantized, secrets, sharding, simhash, toxicity, urls
from opinio.llm.common import QUERIES, SQL

MODULES = (collocations, licenses, mixing, multiset, negatives, packing, privacy, quantized, secrets, sharding, simhash, toxicity, urls)

__all__ = ["MODULES", "QUERIES", "SQL"]

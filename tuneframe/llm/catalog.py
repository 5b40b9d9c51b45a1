"""All registered queries of this subpackage."""

from tuneframe.llm import collocations, exact, jaccard, katz, langid, mixing, mtree, nra, packing, repeats, tokens, urls, warc  # noqa: F401
from tuneframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

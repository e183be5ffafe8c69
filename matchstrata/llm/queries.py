"""All queries of the subpackage."""

from matchstrata.llm import bytepair, collocations, covertree, hardneg, langid, lines, maxscore, ngrams, packing, permindex, simhash, surrogates, tokenfiles  # noqa: F401
from matchstrata.llm.base import CATALOG


def load():
    return CATALOG

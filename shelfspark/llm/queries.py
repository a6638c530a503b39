"""Imports every operator of this subpackage, which registers its query."""

from shelfspark.llm import (alignment, archives, collocations, decontamination, fingerprints, language_id, main_text, minhash, pieces, quality,  # noqa: F401
                            suffix_dedup, token_counts, toxicity)
from shelfspark.llm.common import ORACLES, QUERIES  # noqa: F401

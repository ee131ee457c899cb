"""Every query of this subpackage; importing the modules registers them."""

from docgauge.llm import queries_alignment, queries_benchmark, queries_language, queries_lm, queries_models, queries_pairs, queries_phrases, queries_repeats, queries_search, queries_sets, queries_text  # noqa: F401
from docgauge.llm.registry import ORACLES, QUERIES  # noqa: F401

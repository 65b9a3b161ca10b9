"""Importing this module registers the queries of this package."""

from lexiloom.llm import chat, decontaminate, langid, merkle, mixing, ngram_join, packing, quality, repair, secret_scan, sharding, toxicity, url_rules  # noqa: F401
from lexiloom.llm.tables import ORACLES, QUERIES  # noqa: F401

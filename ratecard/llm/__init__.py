"""Training-data operators: near and exact dedup, sharding, WARC archives, packing, text
extraction, BPE, toxicity, secret scans, exact vector search, quality scores, conversation repair
and filter audits. Nothing else in the library
imports this subpackage; ``queries.py`` lists its registered queries."""

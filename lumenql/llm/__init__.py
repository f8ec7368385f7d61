"""Training-data operators: mixing, licence scans, sharding, deduplication, decontamination, quality and extraction.

Nothing outside this folder imports it; ``lumenql.llm.registry`` lists its queries.
"""

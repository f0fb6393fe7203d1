"""Training-data operators: quality, near-duplicates, decontamination, LM scores, URL filters, WARC, sharding,
chat formatting, byte-level BPE and substring de-duplication. Nothing else in the library imports this folder."""

"""Training-data operators: archives, packing, chat text, secrets, BPE, quality,
sharding, near-duplicates, decontamination, licences, exact duplicates, whitening
and ranked search. Nothing outside this subpackage (and ``corpus_pipeline.py``)
imports it."""

"""Training-data operators: decontamination, deduplication, quality, packing, archives, licences, scoring, surrogates, URL trust."""

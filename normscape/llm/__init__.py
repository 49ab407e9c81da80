"""Training-data operators: language ID, licences, dedup, packing, search, secrets, LM scoring, segmentation."""

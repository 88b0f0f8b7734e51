"""Training-data operators: tokens, packing, archives, chat, deduplication, decontamination, quality."""

"""Training-data operators: extraction, filtering, near-duplicates, decontamination and tokenisation."""

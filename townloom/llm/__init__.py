"""Training-data operators: similarity joins, decontamination, classifiers, packing, token files."""

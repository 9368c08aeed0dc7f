"""Training-data operators: formatting, filtering, de-duplication, packing, search."""

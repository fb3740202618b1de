"""Training-data operators (dedup, packing, mixing, scoring). Nothing outside this subpackage imports it."""

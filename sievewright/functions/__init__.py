"""Column functions: hashing, entropy, masking, levels, filters and text sanitising."""

"""Column functions on sequences, CIGAR strings and flags."""

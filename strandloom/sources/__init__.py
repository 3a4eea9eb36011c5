"""Readers and writers of the text formats around alignments, variants, sequences and graphs."""

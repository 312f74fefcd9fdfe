"""Relational operators over chunks, postings, vectors and logs."""

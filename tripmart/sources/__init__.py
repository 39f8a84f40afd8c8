"""Readers and writers; all input and output of the library passes here or through `streaming`."""

"""Readers and writers: the page collection, labelled text, stream source/sink."""

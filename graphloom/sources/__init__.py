"""Readers and writers of edge lists, label files and GML."""

"""Readers and writers: registers, label sheets, page images, results."""

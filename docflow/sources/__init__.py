"""Readers and writers for documents, records, journals and exports."""

"""Readers and writers: files, text pages, JSON, XML, HTML, and the ledger renderer."""

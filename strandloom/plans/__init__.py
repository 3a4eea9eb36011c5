"""Shared job pieces: scratch tables, connected components, adapters from the test tables, and the registered queries."""

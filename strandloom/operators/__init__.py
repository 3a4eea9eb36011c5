"""DataFrame operators by domain."""

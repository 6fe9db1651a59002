"""DataFrame operators that SQL text cannot state well."""

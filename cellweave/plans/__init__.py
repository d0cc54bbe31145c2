"""The registry of partitioners and the library's queries."""

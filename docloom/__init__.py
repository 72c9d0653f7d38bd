"""DataFrame operators for document collections and layered declarative metadata."""

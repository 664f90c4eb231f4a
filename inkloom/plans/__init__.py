"""The query catalogue of the core package and its SQL counterparts."""

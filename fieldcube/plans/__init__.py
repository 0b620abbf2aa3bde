"""Dependency graphs as tables, and jobs of named DataFrame steps."""

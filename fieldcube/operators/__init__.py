"""Operators beyond the cube's own methods: ensemble windows and extremes, trace analytics."""

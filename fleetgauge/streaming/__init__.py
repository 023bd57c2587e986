"""Streaming forms of operators that look only at the recent past."""

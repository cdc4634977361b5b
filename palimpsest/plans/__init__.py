"""Workload generation and simulation plans."""

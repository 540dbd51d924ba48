"""Readers and writers."""

from tallystack.sources.io import read_table, write_table, save_model, load_model, driver_table

__all__ = ["read_table", "write_table", "save_model", "load_model", "driver_table"]

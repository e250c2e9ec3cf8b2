"""Readers, adapters and writers.  Nothing is collected to the driver except a handful of scalar settings."""

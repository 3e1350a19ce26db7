"""Procurement risk analytics on Spark."""

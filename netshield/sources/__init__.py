"""Readers that turn raw inputs into typed DataFrames."""

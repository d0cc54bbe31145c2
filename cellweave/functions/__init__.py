"""Expressions and random numbers shared by sources and operators."""

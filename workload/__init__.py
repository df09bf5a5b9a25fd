"""Inputs, registered queries and their SQL counterparts."""

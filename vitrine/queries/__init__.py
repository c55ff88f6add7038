"""Registered queries: each runs over whole tables and most have a SQL check."""

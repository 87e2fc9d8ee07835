"""Registered queries with their reference SQL, and the tool that compares them."""

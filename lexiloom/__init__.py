"""Checks source code for hardcoded user-interface text against a catalog of translations, with Spark."""

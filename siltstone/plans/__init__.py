"""Registered queries over the shared tables, each with its SQL where SQL can say it."""

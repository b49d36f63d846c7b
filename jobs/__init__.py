"""Runnable jobs over the tables: each module has ``run``, which takes a session, and a command line."""

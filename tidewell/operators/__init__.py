"""Operators on tables of notes: search, counters, profiles, relays, statistics, maintenance."""

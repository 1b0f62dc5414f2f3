"""Operators on bars and series: functions from DataFrame to DataFrame.

Long form throughout: a row per ``series_id`` and position ``t`` (or ``time``). Every
window is partitioned by series; a series is the unit that one task holds.
"""

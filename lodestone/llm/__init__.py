"""Training-data operators: search, decontamination, scoring, dedup, extraction, mixing.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
``opN_<name>`` queries; every other module holds one operator with its own
general interface.
"""

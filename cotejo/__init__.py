"""cotejo: reconciliation of accounting tables with DataFrames.

Tables of many documents (keyed by ``doc_id``) are checked against the
arithmetic they declare about themselves.  Every operator is a function from
DataFrames to a DataFrame; nothing here runs an action.
"""

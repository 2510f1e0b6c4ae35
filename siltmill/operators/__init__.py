"""Index, search, session, dataset and model operators over DataFrames."""

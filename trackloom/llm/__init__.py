"""Training-data operators: each module holds one operator over a DataFrame of documents."""

"""Training-data operators: each module holds one operator, its thin ``op<N>_`` query and, where SQL can say it, its SQL."""

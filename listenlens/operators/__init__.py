"""DataFrame-in, DataFrame-out operators (aggregates take ``keys``)."""

"""Query catalog: registered queries over the given tables and their SQL oracles."""

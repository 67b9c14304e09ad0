"""From statement text to DataFrames: lexer, parser, literal binding, compilation, pruning report."""

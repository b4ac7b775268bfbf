"""Functions of columns and of single values: sequences, headers, alignments, enzymes, crosses."""

"""Finance operators, DataFrame in and DataFrame out."""

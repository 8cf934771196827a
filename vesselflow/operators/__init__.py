"""Building blocks of the analyses: DataFrame in, lazy DataFrame out."""

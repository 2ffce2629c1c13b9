"""Panel operators, grouped the way the analysed pipeline's layers are."""

"""Operators from DataFrame to DataFrame. All are lazy but for those that iterate to a fixpoint."""

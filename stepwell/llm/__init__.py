"""Training-data operators: dedup, decontamination, filters, scoring, formatting, BPE.

Nothing else in the package imports this subpackage.  Every operator reads whole
texts of whole tables; what each gives for nulls, empty texts and ties stands in
its docstring.
"""

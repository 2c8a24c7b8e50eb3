"""Operators for preparing text at scale: scans, scoring, sharding, near-duplicate
joins, packing, token files, decontamination and chat formatting.

Nothing else in the library imports this subpackage.  Executors need the
package on their path (``--py-files`` or an installed wheel), as for any
Python function that Spark runs.
"""

"""Training-data operators: fingerprints, near-duplicates, decontamination,
packing, WARC archives, classifiers, secret scans and line dedup.

Nothing else in the library imports this subpackage; it uses only the general
helpers of ``tablelens.session`` and ``tablelens.sources``.
"""
